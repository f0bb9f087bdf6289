"""Reports over detected segments: categories, lines of a debug table, results as JSON, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT_SCHEMA = "image_width int, image_height int, count int, regions array<struct<box: struct<x: int, y: int, width: int, height: int>, categories: array<string>, text: string, confidence: double>>"


def category_summary(detected: DataFrame, *by: str) -> DataFrame:
    """(by, category, n): how many segments carry each category, most first, then by name."""
    # The outer form brings no filter on the array's size, which would have the array computed twice.
    each = detected.select(*by, F.explode_outer("categories").alias("category")).filter("category <> ''")
    return each.groupBy(*by, "category").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "category")


def debug_table(detected: DataFrame) -> DataFrame:
    """A line for each segment: its number from 1, text, categories, whether it is redacted, and the confidence."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("seg_idx"))
    some = F.size("categories") > 0
    return detected.select(
        "image_id",
        number.alias("number"),
        "text",
        F.when(some, F.array_join("categories", ", ")).otherwise("(not sensitive)").alias("categories"),
        F.when(some, "yes").otherwise("no").alias("redacted"),
        F.format_string("%.1f%%", F.col("confidence") * 100).alias("confidence"),
        "box",
    )


def found_by_image(detected: DataFrame) -> DataFrame:
    """(image_id, r, fallback) for each image with segments: the sensitive ones, and whether patterns stood alone for any."""
    own = F.struct("seg_idx", "box", "categories", "text", "confidence")
    fallback = F.max("fallback") if "fallback" in detected.columns else F.lit(False)
    # A group is one image's segments, as many as fit on a page; collect_list leaves nulls out.
    return detected.groupBy("image_id").agg(F.sort_array(F.collect_list(F.when(F.size("categories") > 0, own))).alias("r"), fallback.alias("fallback"))


def with_results(rows: DataFrame) -> DataFrame:
    """rows with regions and their count in place of the r of found_by_image(); null is none."""
    regions = F.transform(F.coalesce("r", F.array().cast(dict(rows.dtypes)["r"])), lambda r: F.struct(r["box"].alias("box"), r["categories"].alias("categories"), r["text"].alias("text"), r["confidence"].alias("confidence")))
    return rows.withColumn("regions", regions).withColumn("count", F.size("regions")).drop("r")


def results(detected: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, image_width, image_height, count, regions) for each of images (image_id, width, height)."""
    found = found_by_image(detected)
    rows = images.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height")).join(found, "image_id", "left")
    return with_results(rows).select("image_id", "image_width", "image_height", "count", "regions")


def to_json(found: DataFrame) -> DataFrame:
    """(image_id, result JSON)."""
    return found.select("image_id", F.to_json(F.struct("image_width", "image_height", "count", "regions")).alias("result"))


def from_json(rows: DataFrame) -> DataFrame:
    """results() from its JSON; the count is that of the regions, whatever the JSON says."""
    read = rows.select("image_id", F.from_json("result", RESULT_SCHEMA).alias("r")).select("image_id", "r.*")
    return read.withColumn("count", F.size("regions"))


def count_label(found: DataFrame) -> DataFrame:
    """found with a line for readers."""
    return found.withColumn("label", F.concat(F.col("count").cast("string"), F.lit(" sensitive region"), F.when(F.col("count") == 1, "").otherwise("s"), F.lit(" detected")))


def data_url(format_: str, base64: str):
    """A data URL of a column of base64; null without one."""
    return F.concat(F.lit(f"data:image/{format_.lower()};base64,"), F.col(base64))


def recall(detected: DataFrame, expected: str = "expected") -> DataFrame:
    """(recall): the share of rows whose categories hold the expected one."""
    return detected.agg(F.avg(F.array_contains("categories", F.col(expected)).cast("double")).alias("recall"))
