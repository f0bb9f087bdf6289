"""The whole way of a page: quality, segments, categories, regions, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as pixels
from ..operators import preprocess, report
from ..operators.layers import FALLBACK_WARNING, Layer, detect


def process(images: DataFrame, segments: DataFrame, layers: list[Layer] | None = None, redact: bool = True, passthrough: bool = True) -> DataFrame:
    """A row for each of images (image_id, height, width, channels, data).

    Returns image_id, image_width, image_height, count, regions, sufficient, warnings,
    processed (the pixels that were looked at) and redacted (null where quality is
    insufficient or redaction isn't asked for). Segments of images of insufficient
    quality are dropped before they are classified.
    """
    ready = preprocess.warnings_for(preprocess.with_quality(images, passthrough))
    good = ready.filter("sufficient").select("image_id")
    detected = detect(segments.join(good, "image_id", "left_semi"), layers)
    made = preprocess.prepared(ready, passthrough)
    # One row for each image from one pass over its segments: regions, boxes and warnings all come from it.
    found = report.found_by_image(detected)
    rows = made.select("image_id", "height", "width", "channels", "data", "sufficient", "warnings").join(found, "image_id", "left")
    rows = report.with_results(rows)
    redacted = pixels.blackened("height", "width", "channels", "data", F.col("regions.box")) if redact else F.lit(None).cast("binary")
    more = F.when(F.coalesce("fallback", F.lit(False)), F.array(F.lit(FALLBACK_WARNING))).otherwise(F.array().cast("array<string>"))
    columns = ["image_id", "channels", "sufficient", F.concat("warnings", more).alias("warnings"), F.col("data").alias("processed"), F.when(F.col("sufficient"), redacted).alias("redacted")]
    return rows.select(*columns, F.col("width").alias("image_width"), F.col("height").alias("image_height"), "count", "regions")


def returned_image(processed: DataFrame) -> DataFrame:
    """(image_id, base64): of each image the redacted pixels, else those processed, as a PNG."""
    data = F.coalesce("redacted", "processed")
    return processed.select("image_id", pixels.png_base64(F.col("image_height"), F.col("image_width"), F.col("channels"), data).alias("base64"))


def health(spark: SparkSession, layers: list[Layer] | None = None) -> DataFrame:
    """(status, layers_available): never fails, and loads nothing."""
    from ..operators.layers import is_available

    return spark.createDataFrame([("ok", [x.name for x in layers or [] if is_available(x)])], "status string, layers_available array<string>")
