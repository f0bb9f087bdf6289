"""Text tables as segments: every line of a text is one, in the order of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all cores where a scan has fewer partitions than there are cores; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


def line_segments(texts: DataFrame, key: str, text: str = "text", *keep: str) -> DataFrame:
    """(image_id, seg_idx, text, keep...) for each line that isn't blank; a null text has none."""
    lines = spread(texts.select(key, *keep, text)).select(F.col(key).cast("string").alias("image_id"), *keep, F.posexplode(F.split(F.col(text), "\n")).alias("seg_idx", "text"))
    return lines.filter(~blank(F.col("text"))).select("image_id", "seg_idx", "text", *keep)
