"""Detection over a stream of arriving segment files.

Detection looks at one row at a time, so the batch functions run on a stream as
they are: no state, no watermark. What counts over time carries a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import classify
from ..operators.layers import regions

SEGMENT_SCHEMA = "image_id string, seg_idx int, text string, confidence double, arrived timestamp"


def segments_in(spark: SparkSession, folder: str, schema: str = SEGMENT_SCHEMA, files: int = 100) -> DataFrame:
    """Segments of the Parquet files that arrive in folder, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def detected(stream: DataFrame) -> DataFrame:
    """The sensitive segments of a stream."""
    return regions(classify(stream))


def category_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, category, n): categories in windows of arrival, late ones until the watermark has passed."""
    each = detected(stream.withWatermark("arrived", late)).select("arrived", F.explode_outer("categories").alias("category"))
    return each.groupBy(F.window("arrived", window), "category").agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, folder: str, checkpoint: str):
    """A running query that appends to Parquet files in folder, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
