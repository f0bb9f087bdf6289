"""What the operators share: the shared folder, written tables and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (single-machine tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkredact-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for made in tables:
        spark = made.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(made.written_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that is read in fewer partitions than there are cores is dealt evenly to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def id_bucket(column: str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def smallest(df: DataFrame, h: str, bound: int, *ties: str, lots: int = 64) -> DataFrame:
    """bound rows of df, or all where it has fewer (but for chance), by small values of the hash h.

    Rows are drawn by lots of the hash: each task keeps a few rows of each lot before
    the shuffle, and twice the bound at most reaches the final order, whatever
    the number of tasks.
    """
    place = Window.partitionBy("_lot").orderBy(h, *ties)
    some = df.withColumn("_lot", F.pmod(F.col(h), F.lit(lots))).withColumn("_place", F.row_number().over(place))
    some = some.filter(F.col("_place") <= max(16, -(-2 * bound // lots))).drop("_lot", "_place")
    return some.orderBy(h, *ties).limit(bound)


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """batch cut so that a slice has about so many bytes of text; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
