"""Uploaded files: size, format and decoding checks, with a failed file as an error row instead of a failed job.

The checks go in a fixed order - size, format, decoding - and the first failure counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits, formats and the status of each error.
MAX_BYTES = 10 * 1024 * 1024
SUPPORTED = ("PNG", "JPEG")
STATUS = {"UNSUPPORTED_FORMAT": 415, "FILE_TOO_LARGE": 413, "INVALID_IMAGE": 400, "OCR_FAILED": 422, "INTERNAL_ERROR": 500}
#: The first bytes of each format, in hexadecimal; WEBP has its name after four bytes of length.
_MAGIC = [("PNG", "89504E470D0A1A0A"), ("JPEG", "FFD8FF"), ("GIF", "474946383761"), ("GIF", "474946383961"), ("BMP", "424D"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A")]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def sniff_format(content: Column) -> Column:
    """The format by the content's first bytes; null for an empty or unknown one."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    for name, magic in _MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def error(code: str, message, detail=None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(STATUS[code]).alias("http_status"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def checked(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """files (path, length, content) with format and error (null where size and format are good).

    Only the first bytes of the content are looked at, and nothing of a file that is too large.
    """
    fmt = sniff_format(F.col("content"))
    size = F.coalesce(F.col("length"), F.length("content").cast("long"))
    large = error("FILE_TOO_LARGE", F.format_string("The file has %d bytes; at most %d are taken.", size, F.lit(limit)), F.lit(f"size_limit_bytes: {limit}"))
    wrong = error("UNSUPPORTED_FORMAT", F.concat(F.lit("Only PNG and JPEG images are taken, not "), F.coalesce("format", F.lit("this file")), F.lit(".")), F.concat(F.lit("received: "), F.coalesce("format", F.lit("unknown"))))
    rows = files.withColumn("format", F.when(size <= limit, fmt))
    return rows.withColumn("error", F.when(size > limit, large).when(~F.coalesce(F.col("format").isin(*SUPPORTED), F.lit(False)), wrong))


def pixels_ok(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """Whether decoded pixels are an image: positive sizes, 1, 3 or 4 channels, as many bytes as that makes."""
    return F.coalesce((height > 0) & (width > 0) & channels.isin(1, 3, 4) & (F.length(data) == height * width * channels), F.lit(False))


def decoded(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """(path, error, height, width, channels, data) of the files under path: blue, green, red, the alpha laid on white.

    The JVM decodes. A file that can't be decoded has the error INVALID_IMAGE and no pixels.
    """
    files = checked(read_files(spark, path), limit).select("path", "error", "format")
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    # The two sources write the scheme of local files with one slash and with three.
    plain = F.regexp_replace("origin", "^file:/+", "file:/")
    rows = files.withColumn("_at", F.regexp_replace("path", "^file:/+", "file:/")).join(images.withColumn("_at", plain).drop("origin"), "_at", "left")
    good = pixels_ok(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))
    rows = rows.withColumn("error", F.coalesce("error", F.when(~good, error("INVALID_IMAGE", "The file cannot be decoded as an image."))))
    from ..operators.images import on_white

    return on_white(rows.select("path", "error", "height", "width", F.col("nChannels").alias("channels"), F.when(F.col("error").isNull(), F.col("data")).alias("data")))
