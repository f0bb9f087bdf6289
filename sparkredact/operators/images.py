"""Pixels: images are rows of height, width, channels and data (bytes by row, blue green red and alpha).

Decisions are column expressions; only what touches pixels runs in Python, one Arrow batch at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def white_under(image: np.ndarray) -> np.ndarray:
    """Three channels: grey repeated, alpha laid on white."""
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 4:
        alpha = image[:, :, 3:].astype(np.float32) / 255
        return np.rint(image[:, :, :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return image


def on_white(images: DataFrame) -> DataFrame:
    """images with three channels; rows without data and those that have three stay in the JVM."""

    @F.pandas_udf("binary")
    def flat(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else white_under(array_of(int(a), int(b), int(n), d)).tobytes() for a, b, n, d in zip(h, w, c, data, strict=True)])

    other = F.col("data").isNotNull() & F.col("channels").isin(1, 4)
    data = F.when(other, flat("height", "width", "channels", F.when(other, F.col("data")))).otherwise(F.col("data"))
    return images.withColumn("data", data).withColumn("channels", F.when(other, 3).otherwise(F.col("channels")))


def blacked(image: np.ndarray, boxes) -> np.ndarray:
    """A copy whose boxes (x, y, width, height) are zero in every channel; what lies outside is left alone."""
    out = image.copy()
    for b in boxes:
        out[max(b["y"], 0) : b["y"] + b["height"], max(b["x"], 0) : b["x"] + b["width"]] = 0
    return out


def redact(images: DataFrame, regions: DataFrame) -> DataFrame:
    """images (image_id, height, width, channels, data) with the boxes of regions (image_id, box) black.

    Boxes are gathered by image, pixels of images without any never leave the JVM; shape and type stay.
    """
    boxes = regions.groupBy("image_id").agg(F.collect_list("box").alias("boxes"))  # a page's regions
    rows = images.join(boxes, "image_id", "left")
    return rows.withColumn("data", blackened("height", "width", "channels", "data", F.col("boxes"))).drop("boxes")


def blackened(height: str, width: str, channels: str, data: str, boxes: Column) -> Column:
    """The pixels with boxes (null: none) black; those of images without any never leave the JVM."""

    @F.pandas_udf("binary")
    def fill(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else blacked(array_of(int(a), int(b), int(n), x), own).tobytes() for a, b, n, x, own in zip(h, w, c, d, found, strict=True)])

    own = F.coalesce(boxes, F.array().cast("array<struct<x:int,y:int,width:int,height:int>>"))
    some = (F.size(own) > 0) & F.col(data).isNotNull()
    return F.when(some, fill(height, width, channels, F.when(some, F.col(data)), own)).otherwise(F.col(data))


def png(image: np.ndarray) -> bytes:
    """A PNG file of an image with 1, 3 or 4 channels."""
    h, w, c = image.shape
    rgb = image if c == 1 else image[:, :, [2, 1, 0, *([3] if c == 4 else [])]]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_base64(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """The image as base64 of a PNG file; null without pixels."""

    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else png(array_of(int(a), int(b), int(n), x)) for a, b, n, x in zip(h, w, c, d, strict=True)])

    return F.base64(encode(height, width, channels, data))


def by_image(images: DataFrame, change, schema: str) -> DataFrame:
    """images through change(array, row) -> dict, a batch at a time; rows without data pass with nulls."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                made = {} if row["data"] is None else change(array_of(int(row["height"]), int(row["width"]), int(row["channels"]), row["data"]), row)
                rows.append({**row, **made})
            yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(run, schema)
