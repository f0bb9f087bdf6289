"""Text recognition results as segments: (image_id, seg_idx, text, box, confidence).

Results are ingested as data. An image with a result that can't be used becomes
an error row and gives no segments at all; an image without text is no error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detectors import blank
from .geometry import confidence, quad_to_box, words_to_box

#: The confidence of a service that reports none, and the shape of its reply.
OVERLAY_CONFIDENCE = 0.99
OVERLAY_SCHEMA = "IsErroredOnProcessing boolean, ErrorMessage string, ParsedResults array<struct<TextOverlay: struct<Lines: array<struct<LineText: string, Words: array<struct<WordText: string, Left: string, Top: string, Width: string, Height: string>>>>>>>"
SEGMENTS = ("image_id", "seg_idx", "text", "box", "confidence")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(*order)) - 1
    return rows.withColumn("seg_idx", place.cast("int")).select(*SEGMENTS)


def overlay_segments(replies: DataFrame) -> DataFrame:
    """Segments of overlay replies (image_id, body JSON): a line is a segment, its box that of its words."""
    parsed = replies.select("image_id", F.from_json("body", OVERLAY_SCHEMA).alias("r")).filter(~F.coalesce(F.col("r.IsErroredOnProcessing"), F.lit(False)))
    lines = parsed.select("image_id", F.posexplode("r.ParsedResults").alias("page", "p")).select("image_id", "page", F.posexplode("p.TextOverlay.Lines").alias("line", "l"))
    number = lambda w, k: w[k].try_cast("int").alias(k.lower())
    words = F.transform("l.Words", lambda w: F.struct(*(number(w, k) for k in ("Left", "Top", "Width", "Height"))))
    rows = lines.select("image_id", "page", "line", F.trim("l.LineText").alias("text"), words_to_box(words).alias("box"), F.lit(OVERLAY_CONFIDENCE).alias("confidence"))
    return _numbered(rows.filter(F.col("box").isNotNull() & ~blank(F.coalesce("text", F.lit("")))), "page", "line")


def overlay_errors(replies: DataFrame) -> DataFrame:
    """(image_id, code, message) of replies that report an error or are no JSON."""
    parsed = replies.select("image_id", F.from_json("body", OVERLAY_SCHEMA).alias("r"), F.from_json("body", "map<string,string>").alias("any"))
    bad = F.col("any").isNull() | F.coalesce(F.col("r.IsErroredOnProcessing"), F.lit(False))
    return parsed.filter(bad).select("image_id", F.lit("OCR_FAILED").alias("code"), F.coalesce("r.ErrorMessage", F.lit("no readable reply")).alias("message"))


def _polygon_lines(results: DataFrame) -> DataFrame:
    """Each line of results with a polygon: its parts, and whether the polygon can be read."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    if "dt_polys" in results.columns:
        results = results.withColumn("rec_polys", F.coalesce("rec_polys", "dt_polys"))
    arrays = ("rec_texts", "rec_scores", "rec_polys", "text_word", "text_word_region")
    # Missing arrays are empty ones: zipped with a null the whole would be null.
    full = results.select("image_id", "width", "height", *(F.coalesce(F.col(c), F.array().cast(results.schema[c].dataType)).alias(c) for c in arrays))
    zipped = full.select("image_id", "width", "height", F.size("rec_texts").alias("texts"), F.posexplode(F.arrays_zip(*arrays)).alias("line", "l")).filter("line < texts")
    quad = lambda poly: quad_to_box(F.transform(poly, point), F.col("width"), F.col("height"))
    boxes = F.transform("l.text_word_region", quad)
    lines = zipped.select("image_id", "line", "l", confidence(F.col("l.rec_scores")).alias("confidence"), quad(F.col("l.rec_polys")).alias("box"), boxes.alias("boxes"))
    by_word = (F.size("l.text_word") > 0) & (F.size("l.text_word") == F.size("boxes")) & ~F.exists("boxes", lambda b: b.isNull())
    words = F.arrays_zip(F.col("l.text_word").alias("text"), F.col("boxes").alias("box"))
    whole = F.array(F.struct(F.col("l.rec_texts").alias("text"), F.col("box").alias("box")))
    parts = F.when(F.coalesce(by_word, F.lit(False)), words).otherwise(whole)
    parts = F.transform(parts, lambda s: F.struct(s["text"].alias("text"), s["box"].alias("box"), F.col("confidence").alias("confidence")))
    ok = F.coalesce(by_word, F.lit(False)) | F.col("box").isNotNull()
    return lines.filter(F.col("l.rec_polys").isNotNull()).select("image_id", "line", parts.alias("parts"), ok.alias("ok"))


def polygon_segments(results: DataFrame) -> DataFrame:
    """Segments of results with parallel arrays of texts, scores and polygons, and perhaps words with regions.

    results: image_id, width, height, rec_texts, rec_scores, rec_polys (arrays of
    [x, y]; the detector's dt_polys where they are null and that column is there), text_word,
    text_word_region. A line whose words and regions are equally many gives a segment for each
    word that isn't blank; with a bad region among them, and otherwise, the line is one
    segment. A line without polygon is left out; an image with a polygon that can't be read
    gives no segments at all, see polygon_errors().
    """
    lines = _polygon_lines(results)
    # Whether all of an image's lines are right is asked in the window that numbers them anyway.
    lines = lines.withColumn("whole", F.min("ok").over(Window.partitionBy("image_id"))).filter("whole")
    rows = lines.select("image_id", "line", F.posexplode("parts").alias("word", "s")).select("image_id", "line", "word", "s.text", "s.box", "s.confidence")
    return _numbered(rows.filter(F.col("box").isNotNull() & ~blank(F.coalesce("text", F.lit("")))), "line", "word")


def polygon_errors(results: DataFrame) -> DataFrame:
    """(image_id, code, message) of images with a polygon that can't be read."""
    bad = _polygon_lines(results).groupBy("image_id").agg(F.min("ok").alias("ok")).filter("NOT ok")
    return bad.select("image_id", F.lit("OCR_FAILED").alias("code"), F.lit("malformed polygon").alias("message"))


def _quad_lines(results: DataFrame) -> DataFrame:
    """Each line of nested results with what could be read of it; ok tells whether it is a polygon with a text."""
    lines = F.from_json("body", "array<string>")
    # Some results have the lines of the only page in a list of their own.
    inner = F.from_json(F.get(lines, F.lit(0)), "array<string>")
    nested = (F.size(lines) == 1) & F.get(inner, F.lit(0)).startswith("[[") & F.from_json(F.get(inner, F.lit(0)), "array<array<double>>").isNull()
    rows = results.select("image_id", "width", "height", F.posexplode_outer(F.when(F.coalesce(nested, F.lit(False)), inner).otherwise(lines)).alias("line", "l")).filter("l IS NOT NULL AND l <> 'null'")
    pair = F.from_json("l", "array<string>")
    read = rows.select("image_id", "width", "height", "line", F.from_json(F.get(pair, F.lit(0)), "array<array<double>>").alias("poly"), F.from_json(F.get(pair, F.lit(1)), "array<string>").alias("t"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    read = read.withColumn("box", quad_to_box(F.transform("poly", point), F.col("width"), F.col("height"))).withColumn("text", F.get("t", F.lit(0)))
    return read.select("image_id", "line", "text", "box", confidence(F.get("t", F.lit(1))).alias("confidence"), (F.col("box").isNotNull() & F.col("text").isNotNull()).alias("ok"))


def quad_segments(results: DataFrame) -> DataFrame:
    """Segments of results (image_id, width, height, body JSON) of lines [polygon, [text, score]].

    Null lines are skipped. An image with a line of another shape gives no segments; see quad_errors().
    """
    lines = _quad_lines(results)
    whole = lines.groupBy("image_id").agg(F.min("ok").alias("ok")).filter("ok").select("image_id")
    good = lines.join(whole, "image_id", "left_semi").filter(~blank(F.coalesce("text", F.lit(""))))
    return _numbered(good, "line")


def quad_errors(results: DataFrame) -> DataFrame:
    """(image_id, code, message) of images with a line that can't be read."""
    bad = _quad_lines(results).groupBy("image_id").agg(F.min("ok").alias("ok")).filter("NOT ok")
    return bad.select("image_id", F.lit("OCR_FAILED").alias("code"), F.lit("malformed line").alias("message"))
