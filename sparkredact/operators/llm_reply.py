"""Prompts to, and replies from, a language model that classifies the segments of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import blank
from .layers import known_only


def prompts(segments: DataFrame) -> DataFrame:
    """(image_id, num_segments, prompt) for pages that aren't all blank: each segment with its number on a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = segments.select("image_id", F.struct("seg_idx", text.alias("text")).alias("s"), (~blank(text)).alias("some"))
    # A page's segments are one image's: a group is bounded by what fits on a page.
    pages = rows.groupBy("image_id").agg(F.sort_array(F.collect_list("s")).alias("segments"), F.max("some").alias("some"), F.count("*").cast("int").alias("num_segments")).filter("some")
    lines = F.transform("segments", lambda s: F.concat(F.lit("["), s["seg_idx"].cast("string"), F.lit("] "), s["text"]))
    return pages.select("image_id", "num_segments", F.concat(F.lit("Segments:\n"), F.array_join(lines, "\n")).alias("prompt"))


def _object(text: Column) -> Column:
    """text as a JSON object of strings; null where it isn't one."""
    return F.when(F.trim(text).rlike(r"^\{[\s\S]*\}$"), F.from_json(F.trim(text), "map<string,string>", {"mode": "PERMISSIVE"}))


def reply_object(content: Column) -> Column:
    """The object of a reply: the whole, or what is in a code fence, or from the first brace to the last."""
    fences = F.transform(F.split(content, "```"), lambda c: _object(F.regexp_replace(F.trim(c), r"^\s*json\s*", "")))
    first = F.get(F.filter(fences, lambda m: m.isNotNull()), F.lit(0))
    return F.coalesce(_object(content), F.when(content.contains("```"), first), _object(F.regexp_extract(content, r"\{[\s\S]*\}", 0)))


def reply_entries(content: Column, num_segments: Column) -> Column:
    """The array of (seg_idx, categories) of a reply.

    Keys must be numbers of segments and values lists; others are left out alone. Of keys with the same number the last counts.
    """
    entries = F.coalesce(F.map_entries(reply_object(content)), F.array().cast("array<struct<key:string,value:string>>"))

    def read(e: Column) -> Column:
        labels = F.transform(F.from_json(e["value"], "array<string>"), lambda x: F.lower(F.trim(x)))
        return F.struct(F.trim(e["key"]).try_cast("int").alias("seg_idx"), F.when(F.trim(e["value"]).startswith("["), known_only(labels)).alias("categories"))

    good = F.filter(F.transform(entries, read), lambda r: (r["seg_idx"] >= 0) & (r["seg_idx"] < num_segments) & r["categories"].isNotNull() & (F.size(r["categories"]) > 0))
    # The later of two entries with a number is the one that no other follows.
    return F.filter(good, lambda r, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda other: other["seg_idx"] == r["seg_idx"]))


def reply_categories(replies: DataFrame) -> DataFrame:
    """(image_id, seg_idx, categories) of replies (image_id, num_segments, content)."""
    return replies.select("image_id", F.inline(reply_entries(F.col("content"), F.col("num_segments"))))
