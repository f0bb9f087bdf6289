"""Classifier layers: each gives categories for segments; the result is their union.

A layer is one of three kinds. A row layer is a column over a segment's text, so it
is part of the projection that computes the patterns. A table layer gives rows of
(image_id, seg_idx, categories), which are joined by both. A page layer looks at
whole pages and gives one row for each, which is joined by the image.

Layers that aren't available are skipped. With layers configured but none
available, patterns stand alone. A layer that fails for a segment or page gives
nothing for it; where it is the only one configured, patterns stand alone there
too. Each image of which a segment has only patterns in place of layers carries one
warning.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import STRUCTURED, categories_of, classify, with_flags
from ..functions.lexicon import CATEGORIES

#: Fixed value: the text that consumers of the warning know.
FALLBACK_WARNING = "Classifier_Model was enabled but unavailable at runtime; fell back to pattern-based classification."
KEYS = ("image_id", "seg_idx")


class Layer(ABC):
    """A source of categories; available is asked on the driver, and an error there counts as no."""

    name = "layer"

    @property
    def available(self) -> bool:
        return True

    @abstractmethod
    def categories(self, segments: DataFrame) -> DataFrame:
        """(image_id, seg_idx, categories) for segments; those without may be left out."""


class RowLayer(Layer):
    """A layer that looks at one segment at a time."""

    @abstractmethod
    def outcome(self, text: Column) -> tuple[Column, Column]:
        """The categories of a text, and whether the layer failed there."""

    def categories(self, segments: DataFrame) -> DataFrame:
        return segments.select(*KEYS, known_only(self.outcome(F.col("text"))[0]).alias("categories"))


class PageLayer(Layer):
    """A layer that looks at all segments of a page at once."""

    @abstractmethod
    def pages(self, segments: DataFrame) -> DataFrame:
        """(image_id, found array<struct<seg_idx, categories>>, failed) for pages; those without findings may be left out."""

    def categories(self, segments: DataFrame) -> DataFrame:
        return self.pages(segments).select("image_id", F.inline("found")).select(*KEYS, known_only(F.col("categories")).alias("categories"))


class ColumnLayer(RowLayer):
    """A layer that is a function from the text column to an array of categories."""

    def __init__(self, name: str, make, available: bool = True):
        self.name, self._make, self._available = name, make, available

    @property
    def available(self) -> bool:
        return self._available

    def outcome(self, text: Column) -> tuple[Column, Column]:
        return self._make(text), F.lit(False)


class TableLayer(Layer):
    """Results of a model that ran elsewhere; null as the table means that it wasn't to be had."""

    def __init__(self, name: str, results: DataFrame | None):
        self.name, self._results = name, results

    @property
    def available(self) -> bool:
        return self._results is not None

    def categories(self, segments: DataFrame) -> DataFrame:
        return self._results.select(*KEYS, "categories")


class StructuredLayer(Layer):
    """Cards, addresses, account numbers and wallets after public standards; detect() computes them with the patterns.

    apart: card numbers as the SQL looks for them; see detectors.CARD_APART.
    """

    name = "structured"

    def __init__(self, apart: bool = False):
        self.apart = apart

    def categories(self, segments: DataFrame) -> DataFrame:
        return with_flags(segments.select(*KEYS, "text"), apart=self.apart).select(*KEYS, categories_of("flags", STRUCTURED).alias("categories"))


#: Formats of credentials that their issuers publish, and what they count as.
CREDENTIALS = [
    ("access_token", "glpat-", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_\-]{20,}"),
    ("access_token", "xox", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9\-]{10,}"),
    ("access_token", "npm_", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("access_token", "pypi-", r"(?<![A-Za-z0-9])pypi-AgE[A-Za-z0-9_\-]{50,}"),
    ("access_token", "github_pat_", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,}"),
    ("access_token", ":", r"(?<![0-9])[0-9]{8,10}:[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])"),
    ("api_key", "_live_", r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{24,}"),
    ("api_key", "SG.", r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}(?![A-Za-z0-9_\-])"),
    ("api_key", "-us", r"(?<![A-Za-z0-9])[0-9a-f]{32}-us[0-9]{1,2}(?![0-9])"),
    ("api_key", "SK", r"(?<![A-Za-z0-9])SK[0-9a-f]{32}(?![A-Za-z0-9])"),
    ("api_key", "sq0", r"(?<![A-Za-z0-9])sq0(?:csp|atp)-[A-Za-z0-9_\-]{22,}"),
    ("secret", "AccountKey=", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    ("secret", "-----BEGIN ", r"-----BEGIN (?:DSA|EC|OPENSSH|PGP|RSA|SSH2|ENCRYPTED)? ?PRIVATE KEY(?: BLOCK)?-----"),
    ("secret", "hooks.slack.com/services/", r"hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]{20,}"),
]


class SecretsLayer(RowLayer):
    """Credentials in formats that their issuers publish; each pattern is tried only where its fixed part stands."""

    name = "secrets"

    def outcome(self, text: Column) -> tuple[Column, Column]:
        plain = F.coalesce(text.cast("string"), F.lit(""))
        found = [F.when(plain.contains(part) & plain.rlike(pattern), F.lit(category)) for category, part, pattern in CREDENTIALS]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), F.lit(False)


def is_available(layer: Layer) -> bool:
    try:
        return bool(layer.available)
    except Exception:
        return False


def known_only(categories: Column) -> Column:
    """Sorted distinct known categories; null is none."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(F.coalesce(categories, empty), F.array(*map(F.lit, CATEGORIES))))


def union_of(outputs: list[DataFrame]) -> DataFrame:
    """(image_id, seg_idx, categories): for each segment the union over the layers' outputs.

    Categories are exploded and counted once by partial aggregation, so a segment with many outputs moves few rows.
    """
    rows = outputs[0]
    for other in outputs[1:]:
        rows = rows.unionByName(other)
    rows = rows.select(*KEYS, F.explode(known_only(F.col("categories"))).alias("category")).distinct()
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list("category")).alias("categories"))


def detect(segments: DataFrame, layers: list[Layer] | None = None, use_layers: bool = True) -> DataFrame:
    """segments with categories (sorted, never null) and fallback: layers were configured, but patterns stand alone.

    Patterns and row layers are one projection; only tables and pages are joined.
    """
    wanted = list(layers or []) if use_layers else []
    ready = [x for x in wanted if is_available(x)]
    structured = [x for x in ready if isinstance(x, StructuredLayer)]
    found = classify(segments, structured=bool(structured), apart=bool(structured) and all(x.apart for x in structured))
    names = [*segments.columns, "categories"]
    none = F.array().cast("array<string>")
    failed = F.lit(bool(wanted) and not ready)
    more = []
    for i, x in enumerate(x for x in ready if isinstance(x, RowLayer)):
        categories, failure = x.outcome(F.col("text"))
        found = found.withColumns({f"_row{i}": known_only(categories), f"_failed{i}": failure})
        more.append((F.col(f"_row{i}"), F.col(f"_failed{i}")))
    for i, x in enumerate(x for x in ready if isinstance(x, PageLayer)):
        found = found.join(x.pages(segments).select("image_id", F.col("found").alias(f"_page{i}"), F.col("failed").alias(f"_down{i}")), "image_id", "left")
        own = F.filter(f"_page{i}", lambda r: r["seg_idx"] == F.col("seg_idx"))
        more.append((known_only(F.flatten(F.transform(own, lambda r: F.coalesce(r["categories"], none)))), F.col(f"_down{i}")))
    tables = [x for x in ready if not isinstance(x, (RowLayer, PageLayer, StructuredLayer))]
    if tables:
        model = union_of([x.categories(segments) for x in tables]).withColumnRenamed("categories", "_table")
        found = found.join(model, list(KEYS), "left")
        more.append((F.col("_table"), F.lit(False)))
    if more:
        union = F.flatten(F.array("categories", *(F.coalesce(categories, none) for categories, _ in more)))
        if len(wanted) == 1:
            failed = F.coalesce(more[0][1], F.lit(False))
        found = found.select(*(F.col(f"`{c}`") for c in names[:-1]), F.array_sort(F.array_distinct(union)).alias("categories"), failed.alias("fallback"))
        return found
    return found.withColumn("fallback", failed)


def held(rows: DataFrame) -> DataFrame:
    """rows through a generator, below which filters aren't pushed: pushed into the projection they would have all patterns run twice."""
    return rows.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))


def regions(detected: DataFrame) -> DataFrame:
    """The segments with at least one category."""
    return held(detected).filter(F.size("categories") > 0)


def warnings_of(detected: DataFrame) -> DataFrame:
    """(image_id, warnings): the fallback warning at most once for an image."""
    some = detected.groupBy("image_id").agg(F.max("fallback").alias("fallback"))
    return some.select("image_id", F.when(F.col("fallback"), F.array(F.lit(FALLBACK_WARNING))).otherwise(F.array().cast("array<string>")).alias("warnings"))
