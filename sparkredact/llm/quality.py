"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text: hashed words, hashed word shapes (case, digits, punctuation)
and bands of text statistics (share of distinct words, of words that repeat the
one before, of capitals, of symbols). Log counts weighted by inverse document frequency are
projected on the leading right singular vectors of the labelled sample. The
labelled vectors are broadcast - at most ``LABELLED`` of ``DIMENSIONS`` numbers,
the documented bound of the sample - and every document is compared with all
of them in blocks of exact cosine products. The ``NEIGHBOURS`` nearest vote with
their label, weighted by a power of the similarity.

Only labelled rows with crc32(doc_id as text) modulo 5 other than 0 are
learned from, those with the smallest hash where there are more than the bound.
Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text has one term of its own and is scored like
others; a text without similar neighbours, or any text when nothing is
labelled, scores the mean label (0.5 without labels). Where labels repeat a
doc_id, the smallest quality counts; null qualities don't. Of voters that are equally
near those count that come first in the sample's order. Equal texts score equally,
whatever stands beside them in a block: latent vectors are rounded to whole numbers
(``STEPS`` to a unit), whose products are exact in any order. Repeated rows give repeated rows; other columns are ignored by score()
and kept by keep_good(); an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, slices, smallest, table

#: Labelled vectors at most, latent dimensions, voters, the power of their similarity, and the least score of a good text.
LABELLED, DIMENSIONS, NEIGHBOURS, POWER, GOOD = 4000, 48, 25, 4, 0.3
#: Whole steps of a latent vector's length: their products stay below 2 ** 24, so that single precision holds them exactly.
STEPS = 4000
#: Hashed terms: words, word shapes, text statistics.
WORDS, SHAPES, BANDS = 1024, 512, 64
TERMS = WORDS + SHAPES + BANDS
_REMEMBERED = 100_000
_RUNS = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        made = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return made


_KINDS = _Kinds()


class _WordTerms(dict):
    """Of each word, packed in one number: two flags (capitals, symbols), its shape's term, its own term."""

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        shape = _RUNS.sub(r"\1", word.translate(_KINDS))
        core = word.strip(".,;:'\"!?()").lower()
        flags = ("A" in shape and "a" not in shape and len(word) > 1) + 2 * any(c not in "Aa9.,;:'\"-!?()" for c in shape)
        made = self[word] = (flags * SHAPES + zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES) * WORDS + zlib.crc32(core.encode("utf-8", "replace")) % WORDS
        return made


_TERMS = _WordTerms()


def _bands(n: int, distinct: int, repeats: int, capitals: int, symbols: int) -> list[int]:
    """Terms of the statistics of a text of n words."""
    shares = [int(8 * min(1.0, distinct / n**0.8)), int(10 * repeats / n), int(10 * capitals / n), int(10 * symbols / n), min(9, n.bit_length() // 2)]
    return [WORDS + SHAPES + 12 * i + s for i, s in enumerate(shares)]


def counts(texts: list[str]) -> np.ndarray:
    """Term counts of each text; a statistic counts like a twelfth of the words, and as three words at least."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        if not words:
            row[TERMS - 1] = 1
            continue
        n = len(words)
        found = np.fromiter(map(_TERMS.__getitem__, words), np.int64, n)
        row[:WORDS] = np.bincount(found % WORDS, minlength=WORDS)
        kinds = np.bincount(found // WORDS, minlength=4 * SHAPES).reshape(4, SHAPES)
        row[WORDS : WORDS + SHAPES] = kinds.sum(axis=0)
        capitals, symbols = int(kinds[1].sum() + kinds[3].sum()), int(kinds[2:].sum())
        repeats = sum(map(str.__eq__, words, words[1:]))
        row[_bands(n, len(set(words)), repeats, capitals, symbols)] = max(3, n / 12)
    return out


def _leading(rows: np.ndarray, dimensions: int, turns: int = 12) -> np.ndarray:
    """The leading right singular vectors of rows, by subspace iteration on the terms' Gram matrix."""
    gram = (rows.T @ rows).astype(np.float64)
    own = np.random.Generator(np.random.PCG64(3)).standard_normal((gram.shape[0], dimensions + 8))
    for _ in range(turns):
        own, _ = np.linalg.qr(gram @ own)
    return np.ascontiguousarray(own[:, :dimensions])


class Voters:
    """Labelled latent vectors and the projection that made them."""

    def __init__(self, rows: np.ndarray, labels: list[int]):
        """rows: the counts() of the labelled texts."""
        self.mean = float(np.mean(labels)) if labels else 0.5
        if not labels:
            return
        self.labels = np.array(labels, np.float64)
        rows = np.log1p(rows)
        self.weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
        rows *= self.weight
        self.basis = _leading(self._unit(rows), DIMENSIONS)
        self.vectors = np.concatenate([self.latent(rows[i : i + 512]) for i in range(0, len(rows), 512)])

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.linalg.norm(rows, axis=1, keepdims=True).clip(1e-12)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        """The latent vectors of weighted rows, in whole steps."""
        return np.rint(self._unit(rows.astype(np.float64) @ self.basis) * STEPS).astype(np.float32)

    def score(self, texts: list[str], block: int = 256) -> list[float]:
        """The voted label of each text, 0 to 1."""
        if not hasattr(self, "vectors"):
            return [self.mean] * len(texts)
        out: list[float] = []
        for start in range(0, len(texts), block):
            rows = np.log1p(counts(texts[start : start + block])) * self.weight
            near = self.latent(rows) @ self.vectors.T
            # One number for nearness and place in the sample, so that there are no ties.
            n = near.shape[1]
            near = near.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            top = -np.sort(-np.partition(near, n - min(NEIGHBOURS, n), axis=1)[:, -NEIGHBOURS:], axis=1)
            at = n - 1 - top % n
            weight = (top // n / STEPS**2).clip(0) ** POWER
            total = weight.sum(axis=1)
            voted = (weight * self.labels[at]).sum(axis=1) / total.clip(1e-300)
            out += np.where(total > 0, voted, self.mean).clip(0, 1).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Voters:
    """Voters from the labelled documents that aren't held out, bound at most."""
    good = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).filter(id_bucket("doc_id") != 0)
    # The bound is applied to the labels first: so few ids fit a broadcast, and no text but the sample's is moved.
    chosen = good.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = smallest(chosen, "h", bound, "doc_id")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("h", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("quality"), pa.array([r.tobytes() for r in own], pa.binary())], names=["h", "quality", "counts"])

    found = rows.mapInArrow(run, "h long, quality int, counts binary").orderBy("h", "counts").limit(bound).toLocalIterator()
    labels_of, vectors = [], []
    for row in found:
        labels_of.append(row["quality"])
        vectors.append(np.frombuffer(row["counts"], np.float32))
    return Voters(np.array(vectors, np.float32).reshape(-1, TERMS), labels_of)


def score(docs: DataFrame, voters: Voters, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep, with the score of text."""
    keep = ["doc_id"] if keep is None else keep
    return _scored(docs, voters, keep).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


def _scored(docs: DataFrame, voters: Voters, keep: list[str]) -> DataFrame:
    source = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(voters)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in slices(batch):
                made = pa.array(own.score([t or "" for t in part.column("text").to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), made], names=[*part.schema.names[:-1], "score"])

    return source.mapInArrow(run, f"{kept}score double")


def keep_good(docs: DataFrame, voters: Voters, least: float = GOOD) -> DataFrame:
    """docs without the documents that score under least; the others stay as they are."""
    found = _scored(docs, voters, docs.columns).filter(F.col("score") >= least)
    return found.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(docs.columns)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_bucket("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
