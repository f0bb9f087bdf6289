"""Benchmark decontamination: a broadcast hash set of test n-grams against every document's token windows.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
ASCII. A window is ``WINDOW`` consecutive words of a benchmark item; an item of
fewer words is one window. Documents are scanned with a rolling hash over word
numbers; what the hash set finds is verified word by word, so a hash collision
never counts.

The hash set is broadcast only in blocks of at most ``BLOCK_WORDS`` benchmark
words: a larger benchmark takes one narrow pass over the documents for each
block, each adding to the hits so far. A pass but the last is written to the shared
folder and its broadcast released before the next, so that one block at a time is
held, however large the benchmark is. Nothing is shuffled, and no block is left out.

Defined results: null or word-less text has no words, no hits and isn't
contaminated; null or word-less items have no window; items with the same
item_id count once, and items without item_id count for hits but not as items;
repeated documents give repeated rows; other columns are ignored by find() and
kept by keep_clean() and cut_spans(); empty tables give empty results, and
with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, table, written

WINDOW = 13
#: Benchmark words in one broadcast block; a block takes some 200 bytes a word at most.
BLOCK_WORDS = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of length numbers."""
    n = len(ids) - length + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out *= _PRIME
            out += ids[j : j + n]
    return out


class Windows:
    """The windows of some benchmark items, found by hash and verified by their words."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, words in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if ids else 0):
                by_length.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.lengths = {}
        for n, found in by_length.items():
            grams = np.array(list(found), np.uint64)
            hashes = np.concatenate([rolling(g, n) for g in grams])
            order = np.argsort(hashes, kind="stable")
            owners = list(found.values())
            self.lengths[n] = hashes[order], grams[order], [sorted(x for x in owners[i] if x is not None) for i in order]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with windows here."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint64, len(words))
        known = ids > 0
        runs = np.concatenate([[0], np.cumsum(known)])
        for n, (hashes, grams, owners) in self.lengths.items():
            if n > len(ids):
                continue
            at = np.flatnonzero(runs[n:] - runs[:-n] == n)
            if not len(at):
                continue
            own = rolling(ids, n)[at]
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for k in np.flatnonzero(lo < hi):
                for g in range(lo[k], hi[k]):
                    if np.array_equal(grams[g], ids[at[k] : at[k] + n]):
                        hit[at[k] : at[k] + n] = True
                        items.update(owners[g])
        return hit, items


def spans_of(hit: np.ndarray) -> list[int]:
    """Start, end, start, end of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))).tolist()


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The benchmark's items in blocks of bounded size, streamed through the driver one partition at a time.

    An item longer than a block is cut into pieces that overlap by a window less one word.
    """
    block, total = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        step = max(1, block_words - WINDOW + 1)
        for start in range(0, max(len(words) - WINDOW + 1, 1), step) if words else ():
            piece = words[start : start + block_words]
            if total and total + len(piece) > block_words:
                yield block
                block, total = [], 0
            block.append((row["item_id"], piece))
            total += len(piece)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns in keep, with n_words, hit_spans (word positions: start, end, ...) and item_ids."""
    keep = ["doc_id"] if keep is None else keep
    return _scan(docs, benchmark, keep, block_words).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


def _scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """find() with the kept columns named k0, k1 and so on, which clash with nothing."""
    spark = docs.sparkSession
    source = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").cast("string").alias("text"))
    kept = source.schema.fields[:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    head = fields + ", " if fields else ""
    out = source.withColumns({"n_words": F.lit(0), "hit_spans": F.lit([]).cast("array<int>"), "item_ids": F.lit([]).cast("array<bigint>")})

    def scanned(rows: DataFrame, windows, last: bool) -> DataFrame:
        """rows with what one block adds; each pass but the last hands the text on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = windows.value
            for batch in batches:
                for part in slices(batch):
                    counts, spans, items = [], [], []
                    for text, old_spans, old_items in zip(part.column("text").to_pylist(), part.column("hit_spans").to_pylist(), part.column("item_ids").to_pylist(), strict=True):
                        words = words_of(text)
                        hit, found = own.scan(words)
                        for s, e in zip(old_spans[::2], old_spans[1::2], strict=True):
                            hit[s:e] = True
                        counts.append(len(words))
                        spans.append(spans_of(hit))
                        items.append(sorted(found.union(old_items)))
                    made = [pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
                    n = len(kept) if last else len(kept) + 1
                    names = [*part.schema.names[:n], "n_words", "hit_spans", "item_ids"]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *made], names=names)

        return rows.mapInArrow(run, f"{head}{'' if last else 'text string, '}n_words int, hit_spans array<int>, item_ids array<bigint>")

    before, waiting = None, []  # without any window only the words are counted
    for block in blocks(benchmark, block_words):
        if waiting:
            held = spark.sparkContext.broadcast(Windows(waiting))
            out = written(scanned(out, held, False), "decontam")
            held.destroy()
            if before is not None:
                discard(before)
            before = out
        waiting = block
    return scanned(out, spark.sparkContext.broadcast(Windows(waiting)), True)


def n_hit() -> Column:
    """The number of hit words of a row of find()."""
    # start, end, start, end: the fold x - total ends with the sum of end - start
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, x: x - total)


def is_contaminated(words: Column, hits: Column) -> Column:
    return (hits > 0) & (20 * hits >= words)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; the others and all their columns stay as they are."""
    found = _scan(docs, benchmark, docs.columns).filter(~is_contaminated(F.col("n_words").cast("long"), n_hit()))
    return found.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(docs.columns)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rows = found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
    )
    return rows.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


#: The same by joining every window of the documents with the items' windows.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
hits AS (SELECT r, i, s.n, item_id FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) s JOIN win ON win.n = s.n AND win.g = array_to_string(s.w[i : i + s.n - 1], ' ')),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
