"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

Counts. Training tokens are counted by word with partial sums in each task. The
most frequent ``KNOWN`` words are broadcast with their counts (a fixed bound);
what a text has beyond them, each word once, is joined with the written table of all
counts by word. Both sides are plain shuffles, so adaptive execution splits a word that
many texts hold although it is none of the most frequent.

Model. Latent states emit classes: each of the ``KNOWN`` most frequent words, the
end among them, is a class; other words share ``SHARED`` classes by hash. A word
beyond those has the chance (c + 0.5) / (n + 0.5 (v + 1)) within its
class, n and v being the tokens and distinct words of that class in training; the
last 0.5 is for words never seen. So the score is a proper probability, and
needs no table that grows with the vocabulary.

Training. A segment that begins a text begins with the start chances and counts for
them; one from the middle of a text begins with the stationary ones of the moves, and
doesn't. The first estimate comes from ``BURN_IN`` segments (a bounded sample).
``PASSES`` passes of Baum-Welch follow over the segments of ``SEGMENT`` tokens of
all training texts; each task adds up its expected counts, which are summed by
class and read once a pass: a table of fixed size. What a class of few tokens says of the
states is drawn to their overall shares, as if by ``EVIDENCE`` tokens more.

Scores. The forward recursion, scaled at each token, runs over whole texts of any
length, many texts abreast.

Defined results: a null or empty text is the end alone. Without training tokens
every state emits alike, the base score takes N = V = 0. A null doc_id counts as
an empty text for the hash. Repeated rows are counted and scored as rows; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, slices, smallest, table, written

#: Words at most with a class of their own, whose counts are broadcast, and classes shared by the other words: 16 bits hold a class.
KNOWN = OWN = 63_488
SHARED = 2_048
CLASSES = OWN + SHARED
STATES, SEGMENT, BURN_IN, BURNS, PASSES = 8, 64, 3_000, 25, 2
#: Weight of the overall class shares in each state's emissions, and of even moves in the transitions.
PRIOR, EVEN = 200.0, 5.0
#: Tokens by which a class's expected counts are drawn to the overall shares of the states.
EVIDENCE = 2.0
#: Distinct words that a task holds before it hands its partial counts on.
HELD = 200_000
#: The end of a text: no word, as words have no white space.
END = b"\n"


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of(text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What is known of words: totals, the frequent words, and the shared classes."""

    n: int
    v: int
    words: list[bytes]
    counts: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        self.log_counts = np.log10(self.counts + 0.5)
        self.log_all = np.log10(self.n + 0.5 * (self.v + 1))
        # What a word of a shared class is divided by; an own class is its word.
        self.log_class = np.concatenate([np.zeros(OWN), np.log10(self.class_n + 0.5 * (self.class_v + 1))])

    def shares(self) -> np.ndarray:
        """The share of each class in the training tokens, smoothed so that none is nil."""
        own = np.zeros(OWN)
        own[: len(self.counts)] = self.counts
        out = np.concatenate([own, self.class_n]) + np.concatenate([np.where(np.arange(OWN) < max(1, len(self.words)), 0.5, 1e-6), np.full(SHARED, 0.5)])
        return out / out.sum()


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word) % SHARED


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals and frequent words of a written table of counts: KNOWN rows and SHARED rows come to the driver."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # By bands of counts (some hundreds) the least count is found above which there are KNOWN words at most; only those are collected.
    band = F.floor(F.log2(F.col("c").cast("double")) * 8)
    bands = sorted(((r["band"], r["n"]) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()), reverse=True)
    words, least = 0, None
    for b, n in bands:
        if words + n > KNOWN:
            break
        words, least = words + n, b
    top = counts.filter(band >= least).collect() if least is not None else []
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    own = counts.sparkSession.createDataFrame([(r["word"],) for r in top], "word binary")
    rest = counts.join(F.broadcast(own), "word", "left_anti").groupBy((F.crc32("word") % SHARED).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(SHARED), np.zeros(SHARED)
    for r in rest:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    return Vocabulary(total["n"], total["v"], [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.float64), class_n, class_v)


def sequences(docs: DataFrame, words: Vocabulary, train: Column) -> DataFrame:
    """Each row of docs with its classes, what frequent words add to its scores, and its other words."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(words)
    rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                out: dict[str, list] = {k: [] for k in ("row_id", "n_tokens", "n_known", "base", "within", "classes", "rare")}
                for text in part.column("text").to_pylist():
                    tokens = tokens_of(text)
                    ids = np.fromiter(map(own.index.get, tokens, repeat(-1)), np.int64, len(tokens))
                    frequent = ids >= 0
                    seen = ids[frequent]
                    classes = np.empty(len(ids), np.uint16)
                    classes[frequent] = seen
                    others: Counter[bytes] = Counter()
                    if len(seen) < len(ids):
                        rest = [tokens[i] for i in np.flatnonzero(~frequent)]
                        classes[~frequent] = np.fromiter(map(shared_class, rest), np.uint16, len(rest))
                        others.update(rest)
                    out["row_id"].append(number)
                    out["n_tokens"].append(len(ids))
                    out["n_known"].append(len(seen))
                    out["base"].append(float(own.log_counts[seen].sum() - len(ids) * own.log_all))
                    out["within"].append(float(-own.log_class[classes].sum()))
                    out["classes"].append(classes.tobytes())
                    out["rare"].append([{"word": w, "n": n} for w, n in others.items()])
                    number += 1
                kinds = {"row_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "within": pa.float64(), "classes": pa.binary(), "rare": rare}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(out[k], kind) for k, kind in kinds.items())], names=["doc_id", "train", *kinds])

    return source.mapInArrow(run, "doc_id long, train boolean, row_id long, n_tokens long, n_known long, base double, within double, classes binary, rare array<struct<word:binary,n:bigint>>")


class Model:
    """Start, transition and emission chances; emissions by class and state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(17))
        emit = shares[:, None] * rng.gamma(4.0, 0.25, (len(shares), STATES))
        move = np.full((STATES, STATES), 0.4 / (STATES - 1)) + np.eye(STATES) * (0.6 - 0.4 / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def stationary(self, turns: int = 64) -> np.ndarray:
        """The share of each state far from any start."""
        share = self.start
        for _ in range(turns):
            share = share @ self.move
        return share / share.sum()

    def expected(self, segments: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions over segments (rows of classes, lengths of them count); first: where one begins a text."""
        n, longest = segments.shape
        live = np.arange(longest) < lengths[:, None]
        b = np.ascontiguousarray(self.emit[segments].transpose(1, 0, 2))
        forward, scale = np.empty_like(b), np.empty((longest, n))
        begin = np.where(first[:, None], self.start, self.stationary())
        for t in range(longest):
            a = b[t] * begin if t == 0 else (forward[t - 1] @ self.move) * b[t]
            scale[t] = a.sum(axis=1)
            forward[t] = a / scale[t, :, None]
        backward = np.ones((n, STATES))
        moves = np.zeros((STATES, STATES))
        gamma = np.empty_like(b)
        for t in range(longest - 1, -1, -1):
            gamma[t] = forward[t] * backward * live[:, t, None]
            if t:
                ahead = b[t] * backward / scale[t, :, None]
                moves += forward[t - 1].T @ (ahead * live[:, t, None])
                backward = np.where(live[:, t, None], ahead @ self.move.T, 1.0)
        moves *= self.move
        flat = segments.T.ravel()
        emits = np.stack([np.bincount(flat, gamma[:, :, k].ravel(), CLASSES) for k in range(STATES)], axis=1)
        return gamma[0][first].sum(axis=0), moves, emits

    @classmethod
    def estimated(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Model:
        start = (starts + 1) / (starts.sum() + STATES)
        move = (moves + EVEN / STATES) / (moves.sum(axis=1, keepdims=True) + EVEN)
        total = emits.sum(axis=1, keepdims=True)
        emits = total * (emits + EVIDENCE * emits.sum(axis=0) / max(total.sum(), 1.0)) / (total + EVIDENCE)
        emit = (emits + PRIOR * shares[:, None]) / (emits.sum(axis=0) + PRIOR)
        return cls(start, move, emit)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the chance of each whole sequence of classes, by the scaled forward recursion."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        total = np.zeros(len(texts))
        alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # texts longer than t
        state = None
        for t, n in enumerate(alive):
            b = self.emit[flat[begin[:n] + t]]
            state = b * self.start if state is None else (state[:n] @ self.move) * b
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(texts))
        out[order] = total
        return out


def segmented(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut to segments of SEGMENT classes at most, one a row, their lengths, and which begin a text."""
    rows, lengths, first = [], [], []
    for raw in classes:
        own = np.frombuffer(raw, np.uint16).astype(np.int64)
        n = -(-len(own) // SEGMENT)
        rows.append(np.concatenate([own, np.zeros(n * SEGMENT - len(own), np.int64)]).reshape(n, SEGMENT))
        lengths.append(np.minimum(SEGMENT, len(own) - SEGMENT * np.arange(n)))
        first.append(np.arange(n) == 0)
    return np.concatenate(rows), np.concatenate(lengths), np.concatenate(first)


def trained(rows: DataFrame, words: Vocabulary) -> Model:
    """A model from the rows of sequences() that are for training."""
    own = rows.filter("train").select("row_id", "classes")
    shares = words.shares()
    model = Model.first(shares)
    if words.n == 0:
        return model
    # One segment from somewhere in each of a bounded number of texts, by smallest hash.
    h = F.xxhash64("row_id")
    pieces = F.ceil(F.octet_length("classes") / (2 * SEGMENT)).cast("long")
    number = F.pmod(h, pieces)
    piece = F.substring(F.col("classes"), (number * (2 * SEGMENT) + 1).cast("int"), F.lit(2 * SEGMENT))
    drawn = own.select(h.alias("h"), piece.alias("piece"), (number == 0).alias("begins")).transform(smallest, "h", BURN_IN, "piece").collect()
    segments, lengths, _ = segmented([bytes(r["piece"]) for r in drawn])
    begins = np.array([r["begins"] for r in drawn], bool)
    for _ in range(BURNS):
        model = Model.estimated(*model.expected(segments, lengths, begins), shares)
    for _ in range(PASSES):
        held = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            now = held.value
            starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
            for batch in batches:
                for part in slices(batch, "classes", 1 << 19):
                    segments, lengths, first = segmented(part.column("classes").to_pylist())
                    for i in range(0, len(segments), 2048):
                        s, m, e = now.expected(segments[i : i + 2048], lengths[i : i + 2048], first[i : i + 2048])
                        starts += s
                        moves += m
                        emits += e
            used = np.flatnonzero(emits.any(axis=1))
            keys = np.concatenate([used, CLASSES + np.arange(STATES + 1)])
            values = np.concatenate([emits[used], moves, starts[None]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(STATES))], names=["k", *(f"s{k}" for k in range(STATES))])

        sums = own.select("classes").mapInArrow(run, "k long, " + ", ".join(f"s{k} float" for k in range(STATES)))
        found = sums.groupBy("k").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).collect()
        counts = np.zeros((CLASSES + STATES + 1, STATES))
        for r in found:
            counts[r["k"]] = r[1:]
        model = Model.estimated(counts[-1], counts[CLASSES:-1], counts[:CLASSES], shares)
        held.unpersist()
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows of sequences() with chain: log10 of the chance of the classes."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select("row_id", "doc_id", "train", "n_tokens", "n_known", "base", "within", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in slices(batch, "classes", 16 << 20):
                chain = own.log10([np.frombuffer(c, np.uint16) for c in part.column("classes").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(chain)], names=[*part.schema.names[:-1], "chain"])

    return source.mapInArrow(run, "row_id long, doc_id long, train boolean, n_tokens long, n_known long, base double, within double, chain double")


def language_model(docs: DataFrame, train: Column) -> DataFrame:
    """Each row of docs with its scores under the counts and the model learned from the rows where train holds."""
    train = F.coalesce(train, F.lit(False))
    counts = written(word_counts(docs.filter(train)), "counts")
    words = vocabulary(counts)
    rows = written(sequences(docs, words, train), "sequences")
    model = trained(rows, words)
    rare = rows.select("row_id", F.explode("rare").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    seen = rare.join(counts, "word", "left").groupBy("row_id").agg(
        F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("log_rare"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    log_rare = F.coalesce(F.col("log_rare"), F.lit(0.0))
    return scored(rows, model).join(seen, "row_id", "left").select(
        "doc_id",
        F.col("train"),
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("rare_known"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + log_rare).alias("base_score"),
        (F.col("chain") + F.col("within") + log_rare).alias("score"),
    )


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_model(docs, id_bucket("doc_id") != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
