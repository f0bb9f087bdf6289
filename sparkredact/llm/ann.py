"""Nearest neighbours by inner product over balanced posting lists.

Equal vectors are one entry with their smallest ids (one more than an answer
is long, which is all that any answer can hold), so a vector that a third of the
rows share is one entry, and one query.

Index. Centroids come from a bounded sample (``SAMPLE``): k-means, then clusters
that are too large are halved and tiny ones dissolved. Inner products become
distances by one more coordinate, which fills every vector up to the largest
norm. Every entry goes to its nearest centroid and, at a boundary, to up to
``REPLICAS`` others: those not much farther and not hidden behind a nearer chosen one.
Queries search the centroids' neighbour graph best-first and take all lists
whose distance is within ``RATIO`` of the best. Lists longer than ``LIST`` are
dealt out in pieces, queries of a list in pieces of ``ASKED``; a task holds one
piece of each and computes exact products in double precision. The ``AHEAD``
nearest lists of a query are read first; of the others only what reaches the
last place of their answers is returned, so a query makes few rows however
many lists it reads.

The scores returned are exact; which vectors are found is approximate.
``brute_force`` computes exact answers in blocks, and tests hold recall against it.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite numbers take no part, as queries neither; a null vec_id
takes no part. Repeated ids with equal vectors count once; with different
vectors each vector is a candidate, and the better one counts. Ties go to the
smaller id. With fewer candidates than asked for all are returned. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import smallest, table, written

#: Sample rows and centroids at most; entries wanted in a list, and in a piece of one at most.
SAMPLE, CENTROIDS, WANTED, LIST, ASKED = 40_000, 4_096, 250, 2_000, 1_000
#: Lists an entry may be in, how much farther than the nearest they may be, and how near to each other (share of a squared distance).
REPLICAS, NEAR, APART = 3, 1.05, 0.05
#: How much farther than its nearest list the lists that a query reads may be. On vectors without structure, whose lists are
#: all about as far, that is many; on clustered ones few.
RATIO = 1.14
#: Nearest lists of a query that are read first; their answers bound what the others need to return.
AHEAD = 4
#: Neighbours in the centroids' graph, random links besides, and the breadth at which a search goes on regardless of the ratio.
LINKS, SHORTCUTS, BREADTH = 16, 4, 32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter(finite & F.exists("embedding", lambda v: v != 0))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (length["d"] if length else 0))


class Centroids:
    """The centroids, their neighbour graph, and the largest norm, at which vectors are lifted."""

    def __init__(self, sample: np.ndarray, norm: float, entries: int):
        self.norm = norm
        points = self.lifted(sample)
        wanted = max(1, min(CENTROIDS, len(points), round(entries / WANTED)))
        self.points = _balanced(points, wanted)
        self.squares = (self.points**2).sum(axis=1)
        rng = np.random.default_rng(5)
        n = len(self.points)
        near = [self._near(self.points[i : i + 512], min(LINKS + 1, n)) for i in range(0, n, 512)]
        links = [set(row.tolist()) | set(rng.integers(0, n, SHORTCUTS).tolist()) for row in np.concatenate(near)]
        for a in range(n):  # links go both ways, or a centroid that is nobody's neighbour would not be found
            for b in list(links[a]):
                links[b].add(a)
        self.links = [np.array(sorted(own)) for own in links]
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        # A centroid may be a point of the sample itself: what counts as near is the usual distance at least.
        self.usual = float(np.mean([self._distances(points[i : i + 1024]).min(axis=1).mean() for i in range(0, len(points), 1024)]))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with one more coordinate, so that all have the same norm."""
        left = np.sqrt(np.maximum(self.norm**2 - (rows**2).sum(axis=1), 0))
        return np.concatenate([rows, left[:, None]], axis=1)

    def _distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + self.squares - 2 * rows @ self.points.T, 0))

    def _near(self, rows: np.ndarray, k: int) -> np.ndarray:
        d = self._distances(rows)
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)

    def lists(self, rows: np.ndarray) -> list[list[int]]:
        """The lists of each row: the nearest, and at a boundary others in different directions."""
        rows = self.lifted(rows)
        d = self._distances(rows)
        k = min(2 * REPLICAS, d.shape[1])
        out = []
        for row, near in zip(d, self._near(rows, k), strict=True):
            chosen = [int(near[0])]
            for c in near[1:]:
                if len(chosen) == REPLICAS or row[c] > NEAR * row[near[0]]:
                    break
                if all(((self.points[c] - self.points[o]) ** 2).sum() >= row[c] ** 2 * APART for o in chosen):
                    chosen.append(int(c))
            out.append(chosen)
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, least: int) -> list[int]:
        """The lists to read for a query: best-first over the graph, those within a ratio of the best.

        sizes: entries of which a list is the nearest; where those of the lists found
        are fewer than least, the next nearest lists are read as well.
        """
        scale = self.norm / np.linalg.norm(query)  # a query's own length doesn't change the order
        q = np.append(query * scale, 0.0)

        def distances(at: np.ndarray) -> np.ndarray:
            return ((self.points[at] - q) ** 2).sum(axis=1)

        queue = list(zip(distances(self.starts).tolist(), self.starts.tolist(), strict=True))
        seen = {c: d for d, c in queue}
        heapq.heapify(queue)
        reach = max(min(d for d, _ in queue), self.usual**2) * RATIO**2
        best = heapq.nlargest(BREADTH, (-d for d, _ in queue))  # the nearest so far, the farthest of them first
        heapq.heapify(best)
        while queue:
            d, c = heapq.heappop(queue)
            if d > reach and len(best) >= BREADTH and d > -best[0]:
                break
            fresh = np.array([x for x in self.links[c].tolist() if x not in seen], np.int64)
            if not len(fresh):
                continue
            for e, x in zip(distances(fresh).tolist(), fresh.tolist(), strict=True):
                seen[x] = e
                reach = min(reach, max(e, self.usual**2) * RATIO**2)
                heapq.heappush(queue, (e, x))
                heapq.heappush(best, -e)
                if len(best) > BREADTH:
                    heapq.heappop(best)
        found = [c for d, c in sorted((d, c) for c, d in seen.items()) if d <= reach or d == 0]
        if sizes[found].sum() < least:
            order = np.argsort(distances(np.arange(len(self.points))), kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1
            found = list(dict.fromkeys([*found, *order[:enough].tolist()]))
        return found


def _balanced(points: np.ndarray, wanted: int, turns: int = 8) -> np.ndarray:
    """About as many k-means centroids as wanted, none of which holds far more or far fewer points than the others."""
    rng = np.random.default_rng(9)
    centres = points[np.sort(rng.choice(len(points), wanted, replace=False))].copy()

    def nearest() -> np.ndarray:
        squares = (centres**2).sum(axis=1)
        return np.concatenate([(squares - 2 * points[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(points), 4096)])

    for turn in range(turns):
        own = nearest()
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, k], len(centres)) for k in range(points.shape[1])], axis=1)
        full = sizes > 0
        centres = sums[full] / sizes[full, None]
        if turn in (turns // 2, turns - 3):
            mean = len(points) / wanted
            kept = sizes[full]
            numbers = np.flatnonzero(full)
            parts = [centres[kept >= mean / 6]]
            for c, size in zip(numbers[kept > 2 * mean], kept[kept > 2 * mean], strict=True):
                members = points[own == c]
                new = members[rng.choice(len(members), min(len(members), int(size / mean)), replace=False)]
                parts.append(new)
            centres = np.concatenate(parts)
    return centres if len(centres) else points[:1]


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _listed(rows: DataFrame, index: Centroids, d: int, names: list[str], sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """rows (the columns named, and embedding) once for each of their lists, or with sizes of those to read; nth: the nearest is 0."""
    held = rows.sparkSession.sparkContext.broadcast((index, sizes))  # CENTROIDS rows at most
    source = rows.select(*names, "embedding")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counted = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = rows_of(part.column("embedding"), d)
                lists = own.lists(x) if counted is None else [own.search(q, counted, least) for q in x]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                taken = part.take(pa.array(np.repeat(np.arange(len(lists)), counts)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([c for own_lists in lists for c in own_lists], pa.int32()), pa.array([i for own_lists in lists for i in range(len(own_lists))], pa.int32())], names=[*taken.schema.names, "list", "nth"])

    return source.mapInArrow(run, f"{fields}, list int, nth int")


def best_of(queries: np.ndarray, entries: np.ndarray, first: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, float]]:
    """(query, entry, score) of the k best entries of each query that reach its floor; first: the smallest id of each entry.

    A matrix product finds who can be among them; what is returned is summed for
    each pair alone, in one order, so that equal vectors have equal scores.
    """
    rough = queries @ entries.T
    take = min(k, len(entries))
    least = np.maximum(np.partition(rough, len(entries) - take, axis=1)[:, len(entries) - take], floor)
    least = np.where(np.isfinite(least), least, -np.finfo(float).max)
    slack = 1e-9 * (1 + np.abs(least))
    q, e = np.nonzero(rough >= (least - slack)[:, None])
    scores = np.einsum("ij,ij->i", queries[q], entries[e])
    q, e, scores = (x[scores >= floor[q]] for x in (q, e, scores))
    order = np.lexsort((first[e], -scores, q))
    q, e, scores = q[order], e[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return [(int(a), int(b), float(s)) for a, b, s in zip(q[place < take], e[place < take], scores[place < take], strict=True)]


def _answers(lists: DataFrame, reads: DataFrame, d: int, k: int) -> DataFrame:
    """(asked_id, vec_id, score): of each list read the k + 1 best that reach the query's floor."""
    # Pieces of long lists, and of the queries of a list: each piece of one meets each piece of the other.
    pieces = lists.groupBy("list").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).join(reads.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")), "list")
    pieces = written(pieces, "pieces")
    part = F.pmod(F.xxhash64("embedding"), F.col("parts")).cast("int")
    turn = F.pmod(F.xxhash64("asked_id"), F.col("turns")).cast("int")
    left = lists.join(pieces, "list").select("list", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "ids", "embedding")
    right = reads.join(pieces, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn.alias("turn"), "asked_id", "floor", "embedding")

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if own.num_rows and asking.num_rows:
            ids = own.column("ids").to_pylist()
            x, q = (rows_of(t.column("embedding").combine_chunks(), d) for t in (own, asking))
            names = asking.column("asked_id").to_pylist()
            floor = asking.column("floor").to_numpy()
            first = np.array([r[0] for r in ids])
            for i in range(0, len(q), 256):
                found += [(names[i + a], v, s) for a, b, s in best_of(q[i : i + 256], x, first, k + 1, floor[i : i + 256]) for v in ids[b]]
        return pa.table({"asked_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    keys = ["list", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "asked_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds the k nearest other ids."""
    rows = written(usable(vectors), "vectors")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)).alias("square"), F.max(F.size("embedding")).alias("d")).first()
    if not total["n"]:
        return empty
    d = total["d"]
    # Entries: each distinct vector with its k + 1 smallest ids. The window keeps those of each task before the shuffle.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = written(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    queries = written(asked.groupBy("embedding").agg(F.min("query_id").alias("asked_id")), "queries")
    drawn = smallest(entries.select("embedding", F.xxhash64("embedding").alias("h")), "h", SAMPLE, "embedding").select("embedding")
    sample = rows_of(drawn.toArrow().column("embedding").combine_chunks(), d)
    index = Centroids(sample, math.sqrt(total["square"]), entries.count())
    lists = written(_listed(entries, index, d, ["ids"]), "lists")
    sizes = np.zeros(len(index.points), np.int64)
    for r in lists.filter("nth = 0").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    reads = written(_listed(queries, index, d, ["asked_id"], sizes, k + 1), "reads")
    near = written(_answers(lists, reads.filter(F.col("nth") < AHEAD).withColumn("floor", F.lit(float("-inf"))), d, k), "near")
    by_score = Window.partitionBy("asked_id").orderBy(F.desc("score"), "vec_id")
    last = near.groupBy("asked_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k + 1).select("asked_id", F.col("score").alias("floor"))
    others = reads.filter(F.col("nth") >= AHEAD).join(last, "asked_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = near.unionByName(_answers(lists, others, d, k))
    best = found.groupBy("asked_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    # Every query takes the answers of its vector, without itself.
    own = asked.join(queries, "embedding").select("query_id", "asked_id").join(best.drop("place"), "asked_id").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, queries: list[int], k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Exact answers, for tests and for measuring recall: the queries are positions in ids."""
    order = np.argsort(ids, kind="stable")
    ids_sorted, x = np.array(ids)[order], vectors[order]
    out = {}
    for q in queries:
        scores = np.einsum("ij,ij->i", np.broadcast_to(vectors[q], x.shape), x)
        scores[ids_sorted == ids[q]] = -np.inf
        best = np.argsort(-scores, kind="stable")[:k]
        out[ids[q]] = [(int(ids_sorted[i]), float(scores[i])) for i in best if scores[i] > -np.inf]
    return out


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
