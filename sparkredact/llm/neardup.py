"""Near-duplicates: MinHash signatures in a multi-index Hamming join, links confirmed on full shingle sets.

1. Every text becomes the set of its word shingles (64-bit hashes) and a
   signature: the b-bit symbols of ``chunks * width`` minima. Texts with equal
   sets form one class, which goes on as one row however many copies it has.
2. Multi-index: a signature is cut into ``chunks`` chunks of ``width`` symbols.
   For every way to leave out ``errors`` symbols of a chunk the remaining ones
   are a key. Two signatures with at most ``errors`` errors in some chunk share a
   key; by the pigeonhole principle that holds for all pairs of distance
   ``chunks * (errors + 1) - 1`` or less, which is the distance of the join: every
   pair within it has a common key. plan() takes so many chunks that the signatures
   of a pair exactly at the similarity threshold are further apart with a chance
   under ``MISSED`` only, that of MinHash itself.
3. Each node is paired with two of its keys' hubs, a key's hub being its smallest
   node, so that pairs grow with the nodes and not with the square of a group. A
   key's rows carry a sketch, the lowest bit of each symbol: pairs whose sizes or
   sketches are too far apart for the threshold are dropped in the JVM, those whose
   signatures are after that; the rest are confirmed on the full sets of both texts.
4. Keys whose members are of one component by then need no further look. The
   others are gathered into families (nodes that share such keys), where only
   members of different components are compared:

   * The members of a family of at most ``FAMILY`` are paired, as in 3.
   * A larger one is compared as a whole in blocks, where that is not too much more
     than its keys hold (``WORTH``): a task has two blocks, filters by sizes, sketches
     and signatures in arrays, confirms on the full sets, and emits only the links that
     join two components. So no pair is ever a row. The number of blocks, so of copies of a
     text, grows with the square root of the family, and so does a task; a block has some
     ``BLOCK`` shingles at most.
   * Of other families' keys those with more than ``SMALL`` members are compared like
     that; the members of smaller ones are paired, which is some pairs a node at most.

   Each two texts with a common key are thus compared or joined.

Texts, keys and links are never collected on the driver, nor is a group held by
one task. Counts of a key or family are summed partially and written before rows
are joined with them: small ones are broadcast then, and otherwise both sides of
the join are plain shuffles, whose hot keys adaptive execution splits. The tables
between the steps are written to the shared folder.

Defined results: a text without words (null too) has an empty set, is linked
with nothing, and is its own component. A text with fewer words than a shingle
has one shingle, the whole sequence. Repeated rows are members like others. The
component of a class whose ids are all null is null; a null doc_id is never the
smallest. An empty table gives an empty table; other columns are ignored by
link() and kept by keep_first().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written
from .components import components

#: The chance at most that the signatures of a pair exactly at the threshold are beyond the distance of the join.
MISSED = 3e-5
#: Hash seeds of the minima, drawn once from a fixed generator.
_SEED = 20_240_501
#: Members of a key that are paired with each other; those of a family; shingles of a block of texts.
SMALL, FAMILY, BLOCK = 8, 64, 300_000
#: Comparisons of a block (in arrays) that cost as much as a pair of a key (a row).
WORTH = 200
_HASHED = 100_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Plan:
    """How sets are made, how signatures are cut, and what counts as a link."""

    words: int
    per_cent: int
    width: int
    chunks: int
    errors: int = 1

    @property
    def symbols(self) -> int:
        return self.width * self.chunks

    @property
    def distance(self) -> int:
        """Of two signatures this far apart some chunk has ``errors`` errors at most, so they share a key."""
        return self.chunks * (self.errors + 1) - 1

    @property
    def bits(self) -> int:
        """Bits of the sketch: one of each symbol, of 63 symbols at most."""
        return min(63, self.symbols)

    @property
    def bit_distance(self) -> int:
        """Sketches of linked sets are no further apart, but for a chance of some 1e-7; a bit differs where the symbols do, half of the time."""
        return min(self.distance, _most(self.bits, (1 - self.per_cent / 100) / 2))


def _most(n: int, p: float) -> int:
    """More of n draws than this succeed with a chance of some 1e-7 only, if each does with chance p."""
    return min(n, math.ceil(n * p + 5.3 * math.sqrt(n * p * (1 - p)) + 1))


def _beyond(n: int, p: float, k: int) -> float:
    """The chance that more than k of n draws succeed, if each does with chance p."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))


def plan(words: int, per_cent: int, errors: int = 1, symbols: int = 112) -> Plan:
    """The widest chunks, so the most selective keys, whose guaranteed distance misses few enough pairs with so many symbols."""
    differ = 1 - per_cent / 100
    for width in range(10, errors + 1, -1):
        for chunks in range(1, symbols // width + 1):
            if _beyond(width * chunks, differ, chunks * (errors + 1) - 1) <= MISSED:
                return Plan(words, per_cent, width, chunks, errors)
    return Plan(words, per_cent, errors + 1, symbols // (errors + 1), errors)  # any equal symbol is a common key


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _HASHED:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


_WORDS = _WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, split), np.uint64, len(split))
    n = max(1, len(own) - words + 1)
    total = np.full(n, len(own) if len(own) < words else 0, np.uint64)
    for j in range(min(words, len(own))):
        total = total * _M2 + own[j : j + n]
    return np.unique(mixed(total))


def node_of(own: np.ndarray) -> int:
    """A hash of a set of shingles, as a signed number of 64 bits."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


class Signer:
    """Signatures and their keys under a plan."""

    def __init__(self, how: Plan):
        rng = np.random.Generator(np.random.PCG64(_SEED))
        self.how = how
        self.a = rng.integers(0, 1 << 63, how.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, how.symbols, dtype=np.uint64)
        self.left_out = list(combinations(range(how.width), how.errors))
        self.salt = mixed(np.arange(1, how.chunks * len(self.left_out) + 1, dtype=np.uint64)).reshape(how.chunks, -1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """b-bit symbols (b = 16) of the minima over a set that isn't empty."""
        least = np.full(self.how.symbols, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(hashes), 4096):
            part = hashes[None, start : start + 4096] * self.a[:, None]
            part += self.b[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return (mixed(least) >> np.uint64(48)).astype(np.uint16)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """All keys of each signature: one for a chunk and a choice of symbols left out."""
        how = self.how
        own = signatures.reshape(-1, how.chunks, how.width).astype(np.uint64) + (np.arange(how.width, dtype=np.uint64) << np.uint64(20))
        own = mixed(own + np.uint64(0x9E3779B97F4A7C15))
        whole = own.sum(axis=2)
        out = np.empty((len(own), how.chunks, len(self.left_out)), np.uint64)
        for k, gone in enumerate(self.left_out):
            out[:, :, k] = mixed(whole - own[:, :, list(gone)].sum(axis=2) + self.salt[:, k])
        return out.reshape(len(own), -1).view(np.int64)


def sketches(signatures: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bit of the first symbols of each signature, as one number."""
    return (signatures[:, :bits].astype(np.int64) & 1) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def signed(docs: DataFrame, how: Plan) -> DataFrame:
    """(doc_id, place, n_shingles, node, signature) of each row of docs.

    node is a hash of the set, null for the empty set; place a hash of the text, by which it is found again.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("place"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(how)
        for batch in batches:
            for part in slices(batch):
                counts, nodes, signatures = [], [], []
                for text in part.column("text").to_pylist():
                    own = shingles(text, how.words)
                    counts.append(len(own))
                    nodes.append(node_of(own) if len(own) else None)
                    signatures.append(signer.signature(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "place", "n_shingles", "node", "signature"])

    return source.mapInArrow(run, "doc_id long, place long, n_shingles long, node long, signature binary")


def keyed(nodes: DataFrame, how: Plan) -> DataFrame:
    """(key, node, n, sketch) for all keys of nodes (node, n, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(how)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
                keys = signer.keys(signatures)
                each = keys.shape[1]
                node, n = (part.column(c).to_numpy(zero_copy_only=False).repeat(each) for c in ("node", "n"))
                sketch = sketches(signatures, how.bits).repeat(each)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array(n), pa.array(sketch)], names=["key", "node", "n", "sketch"])

    return nodes.select("node", "n", "signature").mapInArrow(run, "key long, node long, n long, sketch long")


def may_link(how: Plan, n: str, m: str, sketch: str, other: str) -> Column:
    """Whether sizes and sketches of two members of a key allow a link."""
    size = 100 * F.least(n, m) >= how.per_cent * F.greatest(n, m)
    return size & (F.bit_count(F.col(sketch).bitwiseXOR(F.col(other))) <= how.bit_distance)


def near_in_signature(pairs: DataFrame, nodes: DataFrame, how: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance of the plan."""
    own = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    other = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                close = pa.array((sa != sb).sum(axis=1) <= how.distance)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(close)

    return pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, how: Plan) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity of the plan; texts has (node, text)."""
    own = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hub, fits = None, None, False
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if a != node or not fits:
                    node, hub = a, shingles(ta.as_py(), how.words)
                    fits = len(hub) > 0 and node_of(hub) == a
                own = shingles(tb.as_py(), how.words)
                if fits and len(own) and node_of(own) == b:
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    keep.append(100 * both >= how.per_cent * (len(hub) + len(own) - both))
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the nodes in wanted: of each class the text of one row."""
    places = nodes.join(wanted, "node").select("node", F.col("at.doc_id").alias("at_id"), F.col("at.place").alias("at_place"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("place", F.xxhash64("text"))
    return source.join(places, (F.col("place") == F.col("at_place")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select("node", "text")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def with_hubs(members: DataFrame) -> DataFrame:
    """members (key, node, n, sketch) of keys that have several, with the hub of their key and their number."""
    keys = written(members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1"), "keys")
    own = written(members.join(keys, "key"), "members")
    hubs = written(own.filter("node = hub").select("key", F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hubs")
    return own.join(hubs, "key").select("key", "node", "n", "sketch", "hub", "hub_n", "hub_sketch", "members")


def pairs_within(members: DataFrame, how: Plan) -> DataFrame:
    """All pairs (a, b) of members of a key that are of different components and may be linked."""
    own = members.select("key", F.col("node").alias("a"), "n", "sketch", F.col("root").alias("top"))
    other = members.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"), "root")
    return own.join(other, "key").filter("a < b AND top <> root").filter(may_link(how, "n", "m", "sketch", "other")).select("a", "b").distinct()


def pairs_with_hubs(members: DataFrame, how: Plan) -> DataFrame:
    """Pairs (a, b) of each node b with the smallest and the largest of its keys' hubs that it may be linked with."""
    own = members.filter("node <> hub").filter(may_link(how, "n", "hub_n", "sketch", "hub_sketch"))
    own = own.groupBy("node").agg(F.min("hub").alias("least"), F.max("hub").alias("most"))
    return own.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("a"), F.col("node").alias("b"))


def links_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, how: Plan) -> DataFrame:
    """The pairs that are links, by signature and then by full sets."""
    near = written(near_in_signature(pairs, nodes, how), "near")
    texts = written(texts_of(docs, nodes, ends_of(near)), "texts")
    return written(confirmed(near, texts, how), "links")


def link_nodes(docs: DataFrame, nodes: DataFrame, how: Plan) -> DataFrame:
    """(node, root) for the nodes that confirmed links join to others."""
    shared = written(with_hubs(keyed(nodes, how)), "shared")
    links = links_of(docs, nodes, pairs_with_hubs(shared, how), how)
    labels = components(links)
    # A key whose members are of one component is done.
    left = shared.select("key", "node", "n", "sketch").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_keys = left.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("node").alias("first"), F.count("*").alias("members")).filter("least <> most")
    mixed_keys = written(mixed_keys.select("key", "first", "members"), "mixed")
    left = written(left.join(mixed_keys, "key"), "left")
    if left.isEmpty():
        return labels
    pairs, groups = in_families(left, how)
    found = links_of(docs, nodes, pairs, how)
    if not groups.isEmpty():
        found = found.union(written(links_in_groups(docs, nodes, groups, how), "links"))
    return labels if found.isEmpty() else components(links.union(found))


def in_families(left: DataFrame, how: Plan) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of members of mixed keys that are looked at, and the groups (kind, grp, node, n, root) that are compared in blocks.

    left has key, node, n, sketch, root, first and members.
    """
    families = components(left.select(F.col("first").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("family"))
    own = written(left.join(families, "node"), "families")
    members = written(own.groupBy("family", "node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("root").alias("root")), "members")
    by_key = own.groupBy("family").agg(F.sum("members").alias("pairs"))  # each row of a key counts the key's members
    by_family = members.groupBy("family").agg(F.count("*").alias("size"))
    way = F.when(F.col("size") <= FAMILY, "pairs").when(F.col("size") * F.col("size") <= WORTH * F.col("pairs"), "whole").otherwise("keys")
    ways = written(by_family.join(by_key, "family").select("family", way.alias("way")), "ways")
    groups = members.join(ways.filter("way = 'whole'"), "family").select(F.lit(0).alias("kind"), F.col("family").alias("grp"), "node", "n", "root")
    by_keys = own.join(ways.filter("way = 'keys'"), "family")
    groups = written(groups.union(by_keys.filter(F.col("members") > SMALL).select(F.lit(1), "key", "node", "n", "root")), "groups")
    within = members.join(ways.filter("way = 'pairs'"), "family").select(F.col("family").alias("key"), "node", "n", "sketch", "root")
    within = written(within.union(by_keys.filter(F.col("members") <= SMALL).select("key", "node", "n", "sketch", "root")), "within")
    return pairs_within(within, how), groups


def links_in_groups(docs: DataFrame, nodes: DataFrame, groups: DataFrame, how: Plan) -> DataFrame:
    """Links (a, b) that join the components of members of a group; groups has kind, grp, node, n and root."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sqrt(F.count("*")) / 5)).cast("int")
    sizes = written(groups.groupBy("kind", "grp").agg(blocks.alias("blocks")), "sizes")
    placed = groups.join(sizes, ["kind", "grp"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("kind", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "root")
    wanted = written(groups.select("node").distinct(), "wanted")
    texts = texts_of(docs, nodes, wanted).dropDuplicates(["node"])
    texts = written(texts.join(nodes.select("node", "signature"), "node"), "texts")
    sent = placed.join(texts, "node")

    def run(group: pa.Table) -> pa.Table:
        names, texts = group.column("node").to_pylist(), group.column("text")
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(names), -1)
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        second = np.array(group.column("second").to_pylist(), bool) if across else None
        links = joining_links(lambda x: texts[x].as_py(), names, signatures, group.column("root").to_pylist(), second, how)
        return pa.table({"a": pa.array([names[x] for x, _ in links], pa.int64()), "b": pa.array([names[y] for _, y in links], pa.int64())})

    return sent.groupBy("kind", "grp", "i", "j").applyInArrow(run, "a long, b long")


def joining_links(text_of: Callable[[int], str], names: list[int], signatures: np.ndarray, roots: list[int], second: np.ndarray | None, how: Plan) -> list[tuple[int, int]]:
    """Links that join the components in roots: near in signature, confirmed on the full sets.

    second marks the members of the second block, which are compared with those of
    the first only; None: all are compared with each other. Texts whose set is not
    the one that the node names have no links.
    """
    top = {r: r for r in roots}
    sets: dict[int, np.ndarray] = {}

    def of(x: int) -> int:
        r = roots[x]
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    def set_of(x: int) -> np.ndarray:
        if x not in sets:
            own = shingles(text_of(x), how.words)
            sets[x] = own if len(own) and node_of(own) == names[x] else own[:0]
        return sets[x]

    bits = sketches(signatures, how.bits)
    first = np.arange(len(names)) if second is None else np.flatnonzero(~second)
    links = []
    for x in range(len(names)) if second is None else np.flatnonzero(second).tolist():
        others = first[:x] if second is None else first
        near = others[np.bitwise_count(bits[others] ^ bits[x]) <= how.bit_distance]
        near = near[(signatures[near] != signatures[x]).sum(axis=1) <= how.distance]
        for y in near.tolist():
            if (p := of(x)) == (q := of(y)):
                continue
            a, b = set_of(x), set_of(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both and 100 * both >= how.per_cent * (len(a) + len(b) - both):
                top[p] = q
                links.append((x, y))
    return links


def _labelled(docs: DataFrame, how: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The components of linked classes (node, root), the signed rows, and the classes."""
    rows = written(signed(docs, how), "signed")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "place")).alias("at"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    return link_nodes(docs, nodes, how), rows, nodes


def link(docs: DataFrame, how: Plan) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    labels, rows, nodes = _labelled(docs, how)
    rooted = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    ids = rooted.join(first, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_first(docs: DataFrame, how: Plan) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id.

    Of rows with that same id the one with the smallest hash of its text stays, of
    equal rows one; rows with an empty set all stay, as they are linked with nothing.
    """
    labels, rows, nodes = _labelled(docs, how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    # The first row of each class, by partial aggregation; then the first class of each component.
    tops = rows.filter("node IS NOT NULL").groupBy("node").agg(first.alias("top"))
    tops = tops.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("top").alias("top"))
    kept = tops.select(F.xxhash64("top.doc_id", "top.place").alias("row_key"), F.col("top.place").alias("place"))
    names = docs.columns
    source = docs.select(*(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)))
    text = F.col(f"k{names.index('text')}").cast("string")
    source = source.withColumn("place", F.xxhash64(text)).withColumn("row_key", F.xxhash64(F.col(f"k{names.index('doc_id')}").cast("long"), "place"))
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    back = [F.col(f"k{i}").alias(n) for i, n in enumerate(names)]
    # Of rows repeated with id and text one stays; each task drops its own before the shuffle, which the join uses again.
    turn = F.row_number().over(Window.partitionBy("row_key", "place").orderBy("place"))
    worded = source.filter(~blank).withColumn("turn", turn).filter("turn = 1")
    chosen = worded.join(kept, ["row_key", "place"], "left_semi").select(*back)
    return chosen.unionByName(source.filter(blank).select(*back))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), plan(words=3, per_cent=85))


#: The same by an inverted index of shingles, then a closure over the links.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t),
c AS (SELECT reach.r, min(t.doc_id) AS component_id FROM reach JOIN d t ON t.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
