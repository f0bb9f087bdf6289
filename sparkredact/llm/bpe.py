"""Byte-level BPE by corpus-level merge replay.

A slice of documents is split into pretokens. All pretokens that were not seen
before form one small corpus: a linked list of symbols and an inverted index
from the rank of a pair to the positions where that pair stands. Merges are
applied over this whole corpus in rank order, and a merge touches only the two
neighbours of each place where it applies. Every distinct pretoken is thus
encoded once for a worker, however often it occurs.

Defined results: a null text is the empty text; an empty text has no tokens
and decodes to no bytes; repeated rows give repeated rows; other columns of the
input are ignored; an empty table gives an empty table. A pretoken of any
length is encoded whole (the replay is n log n), and what is remembered between
slices is bounded by ``REMEMBERED`` pretokens.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pretokens that a worker remembers, and their ids together.
REMEMBERED, LONGEST_IDS = 300_000, 3_000_000
#: Bytes of the words that are replayed abreast, the ends of their windows of ranks, and the rank of no merge.
SHORT, WINDOWS, NONE = 48, (2_000, 10_000), 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """An open hash table from pair (left << 32 | right) to rank, for many pairs at once."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.mask = (1 << self.bits) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[at] == keys
            self.ranks[at[done]] = ranks[done]
            keys, ranks, at = keys[~done], ranks[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        at = self._slot(keys)
        found = self.keys[at]
        out = self.ranks[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class MergeReplay:
    """Encodes many byte strings at once; ranks maps token bytes to rank, which is the id.

    Words of up to ``SHORT`` bytes are replayed abreast. Their inverted index lists
    the positions of pairs by the window of ranks (``WINDOWS``) that the pair's rank
    is in; the windows are taken in order. Of the positions listed for a window each word
    applies its lowest, leftmost first; a merge touches the two neighbours, whose
    new pairs go to the list of their own rank's window (to the present one if
    that has passed), until the list is empty. Words do not touch each other, so each
    sees its merges in rank order. In longer words, where that takes as many turns as the
    longest has merges, the index has a list for each single rank, taken rank by rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # The rank of each pair of bytes, -1 where they don't merge.
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        # The token that each mergeable pair (left << 32 | right) makes.
        self.pairs = {left << 32 | right: made for token, made in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.top = max(ranks.values()) + 1
        self.table = PairTable(self.pairs)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        whole = list(map(self.ranks.get, words))
        split = [w for w, rank in zip(words, whole, strict=True) if rank is None]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        missed = np.array([rank is None for rank in whole], bool)
        short = np.zeros(len(words), bool)
        short[missed] = lengths <= SHORT
        out_counts = np.ones(len(words), np.int64)
        parts = []
        for chosen, replay in ((short, self._abreast), (missed & ~short, self._replay)):
            own = [w for w, take in zip(split, chosen[missed].tolist(), strict=True) if take]
            n = np.fromiter(map(len, own), np.int64, len(own))
            ids, out_counts[chosen] = replay(np.frombuffer(b"".join(own), np.uint8).astype(np.int64), np.cumsum(n), n)
            parts.append((chosen, ids))
        parts.append((~missed, np.array([rank for rank in whole if rank is not None], np.int64)))
        out = np.empty(out_counts.sum(), np.int64)
        for chosen, ids in parts:
            out[np.repeat(chosen, out_counts)] = ids
        return out, out_counts

    def _abreast(self, raw: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return raw, lengths
        at = np.arange(n)
        word = np.repeat(np.arange(len(lengths)), lengths)
        symbols = self.single[raw]
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        after, before = np.where(last, n, at + 1), at - 1  # n: no symbol follows
        before[ends[lengths > 0] - lengths[lengths > 0]] = -1
        waiting = np.full(n + 1, NONE, np.int64)  # the rank of the pair that begins at a position
        pairs = np.flatnonzero(~last)
        ranks = self.byte_pairs[raw[pairs] * 256 + raw[pairs + 1]]
        pairs, ranks = pairs[ranks >= 0], ranks[ranks >= 0]
        waiting[pairs] = ranks
        # The inverted index: for each window of ranks the positions where such a pair stands.
        limits = np.array([*(w for w in WINDOWS if w < self.top), self.top])
        window = np.searchsorted(limits, ranks, "right")
        index = [[pairs[window == k]] for k in range(len(limits))]
        for k, limit in enumerate(limits):
            listed = np.concatenate(index[k])
            while True:
                # What a merge has changed meanwhile is listed anew.
                listed = np.sort(listed[waiting[listed] < limit])
                listed = listed[np.diff(listed, prepend=-1) > 0]
                if not len(listed):
                    break
                # The lowest rank of each word, and of equal ones the leftmost position.
                starts = np.flatnonzero(np.concatenate([[True], np.diff(word[listed]) > 0]))
                rank = waiting[listed]
                least = np.minimum.reduceat(rank, starts)
                lowest = np.flatnonzero(rank == np.repeat(least, np.diff(np.concatenate([starts, [len(listed)]]))))
                i = listed[lowest[np.concatenate([[True], np.diff(word[listed[lowest]]) > 0])]]
                j = after[i]
                symbols[i] = waiting[i]
                symbols[j] = -1
                waiting[j] = NONE
                after[i] = nxt = after[j]
                follows = nxt < n
                before[nxt[follows]] = i[follows]
                waiting[i] = NONE
                waiting[i[follows]] = self.table.get(symbols[i[follows]] << 32 | symbols[nxt[follows]])
                prev = before[i]
                led = prev >= 0
                waiting[prev[led]] = self.table.get(symbols[prev[led]] << 32 | symbols[i[led]])
                touched = np.concatenate([i[follows], prev[led]])
                rank = waiting[touched]
                listed = np.concatenate([listed, touched[rank < limit]])
                later = (rank >= limit) & (rank < NONE)
                if later.any():
                    places, window = touched[later], np.searchsorted(limits, rank[later], "right")
                    for w in np.unique(window):
                        index[w].append(places[window == w])
        kept = np.concatenate([[0], np.cumsum(symbols >= 0)])
        return symbols[symbols >= 0], kept[ends] - kept[ends - lengths]

    def _replay(self, raw: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        first = np.concatenate([[True], last[:-1]])[:n]
        at = np.arange(n)
        after: list[int] = np.where(last, -1, at + 1).tolist()  # next position in the word, -1 at its end
        before: list[int] = np.where(first, -1, at - 1).tolist()
        symbols: list[int] = self.single[raw].tolist()
        # The inverted index: where the pair of each rank stands.
        found = np.flatnonzero(~last[:-1]) if n else at
        ranks = self.byte_pairs[raw[found] * 256 + raw[found + 1]] if len(found) else found
        found, ranks = found[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        present, starts = np.unique(ranks[order], return_index=True)
        places: list[list[int] | None] = [None] * self.top
        for r, group in zip(present.tolist(), np.split(found[order], starts[1:]), strict=False):
            places[r] = group.tolist()
        waiting = np.full(n, -1, np.int64)  # the rank of the pair that begins at a position
        waiting[found] = ranks
        waiting = waiting.tolist()
        made_by, early, r = self.pairs.get, [], -1
        while True:
            if early:
                rank = heapq.heappop(early)
            else:
                r += 1
                if r == self.top:
                    break
                rank = r
            todo = places[rank]
            if todo is None:
                continue
            places[rank] = None
            if len(todo) > 1:
                todo.sort()
            for k, i in enumerate(todo):
                if waiting[i] != rank:
                    continue
                j = after[i]
                symbols[i], symbols[j], waiting[j] = rank, -1, -1
                after[i] = nxt = after[j]
                waiting[i] = made = -1
                if nxt >= 0:
                    before[nxt] = i
                    made = made_by(rank << 32 | symbols[nxt], -1)
                    if made >= 0:
                        waiting[i] = made
                        if (place := places[made]) is None:
                            places[made] = [i]
                        else:
                            place.append(i)
                prev, other = before[i], -1
                if prev >= 0:
                    waiting[prev] = other = made_by(symbols[prev] << 32 | rank, -1)
                    if other >= 0:
                        if (place := places[other]) is None:
                            places[other] = [prev]
                        else:
                            place.append(prev)
                if 0 <= made <= rank or 0 <= other <= rank:  # an earlier merge became possible: it goes before the rest of this one
                    rest = todo[k + 1 :] + (places[rank] or [])
                    places[rank] = rest or None
                    early += [x for x in {made, other, rank} if x >= 0 and places[x] is not None and x <= rank]
                    heapq.heapify(early)
                    break
        left = np.array(symbols, np.int64)
        kept = np.concatenate([[0], np.cumsum(left >= 0)])
        return left[left >= 0], kept[ends] - kept[ends - lengths]


def explicit(pattern: str) -> str:
    """pattern with its property and white-space classes spelled out, which the re module then takes."""
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        member = regex.compile(name).fullmatch
        codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and member(chr(c))]
        runs: list[list[int]] = []
        for c in codes:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        classes[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    out, inside, i = "", False, 0
    while i < len(pattern):
        name = next((x for x in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(x, i)), pattern[i])
        if name == r"\S" and inside:
            raise ValueError("a negated class inside another is not spelled out")
        if name in classes or name == r"\S":
            own = classes[name.lower() if name == r"\S" else name]
            out += own if inside else f"[{'^' * (name == chr(92) + 'S')}{own}]"
        else:
            inside = {"[": True, "]": False}.get(name, inside)
            out += name
        i += len(name)
    return out


def gathered(table: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """table[start : start + count] for each start and count, one after another."""
    ends = np.cumsum(counts)
    return table[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Text to ids and back, remembering pretokens."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.replay = MergeReplay(ranks)
        try:
            self.find = re.compile(explicit(pattern)).findall
        except (re.error, ValueError):
            self.find = regex.compile(pattern).findall
        top = max(ranks.values()) + 1
        tokens = [self.replay.bytes_of.get(i, b"") for i in range(top)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, top)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        split = [self.find(text) for text in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.number))
        if len(self.number) + len(fresh) > REMEMBERED and self.number:
            self._forget()
            fresh = list(set(chain.from_iterable(split)))
        made, counts = self.replay.encode([w.encode() for w in fresh])
        self.number.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh)), strict=True))
        self.ids = np.concatenate([self.ids, made.astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        words = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, words.sum())
        per_word = self.counts[numbers]
        out = gathered(self.ids, (np.cumsum(self.counts) - self.counts)[numbers], per_word)
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.cumsum(words)
        if len(self.ids) > LONGEST_IDS:
            self._forget()
        return out, total[ends] - total[ends - words]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, and how many each text has."""
        lengths = self.token_lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return gathered(self.token_bytes, self.token_starts[ids], lengths), total[ends] - total[ends - counts]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker process, which keeps what it remembers from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def listed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """ids in a row, and how many each text has, as a list for each text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def binaries(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes in a row, and how many each text has, as a binary for each text."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs (text and the columns in keep) with token_ids array<int> in place of text.

    With decoded, the bytes that the ids decode to stand besides, from the same
    pass: a second one would be a second Python worker for each task.
    """
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").cast("string").alias("text"))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, chars=1 << 20):
                ids, counts = own.encode_batch(_texts(part))
                made = [listed(ids, counts)]
                if decoded:
                    made.append(binaries(*own.decode_batch(ids, counts)))
                names = [*part.schema.names[:-1], "token_ids", *["decoded"] * decoded]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *made], names=names)

    out = source.mapInArrow(run, f"{kept}token_ids array<int>{', decoded binary' * decoded}")
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


def decode(tokens: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """tokens (token_ids and the columns in keep) with the decoded bytes besides."""
    keep = ["doc_id"] if keep is None else keep
    source = tokens.select(*keep, "token_ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = part.column("token_ids")
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                decoded = binaries(*own.decode_batch(ids.flatten().to_numpy(zero_copy_only=False), counts))
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return source.mapInArrow(run, f"{fields}, decoded binary")


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries take."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    both = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
