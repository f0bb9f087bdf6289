"""Secrets: base patterns, and a linear-chain conditional random field that adds what they miss.

Base findings are the leftmost non-overlapping matches of three patterns. The
field tags white-space tokens as begin, inside or outside of a secret. Its
features are the token's shape, length, alphabet and key words, the same of the
two tokens before and the one after, and of the file (length, line length,
equals signs). It learns from ``SAMPLE`` snippets around base findings and as many
from anywhere, and from copies of both into which made-up secrets are written: with
other key words, in other forms, of other alphabets and without any key word, beside
what only looks like one (addresses, numbers, dates, paths, key words in prose). So it
knows more than the patterns do; what it learns is a bounded sample, what it tags is
every token of every text.

A token's scores depend on single words only, and distinct feature sets are few,
so scores are looked up and added over arrays. Where the outside score leads by
more than any transitions could make up for, outside is certain (see
``Field.slack``); Viterbi decodes the stretches between such tokens, which
gives exactly the best sequence of the whole text.

Defined results: a null text is the empty text, and has no findings. Spans are in
code points, end exclusive. A span of the field that a base finding covers is
not repeated. Without any base finding in the table, nothing is learned and the
field adds nothing. Repeated rows give repeated rows; other columns are ignored
by find() and kept by redact(); an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, smallest, table

#: Snippets around findings and snippets from anywhere that the field learns from, and their code points.
SAMPLE, SNIPPET = 400, 320
#: Copies of a snippet with another value and key word, and copies with made-up secrets.
REWRITTEN, PLANTED = 1, 2
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is matched whole, so shorter runs need no match
_MAYBE = re.compile(r"(?ai:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
#: The same for Java's regular expressions.
MAYBE_JAVA = r"(?i:passwd|password|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_OUTSIDE, _BEGIN, _INSIDE = 0, 1, 2
#: Words that tell of a secret nearby.
KEY_WORDS = frozenset("password passwd pwd passphrase passcode secret token key apikey api auth authorization bearer credential credentials creds access private client aws login session signature salt".split())
_EDGE = "\"'`.,;:!?()[]{}<>|*$%&#="


def base_findings(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def ordered(findings: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(findings, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _bucket(n: int) -> int:
    return n if n < 4 else 4 + min(n, 200).bit_length()


def word_features(word: str) -> tuple[str, ...]:
    """Shape, length, alphabet and key-word features of one token."""
    core = word.strip(_EDGE)
    edge = word[:1] if word[:1] in "\"'`" else ""
    edge += word[-1:] if word[-1:] in "\"'`=:" else ""
    if not core:
        return ("mark", "m" + word[:2])
    if core.isalpha():
        low = core.lower()
        if low in KEY_WORDS:
            return ("key", "k" + low, "e" + edge)
        return ("alpha", "l" + str(_bucket(len(core))), "e" + edge, "c" + ("l" if core.islower() else "u" if core.isupper() else "m"))
    lower = sum(c.islower() for c in core)
    upper = sum(c.isupper() for c in core)
    digits = sum(c.isdigit() for c in core)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else c if c.isascii() else "x" for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)
    out = [
        "l" + str(_bucket(len(core))),
        "e" + edge,
        "t" + str(int(turns * 5)),
        "a" + "".join(k for k, n in (("l", lower), ("u", upper), ("d", digits), ("p", len(core) - lower - upper - digits)) if n),
        "r" + str(int(4 * digits / len(core))),
        "v" + str(min(len(set(core)), 24) // 3),
    ]
    if len(core) >= 8 and all(c in "0123456789abcdef" for c in core):
        out.append("hex")
    if "@" in core:
        out.append("at")
    if "://" in core:
        out.append("url")
    if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", core):
        out.append("date")
    if word.startswith(("/", "./", "~/")):
        out.append("path")
    if core.count(".") + core.count("/") + core.count("-") + core.count(":") > 1:
        out.append("parts")
    parts = re.split(r"[^A-Za-z]+", core.lower())
    if KEY_WORDS.intersection(parts):
        out.append("key in")
    if re.search(r"[A-Za-z]['\"]?[=:]['\"]?.{4}", core):
        out.append("assigns")
    return tuple(out)


def file_features(chars: int, lines: int, equals: int) -> tuple[str, ...]:
    return (f"file length {chars.bit_length() // 3}", f"line length {(chars // (lines + 1)).bit_length() // 3}", f"equals {min(equals, 3)}")


class Field:
    """Weights of features for each tag, transitions between tags, and exact decoding."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        # Outside in place of tag y gains at most this in the two transitions beside it, whatever the neighbours.
        t = transitions
        self.slack = np.array([(t[:, y] - t[:, _OUTSIDE]).clip(0).max() + (t[y] - t[_OUTSIDE]).clip(0).max() for y in range(3)])
        self.tables: list[list[np.ndarray]] = [[], [], [], []]
        self.ids: dict[tuple, int] = {}
        self.words: dict[str, int] = {}
        self.maybe: list[bool] = []

    def __getstate__(self):
        return self.weights, self.transitions

    def __setstate__(self, state):
        self.__init__(*state)

    def _number(self, word: str) -> int:
        features = word_features(word)
        maybe = bool(_MAYBE.search(word))
        key = (features, maybe)
        if key not in self.ids:
            self.ids[key] = len(self.ids)
            self.maybe.append(maybe)
            for place, rows in zip(("", "p:", "pp:", "n:"), self.tables, strict=True):
                rows.append(sum((self.weights[place + f] for f in features if place + f in self.weights), np.zeros(3)))
        if len(self.words) > 300_000:
            self.words.clear()
        self.words[word] = self.ids[key]
        return self.ids[key]

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.words.get
        found = list(map(get, words))
        if None in found:
            found = [self._number(w) if n is None else n for w, n in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def scores(self, numbers: np.ndarray, file: tuple[str, ...], tables: list[np.ndarray]) -> np.ndarray:
        own, before, before2, after = tables
        out = own[numbers] + sum((self.weights[f] for f in file if f in self.weights), np.zeros(3))
        out[1:] += before[numbers[:-1]]
        out[2:] += before2[numbers[:-2]]
        out[:-1] += after[numbers[1:]]
        return out

    def stacked(self) -> tuple[list[np.ndarray], np.ndarray]:
        return [np.array(t).reshape(-1, 3) for t in self.tables], np.array(self.maybe, bool)

    def viterbi(self, scores: np.ndarray, before: bool, after: bool) -> list[int]:
        """The best tags of a stretch; before and after: an outside token stands there."""
        best = scores[0] + (self.transitions[_OUTSIDE] if before else 0)
        back = []
        for row in scores[1:]:
            step = best[:, None] + self.transitions
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if after:
            best = best + self.transitions[:, _OUTSIDE]
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def tag(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens (first, last) that the best sequence tags as one secret."""
        lead = scores[:, _OUTSIDE, None] - scores
        open_ = np.flatnonzero((lead[:, _BEGIN] <= self.slack[_BEGIN]) | (lead[:, _INSIDE] <= self.slack[_INSIDE]))
        runs: list[tuple[int, int]] = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            start, end = int(part[0]), int(part[-1]) + 1
            last = _OUTSIDE
            for i, tag in enumerate(self.viterbi(scores[start:end], start > 0, end < len(scores)), start):
                if tag == _INSIDE and last != _OUTSIDE:
                    runs[-1] = (runs[-1][0], i)
                elif tag != _OUTSIDE:
                    runs.append((i, i))
                last = tag
        return runs


def trained(examples: list[tuple[list[str], list[int], tuple[str, ...]]], steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood with L2 decay over (words, tags, file features), by forward-backward and steps of adaptive size."""
    index: dict[str, int] = {}
    flat, counts = array("i"), array("i")
    for words, _, file in examples:
        each = [word_features(w) for w in words]
        for t in range(len(words)):
            own = [*each[t], *file]
            own += ["p:" + f for f in each[t - 1]] if t > 0 else []
            own += ["pp:" + f for f in each[t - 2]] if t > 1 else []
            own += ["n:" + f for f in each[t + 1]] if t + 1 < len(words) else []
            flat.extend(index.setdefault(f, len(index)) for f in own)
            counts.append(len(own))
    n, longest = len(examples), max(len(w) for w, _, _ in examples)
    flat, counts = np.frombuffer(flat, np.int32), np.frombuffer(counts, np.int32)
    total = len(counts)
    token = np.repeat(np.arange(total, dtype=np.int32), counts)
    lengths = np.array([len(w) for w, _, _ in examples])
    at = np.concatenate([i * longest + np.arange(m) for i, m in enumerate(lengths)])
    gold = np.concatenate([np.array(tags) for _, tags, _ in examples])
    live = np.zeros(n * longest, bool)
    live[at] = True
    live = live.reshape(n, longest)
    pairs = live[:, 1:] & live[:, :-1]
    tags = np.zeros(n * longest, np.int64)
    tags[at] = gold
    tags = tags.reshape(n, longest)
    gold_pairs = np.zeros((3, 3))
    np.add.at(gold_pairs, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    w, t = np.zeros((len(index), 3)), np.zeros((3, 3))
    mean = [np.zeros_like(w), np.zeros_like(t)]
    square = [np.zeros_like(w), np.zeros_like(t)]
    target = np.eye(3)[gold]
    for step in range(1, steps + 1):
        own = np.stack([np.bincount(token, w[flat, y], total) for y in range(3)], axis=1)
        e = np.zeros((n * longest, 3))
        e[at] = own
        e = e.reshape(n, longest, 3)
        top = t.max()
        move = np.exp(t - top)
        shift = e.max(axis=2, keepdims=True)
        x = np.exp(e - shift)
        forward, backward, scale = np.zeros_like(x), np.ones_like(x), np.ones((n, longest))
        for i in range(longest):
            a = x[:, i] if i == 0 else (forward[:, i - 1] @ move) * x[:, i]
            scale[:, i] = np.where(live[:, i], a.sum(axis=1), 1)
            forward[:, i] = np.where(live[:, i, None], a / scale[:, i, None], 0)
        for i in range(longest - 2, -1, -1):
            b = ((x[:, i + 1] * backward[:, i + 1]) @ move.T) / scale[:, i + 1, None]
            backward[:, i] = np.where(live[:, i + 1, None], b, 1)
        share = forward * backward
        share /= share.sum(axis=2, keepdims=True).clip(1e-300)
        ahead = x[:, 1:] * backward[:, 1:] / scale[:, 1:, None] * pairs[:, :, None]
        expected = np.einsum("nia,nib->ab", forward[:, :-1], ahead) * move
        gap = target - share.reshape(-1, 3)[at]
        slope_w = np.stack([np.bincount(flat, gap[token, y], len(index)) for y in range(3)], axis=1) / total - decay * w
        slope_t = (gold_pairs - expected) / total - decay * t
        for x, slope, m, v in zip((w, t), (slope_w, slope_t), mean, square, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: w[i] for f, i in index.items()}, t)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VALUES = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _LETTERS + _LETTERS.upper() + "0123456789", _LETTERS + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789+/_-", _LETTERS + _LETTERS.upper() + "0123456789!@#$%^&*~?")
#: Forms in which a secret (v) is written after key words (k), and forms that need no key word.
_FORMS = ("{k}: {q}{v}{q}", "{k} = {q}{v}{q}", "{k}={q}{v}{q}", "{k} {q}{v}{q}", "{q}{k}{q}: {q}{v}{q},", "{k} is {v}", "{k} -> {v}", "{k} => {q}{v}{q}", "{k} := {v};", "--{k} {v}", "--{k}={v}", "export {k}={q}{v}{q}", "Authorization: Bearer {v}", "Authorization: Basic {v}", "{k} | {v} |", "<{k}> {v} </{k}>", "({k} {v})", "{k}, {q}{v}{q}")
_ALONE = ("{v}", '"{v}"', "`{v}`", "'{v}',", "({v})")
_PREFIXES = ("", "", "", "", "sk-", "ghp_", "glpat-", "xoxb-", "pk_live_", "AIza", "SG.")


def _value(rng: random.Random, least: int = 12) -> str:
    letters = rng.choice(_VALUES)
    drawn = lambda n: "".join(rng.choice(letters) for _ in range(n))
    if rng.random() < 0.08:
        return ".".join(drawn(n) for n in (rng.randint(8, 20), rng.randint(16, 40), rng.randint(16, 40)))
    return rng.choice(_PREFIXES) + drawn(rng.choice([n for n in (10, 12, 16, 20, 24, 32, 40, 48, 64) if n >= least]))


def _key_words(rng: random.Random) -> str:
    words = rng.sample(sorted(KEY_WORDS), rng.choice([1, 1, 1, 2, 2, 3]))
    if rng.random() < 0.15:
        words.insert(0, rng.choice(["my", "the", "db", "user", "app", "prod", "old"]))
    case = rng.choice([str.lower, str.lower, str.upper, str.title])
    return case(rng.choice(["_", "-", " ", " ", ""]).join(words))


def _harmless(rng: random.Random) -> str:
    """What looks a little like a secret, and key words without one."""
    word = lambda n: "".join(rng.choice(_LETTERS) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = (
        lambda: f"{word(6)}.{word(7)}{digits(2)}@{word(8)}.example.com",
        lambda: f"https://{word(7)}.example.org/{word(5)}/{digits(6)}?{word(2)}={word(6)}",
        lambda: f"{word(3).upper()}-20{digits(2)}-{digits(6)}",
        lambda: digits(rng.choice([7, 10, 13, 16])),
        lambda: f"+{digits(2)} {digits(3)} {digits(7)}",
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
        lambda: f"/usr/{word(5)}/{word(9)}-{digits(1)}.{digits(2)}/{word(6)}.txt",
        lambda: f"{digits(1)}.{digits(2)}.{digits(1)}-{word(4)}",
        lambda: f"{word(6)}{word(7).title()}{word(5).title()}",
        lambda: f"{word(8)}_{word(7)}_{word(6)}",
        lambda: word(rng.randint(16, 30)),
        lambda: f"{word(9)}-{word(8)}-{word(7)}",
        lambda: f"{rng.choice(['id', 'ref', 'no', 'name', 'size', 'order'])}{rng.choice([': ', '=', ' = '])}{rng.choice([digits(6), word(8), word(4) + digits(3)])}",
        lambda: f"{_key_words(rng)} {rng.choice(['is required', 'was changed', 'for each user', 'and more', 'of the house'])}",
        lambda: f"{rng.choice(sorted(KEY_WORDS))} {word(rng.randint(3, 9))} {word(4)}",
        lambda: f"{rng.choice(sorted(KEY_WORDS))}: {word(rng.randint(2, 7))} {word(5)}",
    )
    return rng.choice(made)()


def rewritten(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]] | None:
    """text with the value of its first finding drawn anew and its key word changed, and where the value is now."""
    found = base_findings(text)
    if not found:
        return None
    _, start, _, value, end = min(found, key=lambda f: f[1])
    new, quote = _value(rng, 16), rng.choice(["", '"', "'"])
    head = text[:start] + rng.choice(["", quote]) + rng.choice(sorted(KEY_WORDS)) + rng.choice([": ", " = ", "=", " ", quote + ": "]) + quote
    return head + new + quote + text[end:].lstrip("\"'"), [(len(head), len(head) + len(new))]


def planted(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """text with two made-up secrets and two harmless look-alikes between its words, and where secrets are, its own ones too."""
    gaps = [m.end() for m in re.finditer(r"\s+", text)]
    places = sorted(rng.sample(gaps, min(4, len(gaps))))
    kinds = rng.sample([True, True, False, False], len(places))
    own = [(a, b) for *_, a, b in base_findings(text)]
    out, values, last = "", [], 0
    for at, secret in zip([*places, len(text)], [*kinds, None], strict=True):
        values += [(len(out) + a - last, len(out) + b - last) for a, b in own if last <= a < at]
        out += text[last:at]
        last = at
        if secret:
            alone = rng.random() < 0.15
            value = _value(rng, 24 if alone else 10)
            form = rng.choice(_ALONE if alone else _FORMS)
            put = form.format(k=_key_words(rng), q=rng.choice(["", '"', "'"]), v="\0")
            start = len(out) + put.index("\0")
            values.append((start, start + len(value)))
            out += put.replace("\0", value) + " "
        elif secret is False:
            out += _harmless(rng) + " "
    return out, values


def labelled(text: str, values: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, last = [], [], None
    for m in re.finditer(r"\S+", text):
        hit = next((v for v in values if m.start() < v[1] and v[0] < m.end()), None)
        words.append(m[0])
        tags.append(_OUTSIDE if hit is None else _INSIDE if hit == last else _BEGIN)
        last = hit
    return words, tags


def snippets(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int, int, int]]:
    """(snippet, chars, lines, equals) around base findings and from anywhere: sample rows of each, by smallest hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)).alias("h"))
    rows = rows.filter(F.length("text") > 0)
    count = lambda mark: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(mark), F.lit("")))).cast("int")
    out = []
    for found in (True, False):
        own = rows.filter(F.col("text").rlike(MAYBE_JAVA)) if found else rows.withColumn("h", F.xxhash64("h"))
        at = F.regexp_instr("text", F.lit(MAYBE_JAVA)) if found else (F.pmod("h", F.length("text").cast("long")) + 1).cast("int")
        start = F.greatest(at - SNIPPET // 2, F.lit(1))
        # Snippets are cut before the order, so that no whole text is sent on.
        own = own.select("h", F.substring(F.col("text"), start, F.lit(SNIPPET)).alias("snippet"), F.length("text").alias("chars"), count("\n").alias("lines"), count("=").alias("equals"))
        own = smallest(own, "h", sample, "snippet", "chars")
        out += [(r.snippet, r.chars, r.lines, r.equals, found) for r in own.collect()]
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from a bounded sample of docs; None where there is no base finding."""
    rng, examples = random.Random(11), []
    drawn = snippets(docs, sample)
    if not any(found and base_findings(s) for s, *_, found in drawn):
        return None
    copies = max(PLANTED, -(-2 * sample // len(drawn)))  # the more, the fewer snippets there are
    for snippet, chars, lines, equals, _ in drawn:
        file = file_features(chars, lines, equals)
        cases = [(snippet, [(a, b) for *_, a, b in base_findings(snippet)])]
        cases += [again for _ in range(REWRITTEN) if (again := rewritten(snippet, rng))]
        cases += [planted(snippet, rng) for _ in range(copies)]
        for text, values in cases:
            words, tags = labelled(text, values)
            words, tags = words[1:-1], tags[1:-1]  # a snippet may cut its first and last token
            for i in range(0, len(words), 60):
                examples.append((words[i : i + 60], tags[i : i + 60], file))
    return trained([x for x in examples if x[0]])


def findings_of(text: str, field: Field | None) -> list[tuple[str, int, int]]:
    """All findings of one text; the batch form below shares its tables."""
    return _findings([text], field)[0]


def _findings(texts: list[str], field: Field | None) -> list[list[tuple[str, int, int]]]:
    if field is None:
        return [ordered([f[:3] for f in base_findings(t)]) if _MAYBE.search(t) else [] for t in texts]
    numbers = [field.numbers(t.split()) for t in texts]
    tables, maybe = field.stacked()
    out = []
    for text, own in zip(texts, numbers, strict=True):
        if not len(own):
            out.append([])
            continue
        found = [f[:3] for f in base_findings(text)] if maybe[own].any() else []
        runs = field.tag(field.scores(own, file_features(len(text), text.count("\n"), text.count("=")), tables))
        if runs:
            ends = {i for run in runs for i in run}
            spans = {i: m.span() for i, m in enumerate(islice(re.finditer(r"\S+", text), max(ends) + 1)) if i in ends}
            for first, last in runs:
                start, end = spans[first][0], spans[last][1]
                while start < end and text[start] in _EDGE:
                    start += 1
                while end > start and text[end - 1] in _EDGE:
                    end -= 1
                if start < end and not any(a <= start and end <= b for _, a, b in found):
                    found.append(("crf", start, end))
        out.append(ordered(found))
    return out


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, field: Field | None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep, with findings array<struct<kind,start,end>> in order."""
    keep = ["doc_id"] if keep is None else keep
    return _found(docs, field, keep).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


def _found(docs: DataFrame, field: Field | None, keep: list[str]) -> DataFrame:
    source = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(field)  # some thousand weights: as many as the sample has features
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in slices(batch):
                found = _findings([t or "" for t in part.column("text").to_pylist()], own)
                made = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found], _FINDINGS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), made], names=[*part.schema.names[:-1], "findings"])

    return source.mapInArrow(run, f"{kept}findings array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by mark (overlapping ones by one), and n_chars counted anew where it is a column."""
    names = docs.columns
    found = _found(docs, field, names)
    at, text = names.index("text"), f"k{names.index('text')}"
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, f: Column) -> Column:
        # Code points from s.at to the finding, then the mark, unless the last finding reaches beyond this one's start.
        head = F.when(f["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, f["start"] - s["at"]), F.lit(mark)))
        return F.struct(head.alias("out"), F.greatest(s["at"], f["end"]).alias("at"))

    cut = F.aggregate("findings", state, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    new = F.when(F.size("findings") > 0, cut).otherwise(F.col(text))
    columns = [new.alias("text") if i == at else F.col(f"k{i}").alias(n) for i, n in enumerate(names)]
    out = found.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda f: f["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
