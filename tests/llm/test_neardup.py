import random

import pytest

from sparkredact.llm import neardup
from sparkredact.llm.components import components


def sets_of(text, words):
    own = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not own:
        return set()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if len(own) >= words else {tuple(own)}


def brute(docs, words, per_cent):
    """Rows of link() by comparing all pairs."""
    sets = [sets_of(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), c := (least.get(top(i)) if s else d), d == c) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def fixture():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(80))  # many documents that share most words, some linked and some not
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(40)]
    chain = [word() for _ in range(60)]  # neighbours are linked, the ends are not
    for step in range(12):
        chain = chain[:step] + [word()] + chain[step + 1 :]
        texts.append(" ".join(chain))
    texts += ["same old words here"] * 25 + ["one", "ONE", "one two", " one\ttwo\n", "", None, "  ", "", "long " * 30_000]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return docs + [(None, "same old words here"), (None, "lonely text without id at all"), (7, "one")]


@pytest.mark.parametrize(("words", "per_cent", "small", "block", "family"), [(3, 85, 8, 1_000_000, 64), (5, 80, 2, 1_000_000, 3), (3, 85, 2, 1500, 3), (3, 85, 0, 1500, 1000)])
def test_against_all_pairs(spark, monkeypatch, words, per_cent, small, block, family):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "FAMILY", family)
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string").repartition(3)
    rows = neardup.link(df, neardup.plan(words, per_cent)).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, words, per_cent)


@pytest.mark.parametrize("how", [neardup.Plan(3, 85, 8, 10), neardup.plan(3, 85), neardup.plan(5, 80), neardup.plan(5, 80, errors=2), neardup.plan(3, 30)])
def test_keys_keep_the_pigeonhole_promise(how):
    signer = neardup.Signer(how)
    rng = random.Random(2)
    base = neardup.np.array([rng.randrange(1 << 16) for _ in range(how.symbols)], neardup.np.uint16)
    for _ in range(200):
        other = base.copy()
        for i in rng.sample(range(how.symbols), how.distance):
            other[i] ^= 1
        keys = signer.keys(neardup.np.stack([base, other]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_pairs_at_the_threshold_are_within_the_guaranteed_distance():
    rng = neardup.np.random.default_rng(5)
    for how in (neardup.plan(3, 85), neardup.plan(5, 80)):
        signer, near = neardup.Signer(how), 0
        for _ in range(400):
            words = rng.integers(0, 1 << 63, 800, dtype=neardup.np.uint64)
            both = -(-800 * how.per_cent // (100 + how.per_cent))  # what two sets of 400 share at the threshold
            a, b = words[:400], words[400 - both : 800 - both]
            distance = int((signer.signature(a) != signer.signature(b)).sum())
            near += distance <= how.distance
        assert near == 400


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.link(empty, neardup.plan(3, 85)).count() == 0


def test_components_of_a_long_path(spark):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(40)] + [(100, 100), (101, 100)]
