import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkredact.llm import hmm


def corpus():
    rng = random.Random(9)
    themes = [["red", "green", "blue", "hue"], ["one", "two", "six", "ten"], ["cat", "dog", "cow"]]
    docs = []
    for i in range(300):
        own = themes[i % 3]
        docs.append((i, " ".join(rng.choice(own) if rng.random() < 0.9 else f"w{rng.randint(0, 900)}" for _ in range(rng.randint(0, 90)))))
    return docs + [(1000, None), (1000, ""), (None, "red RED Red"), (1001, "dog " * 30_000), (1002, "never ünseen wörds")]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hmm"))
    spark.createDataFrame([(*d, 1.5) for d in corpus()], "doc_id long, text string, score double").repartition(3).write.parquet(f"{path}/documents.parquet")
    old, hmm.KNOWN = hmm.KNOWN, 40  # most words are counted by the join
    yield hmm.op10_hmm(spark, path).collect()
    hmm.KNOWN = old


def test_base_score_and_counts(rows):
    docs = corpus()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in docs if not held(d) for w in hmm.tokens_of(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((d or -1, held(d), len(own := hmm.tokens_of(t)), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for d, t in docs), key=str)
    got = sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)
    assert got == want


def test_model_beats_the_base_on_held_out_texts(rows):
    own = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(own) > 30 and sum(r.score for r in own) > sum(r.base_score for r in own) + len(own)


def test_scores_are_a_distribution_over_classes():
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    from itertools import product

    every = [np.array(s, np.uint16) for s in product(range(5), repeat=4)]
    assert math.isclose(sum(10.0 ** model.log10(every)), 1, rel_tol=1e-9)


def test_forward_and_expected_counts_against_enumeration(monkeypatch):
    from itertools import product

    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "CLASSES", 5)
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    texts = [rng.integers(0, 5, n) for n in (1, 4, 3, 4)]
    first = np.array([True, True, True, False])  # the last is from the middle of a text
    whole = model.stationary()
    assert np.allclose(whole @ model.move, whole) and np.isclose(whole.sum(), 1)
    starts, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for x, begins in zip(texts, first, strict=True):
        total = {}
        for path in product(range(3), repeat=len(x)):
            p = (model.start if begins else whole)[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            total[path] = p
        all_ = sum(total.values())
        logs.append(math.log10(all_))
        for path, p in total.items():
            starts[path[0]] += p / all_ * begins
            for t, s in enumerate(path):
                emits[x[t], s] += p / all_
                if t:
                    moves[path[t - 1], s] += p / all_
    rows = np.array([np.concatenate([x, np.zeros(4 - len(x), int)]) for x in texts])
    s, m, e = model.expected(rows, np.array([len(x) for x in texts]), first)
    assert np.allclose(s, starts) and np.allclose(m, moves) and np.allclose(e, emits)
    assert np.allclose(model.log10(texts[:3]), logs[:3])


def test_estimates_are_distributions_and_few_tokens_say_little():
    shares = np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    emits = np.zeros((hmm.CLASSES, hmm.STATES))
    emits[:100] = 50.0
    emits[7], emits[8] = 0, 0
    emits[7, 0], emits[8, 0] = 1.0, 4000.0  # seen in one state alone: once, and often
    model = hmm.Model.estimated(np.ones(hmm.STATES), np.ones((hmm.STATES, hmm.STATES)), emits, shares)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    once, often = model.emit[7], model.emit[8]
    assert once[0] / once[1] < 20 and often[0] / often[1] > 200
    none = hmm.Model.estimated(np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros_like(emits), shares)
    assert np.isfinite(none.emit).all() and np.allclose(none.emit.sum(axis=0), 1)


def test_a_class_has_room_in_sixteen_bits():
    assert hmm.CLASSES - 1 <= np.iinfo(np.uint16).max and hmm.KNOWN <= hmm.OWN


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert hmm.op10_hmm(spark, str(tmp_path)).count() == 0
