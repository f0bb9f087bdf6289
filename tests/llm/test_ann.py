import math

import numpy as np
from pyspark.sql import functions as F

from sparkredact.llm import ann


def run(spark, rows, k=20, every=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    out = {}
    for r in sorted(ann.neighbours(df, F.col("vec_id") % every == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 60)
    monkeypatch.setattr(ann, "ASKED", 20)
    monkeypatch.setattr(ann, "WANTED", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 2
    x = np.concatenate([centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.6, rng.normal(size=(500, 16))]).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    want = ann.brute_force(list(range(len(x))), x.astype(np.float64), list(range(0, len(x), 5)))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(math.isclose(s, float(x[q].astype(float) @ x[v].astype(float)), rel_tol=1e-12) for v, s in found)


def test_one_vector_in_many_rows_and_rows_without_part(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(100)] + [(200, [0.0, 1.0, 1.0]), (205, [3.0, 0.0, 0.0]), (7, same), (None, same)]
    rows += [(300, None), (305, [0.0, 0.0, 0.0]), (310, [float("nan"), 1.0, 1.0]), (315, [1.0, None, 1.0]), (320, [float("inf"), 1.0, 1.0]), (325, [1.0, 1.0])]
    got = run(spark, rows)
    assert set(got) == {*range(0, 100, 5), 200, 205}
    for q in range(0, 100, 5):
        # 5 is the product with same, 3 with (3, 0, 0), 2 with (0, 1, 1)
        assert got[q] == [(v, 5.0) for v in [i for i in range(100) if i != q][:20]]
    assert got[205][0] == (0, 3.0) and [v for v, _ in got[205]] == list(range(20))


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert run(spark, rows) == {0: [(1, 0.5), (2, -1.0)]}
    assert run(spark, rows[:1]) == {}
    assert run(spark, [(0, None)]) == {}
