import random

import numpy as np

from sparkredact.llm import quality


def corpus(n=400):
    rng = random.Random(8)
    words = ["the", "of", "ship", "green", "hill", "runs", "over", "again", "tion", "ereth"]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            own = [[w.upper() + "!!" for w in own], [w + "***" for w in own], [w for w in own[:20] for _ in range(4)]][i // 4 % 3]
        docs.append((i, " ".join(own)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_row_cases(spark, tmp_path):
    docs, labels = corpus()
    docs = docs + [(1000, None), (1000, ""), (None, "the of ship"), (1001, "w " * 50_000)]
    labels = labels + [(3, 1), (5000, 0), (7, None), (None, 1)]
    spark.createDataFrame([(*r, "x", 2.0) for r in docs], "doc_id long, text string, lang string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op4_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {d: q for d, q in labels[:400]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len({r.score for r in rows if r.doc_id == 1000}) == 1


def test_votes_match_all_cosines():
    docs, labels = corpus(80)
    texts = [t for _, t in docs]
    voters = quality.Voters(quality.counts(texts), [q for _, q in labels])
    rows = np.log1p(quality.counts(texts)).astype(float) * voters.weight
    vectors = rows @ voters.basis
    vectors = np.rint(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * quality.STEPS)
    assert (vectors == voters.vectors).all()
    for i, got in enumerate(voters.score(texts, block=7)):
        near = [int(sum(int(a) * int(b) for a, b in zip(vectors[i], v, strict=True))) for v in vectors]
        top = sorted(range(len(near)), key=lambda k: (-near[k], k))[: quality.NEIGHBOURS]
        weight = [max(0, near[k] / quality.STEPS**2) ** quality.POWER for k in top]
        assert abs(got - sum(w * labels[k][1] for w, k in zip(weight, top, strict=True)) / sum(weight)) < 1e-12


def test_ties_and_neighbours_in_a_block_change_nothing():
    docs, labels = corpus(200)
    texts = [t for _, t in docs[:100]] * 3 + ["zig zag " * 40, "", "x" * 500_000]
    voters = quality.Voters(quality.counts(texts[:200]), [i % 2 for i in range(200)])  # equal texts of either label
    whole = voters.score(texts)
    assert whole == [voters.score([t])[0] for t in texts] == voters.score(texts[::-1], block=31)[::-1]
    # Every text has two copies in the sample: the copy that comes first votes first.
    assert whole[:100] == whole[100:200] == whole[200:300]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    voters = quality.fit(docs, none)
    assert [r.score for r in quality.score(docs, voters).collect()] == [0.5]
    assert quality.score(docs.limit(0), voters).count() == 0
    assert quality.keep_good(docs.withColumn("score", docs.doc_id), voters).columns == ["doc_id", "text", "score"]
