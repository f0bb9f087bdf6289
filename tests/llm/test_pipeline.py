import random

import corpus_pipeline
from sparkredact.llm import bpe, decontam, neardup, secrets


def write_tables(spark, path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ing", "ed"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        text = prose(rng.randint(30, 120))
        bad = i % 4 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append([i, text, "en", "s", 0])
        labels.append((i, int(not bad), 0))
    passage = prose(40)
    docs += [[200 + i, docs[4 * i + 1][1] + " more words", "en", "s", 0] for i in range(10)]
    docs += [[300, docs[1][1], "en", "s", 0], [1, docs[1][1], "en", "s", 0], [301, passage, "en", "s", 0], [302, prose(60) + ' token = "' + "0123abcd" * 5 + '" ' + prose(30), "en", "s", 0], [303, None, None, None, None], [304, "", "en", "s", 0]]
    docs += [[305, prose(60_000), "en", "s", 0]]
    for d in docs:
        d[4] = len(d[1]) if d[1] is not None else None
    spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, passage


def test_run_against_plain_python(spark, tmp_path):
    docs, passage = write_tables(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows)
    # By hand: capitals go, of copies and near copies the smallest id stays, the passage goes, the secret is a mark.
    want = {i for i in range(160) if i % 4} | {302, 303, 304, 305}
    assert set(got) == want
    assert got[305].text == docs[-1][1] and got[305].n_tokens > 60_000
    assert "[SECRET]" in got[302].text and "0123abcd" not in got[302].text and got[302].n_chars == len(got[302].text)
    codec = bpe.Codec(*bpe.tokenizer())
    for i, r in got.items():
        assert r.round_trip and r.n_tokens == len(r.token_ids) and r.score == "k"
        assert list(r.token_ids) == codec.encode(r.text or "")
        if i != 302:
            assert r.text == docs[i][1] if i < 160 else True
    assert secrets.base_findings(got[302].text) == [] and decontam.words_of(passage)


def test_one_row_of_each_group(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "a b c d e f g", "z"), (None, "a b c d e f g", "n"), (7, None, "p"), (7, None, "p"), (8, "  ", "q"), (9, "other words are here now", "r"), (None, "no id but words enough", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    kept = neardup.keep_first(df, neardup.plan(5, 80))
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, "a b c d e f g"), (7, None), (7, None), (8, "  "), (9, "other words are here now"), (None, "no id but words enough")], key=str)


def test_stages_are_named_and_take_empty_tables(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
