import random

from sparkredact.llm import decontam


def brute(text, items):
    """n_words, hit positions and item ids by trying every window at every place."""
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = decontam.words_of(item_text)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        found.add(item)
    return len(words), len(hit), sorted(found)


def fixture():
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "B", "c9", "é", "дом", "x"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 5, 13, 14, 30, 60, 200])] + [(7, None), (8, ""), (8, "!!"), (None, " ".join(word() for _ in range(20))), (3, "only here")]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if d % 3 == 0:
            own = (rng.choice(items)[1] or "").split()
            text += ", " + "-".join(own[rng.randint(0, 3) :]).upper().replace("É", "é").replace("ДОМ", "дом") + ". " + text
        docs.append((d, text))
    return docs + [(60, None), (61, ""), (61, ""), (None, "a b"), (62, "x " * 5000)], items


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = fixture()
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d or -1, *brute(t, items)) for d, t in docs)
    for block_words in (decontam.BLOCK_WORDS, 40):
        rows = decontam.find(docs_df, bench, block_words=block_words).withColumn("n_hit", decontam.n_hit()).collect()
        got = sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r.item_ids)) for r in rows)
        assert got == want


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "clean words", "n"), (2, "a b c d", None), (3, None, "k")], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "clean words", "n"), (3, None, "k")]


def test_contamination_rule():
    assert decontam.words_of("Ab-c\tÉ9 _x") == [b"ab", b"c", "É9".encode(), b"x"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.find(docs, bench).count() == 0
    assert decontam.find(one, bench).collect()[0].n_words == 2
