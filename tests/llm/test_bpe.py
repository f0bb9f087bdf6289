import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkredact.llm import bpe

PATH, PATTERN = bpe.tokenizer()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(5)
    alphabet = "abcdeéèñßü  \n\t'’.,0123٣ก่日本🙂\x1c\x85  ​ſK"
    texts = ["", " ", "a" * 20_000, "it's we'll  x", "\n\n\n a", "aaaaaaa aaaaaaab", "<|endoftext|>", "é" * 999]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(600)]


def test_same_ids_as_the_library(reference):
    texts = odd_texts()
    own = bpe.Codec(PATH, PATTERN)
    for _ in range(2):
        ids, counts = own.encode_batch(texts)
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == reference.encode_ordinary(text), text[:50]
        raw, lengths = own.decode_batch(ids, counts)
        assert [bytes(x) for x in np.split(raw, np.cumsum(lengths)[:-1])] == [t.encode() for t in texts]


def test_forgets_and_goes_on(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "LONGEST_IDS", 100)
    own = bpe.Codec(PATH, PATTERN)
    assert all(own.encode(t) == reference.encode_ordinary(t) for t in odd_texts())


def test_every_code_point(reference):
    own = bpe.Codec(PATH, PATTERN)
    texts = ["".join(f"a{chr(c)}b" for c in range(s, min(s + 500, 0x30000)) if not 0xD800 <= c < 0xE000) for s in range(0, 0x30000, 500)]
    assert not [t[1] for t in texts if own.encode(t) != reference.encode_ordinary(t)]
    assert own.find is not bpe.regex.compile(PATTERN).findall


def test_lower_rank_made_by_a_merge_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"abcd": 256, b"ab": 257, b"cd": 258, b"dc": 259}
    assert bpe.MergeReplay(ranks).encode([b"abcdcdx"])[0].tolist() == [256, 258, ord("x")]


def test_query_rows(spark, tmp_path, reference):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (2, "", "y"), (None, "Hello world", None), (3, "ab " * 3000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, token_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, str(tmp_path)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d or 0, len(ids := reference.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t, _ in rows)
    assert got == want


def test_decode_of_what_encode_made(spark):
    texts = odd_texts()[:50] + [None]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, decoded string").repartition(3)
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN, keep=["doc_id", "decoded"]).withColumnRenamed("decoded", "other"), PATH, PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows) == [(i, t or "") for i, t in enumerate(texts)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op9_bpe(spark, str(tmp_path)).count() == 0
