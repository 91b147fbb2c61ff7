"""Byte-level BPE against the tiktoken library, and as a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillspark.llm import bytebpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "B", "the", "1", "٣", " ", " ", "  ", "\n", "\t", "'s", "'ll", "é", "　", "\xa0", "!", "—", "\x1c", "\x85", "日本", "<|endoftext|>", "\r\n", "𝒳", "é"]


def own(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def vocab(ranks):
    return bytebpe.vocabulary(ranks, public_tokenizers.PATTERN)


def test_ids_are_those_of_the_library(ranks, vocab, monkeypatch):
    rng, want, whole = random.Random(1), own(ranks), bytebpe.windows
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(bytebpe, "windows", lambda text, size=size: whole(text, size))
        coder = bytebpe.Encoder(vocab)
        for _ in range(1500):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
            assert coder.encode(text).tolist() == want.encode_ordinary(text), repr(text)


def test_caches_that_overflow_change_nothing(ranks, vocab, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHED", 3)
    monkeypatch.setattr(bytebpe, "CACHED_CHARS", 5)
    rng, want, coder = random.Random(2), own(ranks), bytebpe.Encoder(vocab)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeé1'") for _ in range(rng.randrange(12))) for _ in range(20))
        assert coder.encode(text).tolist() == want.encode_ordinary(text)


def test_very_long_texts(ranks, vocab):
    rng, coder = random.Random(3), bytebpe.Encoder(vocab)
    for text in ["x" * 300_000, " " * 300_000, "".join(rng.choice("ab cé\n") for _ in range(300_000)), "ab \n" * 100_000]:
        ids = coder.encode(text)
        assert b"".join(map(vocab.tokens.__getitem__, ids.tolist())).decode() == text
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(400_000))
    assert len(text) > bytebpe.WINDOW and coder.encode(text).tolist() == own(ranks).encode_ordinary(text)


def test_tokens_that_joins_dont_lead_to_and_gaps_in_ranks():
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"ab": 1000, b"bc": 2000, b"abcd": 3000, b"de": 10}
    v = bytebpe.vocabulary(ranks, r"\w+|\W+")
    assert [bytes(x, "latin-1") for x in ("abcd",)] == [t for t in v.tokens if bytebpe.named(t) in v.whole]
    coder, want = bytebpe.Encoder(v), own(ranks, r"\w+|\W+")
    for text in ("abcd", "abcde", "xabcd", "abc", "abcd abcd", "", "ab\nbc de"):
        assert coder.encode(text).tolist() == want.encode_ordinary(text)


def test_a_vocabulary_must_have_all_bytes(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="single bytes"):
        bytebpe.read_ranks(str(tmp_path / "v"))


def test_digests_of_odd_rows(spark, make_docs, ranks, vocab):
    rows = [(1, None), (2, ""), (3, "one  two\n three"), (3, "one  two\n three"), (None, "é" * 50_000), (5, " "), (6, "same"), (7, "same")]
    got = bytebpe.token_digests(make_docs(rows), vocab)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want, hexed = own(ranks), lambda x: hashlib.sha256(x).hexdigest()
    expected = []
    for i, text in rows:
        ids = want.encode_ordinary(text or "")
        expected.append((i, len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((text or "").encode())))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert bytebpe.token_digests(make_docs([]), vocab).count() == 0


def test_columns_that_clash_are_replaced(spark, vocab):
    df = spark.createDataFrame([("a", [5], "hello world")], "raw string, ids array<int>, text string")
    out = bytebpe.decode(bytebpe.encode(df, vocab), vocab)
    assert sorted(out.columns) == ["ids", "raw", "text"]
    row = out.first()
    assert bytes(row.raw) == b"hello world" and row.ids == bytebpe.Encoder(vocab).encode("hello world").tolist()
    assert spark.createDataFrame([(None,)], "ids array<int>").transform(lambda x: bytebpe.decode(x, vocab)).first().raw == b""
    with pytest.raises(Exception, match="no token has the id"):
        bytebpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), vocab).collect()


def test_query_over_a_whole_table(spark, ranks):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.queries()["op13_byte_bpe"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = own(ranks)
    assert len(got) == len(texts)
    for r in texts:
        ids = np.array(want.encode_ordinary(r.text or ""))
        mine = got[r.doc_id]
        assert (mine.n_tokens, mine.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert mine.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
