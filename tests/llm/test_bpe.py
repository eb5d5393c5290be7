import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def mine():
    return bpe.Encoder(bpe.read_ranks(bpe.vocabulary()))


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_equals_merging_by_rank(mine, other, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    r = random.Random(3)
    texts += ["".join(r.choice("abcde etaoin  \n\t.,'-_éß漢😀\u200b<|>019") for _ in range(r.randrange(1, 80))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "<|endoftext|>", " " * 2000, "1" * 999, "é" * 500, "\x00\x01", "".join(r.choice("ab") for _ in range(9000))]
    for a, b in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(a) == b.ids
        assert mine.decode(b.ids) == a


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    e = bpe.encoder(bpe.vocabulary())
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert e.decode(e.encode(text)) == text


def test_json_and_rank_file_agree(mine):
    assert bpe.read_ranks(bpe.vocabulary(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))) == mine.ranks


def test_rows(spark, mine):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "Hello world", "x"), (4, "long " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(i, mine.encode(t)) for i, t, _ in rows]
    assert [r.n_tokens for r in bpe.count_tokens(df).collect()] == [len(mine.encode(t)) for _, t, _ in rows]
    assert [r.text for r in bpe.decode(bpe.encode(df)).collect()] == [t or "" for _, t, _ in rows]
    empty = df.limit(0)
    assert bpe.encode(empty).collect() == [] and bpe.count_tokens(empty).collect() == []
