"""Merge replay against the library, and decoding back to the text."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import byte_bpe
from newsloom.llm.queries import op3_byte_bpe
from tests.llm.test_tokens import ODD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(spark, library):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'a' as ids")
    for row in byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect():
        assert row.ids == library.encode_ordinary(ODD[row.doc_id] or "")
        assert bytes(row.decoded).decode() == (ODD[row.doc_id] or "")


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_decode(none, PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ranks = byte_bpe.read_ranks(PATH) if not hasattr(test_any_text, "one") else None
    if ranks:
        test_any_text.one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    raw = next(own.encoder.encode([text]))
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == test_any_text.one.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), max_size=8))
def test_ranks_out_of_order(words):
    """A made-up table in which merges give pairs of lower ranks than their own."""
    tokens = [bytes([b]) for b in range(256)] + [b"ca", b"cab", b"bc", b"bca", b"ab", b"aa", b"aab", b"abc", b"cabc", b"aaa", b"bb", b"abb"]
    ranks = {t: i for i, t in enumerate(tokens)}
    single = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    raw = [w.encode() for w in words]
    assert byte_bpe.Replay(ranks).encode(raw) == [single.encode_ordinary(w) for w in words]


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
