"""Token files, packing: against the library on each whole text, and exact round trips."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing, pieces, token_files
from newsloom.llm.queries import op1_token_files, op8_best_fit_packing

ODD = [
    None, "", " ", "  a  b \n c\t\td ", "x\x1cy \x85z", "don't  stop  \n\n it's 12 34", "Ünïcödé  Ä́ a ́b", "a" * 5000, "日本語 テスト",
    "<|endoftext|> a <|startoftext|>", "a story <|endoftext|> next", "x<|endoftext|>y", "<|EndOfText|> <|", "a\nb\n\nc %%%\n(d)", "\nfirst", "last\n\n",
    "Ende%%%", "it's** 'twas' o'", "a\n\n\nb!\n?c", "one", "one", "!!??  ,.x", "　wide　 space", "end ", "🙂 🙃",
]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, split", [("word_bpe_49k.json", pieces.words), ("byte_bpe_50k.json", pieces.spaced)])
def test_pieces_equal_whole_texts(name, split):
    texts = [t or "" for t in ODD]
    encoder = pieces.library_encoder(public_tokenizers.path(name), split, "<u4")
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, batch=50)]
    assert got == [library(name)(t) for t in texts]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENT", 7)
    text = "ab cd  ef gh\nij  kl mnopqrstuvwx yz " * 3
    encoder = pieces.library_encoder(public_tokenizers.path("byte_bpe_50k.json"), pieces.spaced, "<u4")
    assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == library("byte_bpe_50k.json")(text)


def test_borders_by_select():
    rng = np.random.default_rng(3)
    ids = [np.arange(n, dtype="<u2").tobytes() for n in [1, 1, 5000, *rng.integers(1, 90, 300)]]
    file = token_files.TokenFile(io.BytesIO(token_files.encode_file(np.arange(len(ids)), ids, 2)))
    ends = np.cumsum([len(x) // 2 for x in ids])
    assert file.ends().tolist() == ends.tolist() == [file.end(i) for i in range(len(ids))]
    a, b = file.span(7)
    assert file.ids(a, b).tolist() == np.frombuffer(ids[7], "<u2").tolist()


def test_token_files(spark):
    docs = spark.createDataFrame([(i * 7 % 101, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "y")], "doc_id long, text string, start string")
    folder = token_files.fresh_folder(docs)
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, bytes_per_file=60)
    assert files.count() > 2
    rows = sorted(token_files.read_token_files(files, with_ids=True).collect(), key=lambda r: r.start)
    encode, start = library("word_bpe_49k.json"), 0
    expected = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in expected]
    for row, (_, text) in zip(rows, expected, strict=True):
        ids = np.array([*encode(text), 1], "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += row.n_tokens


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write_token_files(none, public_tokenizers.path("word_bpe_49k.json"), token_files.fresh_folder(none))
    assert token_files.read_token_files(files).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_token_files(spark, sf_dir).collect()}
    encode, start = library("word_bpe_49k.json"), 0
    for doc, text in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array([*encode(text), 1], "<u4").tobytes()
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def one_by_one(sizes, capacity):
    """Sequences of best fit over single documents, largest first."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_as_tight_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(2.5, 1 + seed / 4, 700).astype(int), 1, 100)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    places, seen = {}, dict.fromkeys(counts, 0)
    for size, start, end, sequence, n, offset in packing.best_fit(counts, 100):
        assert start == seen[size]
        seen[size] = end
        for r in range(end - start):
            places.setdefault(sequence + r % n, []).append((offset + size * (r // n), size))
    assert seen == counts
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
    assert len(places) <= 1.02 * one_by_one(sizes.tolist(), 100)


def check_packed(rows, texts, capacity):
    encode, by_doc, sequences = library("byte_bpe_50k.json"), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = np.array([*encode(text), 0], "<u4"), 0
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == capacity for r in own[1:])
        for r in own:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as piece", "'a' as salt")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, with_ids=True).collect()
    check_packed(rows, dict(enumerate(ODD)), 64)


def test_pack_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_best_fit_packing(spark, sf_dir).collect()
    n = check_packed(rows, texts, 2048)
    assert n <= 1.01 * one_by_one([r.length for r in rows], 2048)
