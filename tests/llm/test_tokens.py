"""Tokenizers against a public library, and exact round trips."""

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe, bpe_codec, token_counts

SF = "/root/testdata/sf0.01"
PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [
    "", "  a  b", "\n\n x\n", "a　b\x1c c\x85d", " 's don't I'LL we'll  ", "x" * 5000, "日本語テキスト  123abc", "   q", "😀😀 hi", "a" * 300 + " " + "ab" * 400, "!!??  --\t\tz", "\xa0\xa0x", "<|endoftext|> tail",
    " ", "\n", "a \nb", "a\n b", "tab\t x", "\x1c\x1d x\x1f", "end  ", "é" * 3000, "aaaa" * 600 + "\n" + "0123456789" * 300,
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    out = []
    for _, _, ids, n in encoder.encode(pa.array(texts)):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_same_ids_as_the_public_library(ranks, public):
    lexicon = bpe_codec.Lexicon.build([" the", " of", "ing", " thing", "the", "thing.\nThe", "é"], ranks)
    assert encoded(bpe_codec.Encoder(lexicon, ranks), TEXTS) == [public.encode_ordinary(t) for t in TEXTS]


def test_merging_agrees(ranks, public):
    words = ["", *"ab", *{w for t in TEXTS for w in bpe.pretokens(t)}]
    symbols, n = bpe.ArrayMerger(ranks).merge([w.encode() for w in words])
    parts = np.split(symbols, np.cumsum(n)[:-1])
    for w, ids in zip(words, parts, strict=True):
        assert ids.tolist() == bpe.merge_exactly(w.encode(), ranks) == public.encode_ordinary(w), w[:40]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'abeinrst　\xa0\x1c1")), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    ranks = bpe.load_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    if not hasattr(test_any_text, "encoder"):
        test_any_text.encoder = bpe_codec.Encoder(bpe_codec.Lexicon.build([" a", "b c"], ranks), ranks)
        test_any_text.counter = token_counts.Counter(ranks)
    got = encoded(test_any_text.encoder, texts)
    assert got == [own.encode_ordinary(t) for t in texts]
    assert test_any_text.counter.count(pa.array(texts)).tolist() == [len(x) for x in got]
    decoder = bpe_codec.Decoder(ranks)
    data, at = decoder.decode(np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got]))
    assert [data[at[i] : at[i + 1]].tobytes().decode() for i in range(len(texts))] == texts


def test_lexicon(ranks, tmp_path):
    words = sorted({f"{a}{b}{c}" for a in ("", "re", "un", "in") for b in ("do", "tie", "pay", "form") for c in ("", "ing", "able", "ed", "s")})
    lexicon = bpe_codec.Lexicon.build(words, ranks)
    lexicon.save(str(tmp_path))
    lexicon = bpe_codec.Lexicon.load(str(tmp_path))
    assert isinstance(lexicon.arcs, np.memmap)
    assert lexicon.numbers([w.encode() for w in words]).tolist() == list(range(len(words)))
    assert (lexicon.numbers([b"", b"rebuild", b"doin", b"doings", b"\xff"]) == -1).all()
    # shared suffixes: far fewer states than a tree of prefixes has
    assert len(lexicon.final) < 30
    # no two states have the same suffixes
    def suffixes(s):
        out = {""} if lexicon.final[s] else set()
        for arc, to in zip(lexicon.arcs.tolist(), lexicon.target.tolist()):
            if arc // 256 == s:
                out |= {chr(arc % 256) + x for x in suffixes(to)}
        return out

    languages = [frozenset(suffixes(s)) for s in range(len(lexicon.final))]
    assert len(set(languages)) == len(languages)
    nothing = bpe_codec.Lexicon.build([], ranks)
    assert nothing.numbers([b"a", b""]).tolist() == [-1, -1]


def test_documents(spark, public):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = bpe_codec.encode(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert all(r.token_ids == public.encode_ordinary(r.text) for r in rows[::5])
    back = bpe_codec.decode(bpe_codec.encode(docs)).join(docs.withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text = was").count() == docs.count()
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in rows}


def test_frequent_words_are_those_of_all_texts(spark):
    df = spark.createDataFrame([("a b b c",), ("b c",), (None,), ("",), ("c b",)] * 5, "t string").repartition(3)
    # " b" fifteen times, " c" ten times, the others five times
    assert set(bpe_codec.frequent_words(df, "t", least=6)) == {" b", " c"}
    assert set(bpe_codec.frequent_words(df, "t", least=1, most=4)) == {" b", " c"}
    assert set(bpe_codec.frequent_words(df, "t", least=1)) == {" b", " c", "a", "b", "c"}
    assert bpe_codec.frequent_words(df.limit(0), "t") == []


def test_odd_rows(table, odd_rows):
    df = table(odd_rows)
    rows = sorted(bpe_codec.encode(df).collect(), key=str)
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[3].token_ids == [] and by[3].round_trip and by[5].token_ids is None and by[5].n_tokens is None and by[5].round_trip is None
    assert by[7].round_trip and by[10].round_trip
    n = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect() if r.doc_id}
    assert n == {k: r.n_tokens for k, r in by.items()}
    assert bpe_codec.encode(table([])).count() == 0 and token_counts.count_tokens(table([])).count() == 0
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df)).collect() if r.doc_id}
    assert back[3] == "" and back[5] is None and back[10] == odd_rows[-1][1]
