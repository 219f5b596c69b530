"""The pipeline's stages, each on its predecessor's written result, against brute force."""

import importlib
import os

import duckdb
import numpy as np
import pyarrow as pa
import tiktoken
from test_text import naive_language
from test_tokens import PATTERN

import __spark_entry__
import corpus_pipeline
from textloom.llm import bpe, common, exact_dedup, language_id, mixing, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    read = {n: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for n, df in seen.items() if n != "bpe_encode"}
    assert len(set(read["exact_dedup"].values())) == len(read["exact_dedup"]) == len(set(read["language_id"].values()))
    assert simhash_dedup.near_duplicates(seen["simhash_near_dedup"]).count() == 0 and exact_dedup.exact_duplicates(seen["simhash_near_dedup"]).count() == 0
    assert set(read["mix_sources"]) <= set(read["simhash_near_dedup"]) <= set(read["exact_dedup"]) <= set(read["language_id"])
    ranks = bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    rows = seen["bpe_encode"].collect()
    assert len(rows) == seen["mix_sources"].count()
    for r in rows[:40]:
        assert r.token_ids == [i for w in bpe.pretokens(read["mix_sources"][r.doc_id]) for i in bpe.merge_exactly(w.encode(), ranks)]


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against a slow version of its own."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    model = language_id.fit(docs)
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(tuple(r) for r in docs.collect())
    rows = [r for r in rows if naive_language(model, r[1])[0] != "und"]
    assert seen["language_id"] == rows
    first = {}
    for r in rows:
        first.setdefault(r[1], r)
    rows = sorted(first.values())
    assert seen["exact_dedup"] == rows
    sig, has = simhash_dedup.signatures(pa.array([r[1] for r in rows]))
    root = [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if has[i] and has[j] and np.bitwise_count(sig[i] ^ sig[j]).sum() <= simhash_dedup.MAX_BITS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    assert seen["simhash_near_dedup"] == rows
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/simhash_near_dedup/*.parquet'")
    rows = sorted(r[:-1] for r in con.execute(mixing.MIX_SQL).fetchall())
    assert seen["mix_sources"] == rows
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"), special_tokens={})
    assert seen["bpe_encode"] == sorted((r[0], ids, len(ids), True) for r in rows for ids in [own.encode_ordinary(r[1])])


def test_run_gives_the_last_stage(spark):
    begun = common.made()
    out = corpus_pipeline.run(spark, SF)
    # the last stage's input, and what it made itself
    assert [at.rsplit("/", 1)[1].rsplit("-", 1)[0] for at in common._MADE[begun:]] == ["pipeline-mix_sources", "lexicon", "words"]
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.where("NOT round_trip").count() == 0


def test_stages_of_odd_rows(table, odd_rows, spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage, as the docstrings say."""
    docs = table([*odd_rows, *[(100 + i, f"{odd_rows[0][1]} and then it ran away {i}", "en", "a", None) for i in range(30)]])
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_encode":
            assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert not {3, 4, 5} & set(left[0]) and left[0].count(2) == 2 and None in left[0]
    assert sorted(i for i in left[1] if i is not None and i < 100) == [i for i in sorted(set(left[0]) - {None, 2}) if i < 100] and len(left[1]) == len(set(left[1]))
    assert 8 not in left[2] and {1, 7} <= set(left[2]) <= set(left[1]) and set(left[3]) <= set(left[2])
    assert docs.count() == len(left[3]) and docs.where("NOT round_trip").count() == 0


def test_stages_of_nothing(table, spark):
    docs = table([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_folders_are_released(spark, tmp_path):
    begun = common.made()
    one, two = (common.written(spark.range(5), n) for n in ("one", "two"))
    common.release(spark, begun, keep=(two,))
    assert not os.path.exists(common.mounted(one.written_at)) and two.count() == 5 and common.made() == begun + 1
    common.discard(two)
    assert not os.path.exists(common.mounted(two.written_at)) and common.made() == begun


def test_entry():
    found = importlib.reload(__spark_entry__).queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
