"""Exact and near duplicates against brute force, and odd tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup as E
from textloom.llm import simhash_dedup as S
from textloom.llm.common import buffers, mix, shingles, words
from textloom.llm.graph import components

SF = "/root/testdata/sf0.01"


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert pairs(E.exact_duplicates(docs)) == sorted(con.execute(E.EXACT_DEDUP_SQL).fetchall(), key=str)
    kept = E.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.select("text").distinct().count()


def test_exact_of_odd_rows(table, odd_rows):
    df = table(odd_rows)
    assert pairs(E.exact_duplicates(df)) == sorted([(2, 1), (2, 1), (None, 1), (4, 3)], key=str)
    kept = E.drop_exact_duplicates(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, None, 7, 8, 9, 10], key=str)


def test_nothing(table):
    empty = table([])
    for f in (E.exact_duplicates, S.near_duplicates, E.drop_exact_duplicates, S.drop_near_duplicates):
        assert f(empty).count() == 0


def test_equal_hashes_are_compared_byte_by_byte(spark):
    """With one key for all rows, only the bytes tell them apart."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])], "id int, text string").coalesce(1).withColumn("uid", F.monotonically_increasing_id())
    from textloom.llm.common import written

    got = E.equal_groups(written(df, "test"), "uid", "id", "text", key=F.lit(-5).cast("bigint"))
    assert sorted((r.id, r.keep_id) for r in got.collect()) == [(2, 0), (4, 1), (5, 0)]


@pytest.mark.parametrize("batch", [1, 700, 5000])
def test_extendible_index(tmp_path, batch):
    rng = np.random.default_rng(1)
    index, truth = E.ExtendibleIndex(12, bucket=8), {}
    owner = 0x5A3 << 52
    keys = [int(k) | owner for k in (rng.integers(0, 1 << 52, 3000) % (1 << 51) // 7).tolist() + [5] * 50]
    for row, key in enumerate(keys):
        truth.setdefault(key, []).append(row)
    for lo in range(0, len(keys), batch):
        part = np.array(keys[lo : lo + batch], np.uint64)
        index.extend(part, np.arange(lo, lo + len(part)), np.full(len(part), 3))
    assert index.depth > 5 and len(index.directory) == 1 << index.depth
    buckets = {id(b): b for b in index.directory}.values()
    assert all(b.distinct() <= 8 for b in buckets) and sum(b.distinct() for b in buckets) == len(truth)
    index.save(str(tmp_path / "i"))
    saved = E.SavedIndex(str(tmp_path / "i"))
    assert all(saved.chain(k).tolist() == rows for k, rows in truth.items())
    assert len(saved.chain(owner | 3)) == 0
    rows, counts = saved.heads(np.array([*truth, owner | 3], np.uint64))
    assert rows.tolist() == [r[0] for r in truth.values()] + [-1] and counts.tolist() == [3] * len(truth) + [0]
    E.ExtendibleIndex(4).save(str(tmp_path / "none"))
    assert len(E.SavedIndex(str(tmp_path / "none")).chain(1)) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 8), (3, 1), (20, 19), (19, 18), (18, 17), (17, 16), (30, 3), (7, 7)]
    chain = [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + chain, "a bigint, b bigint"), "test").collect()}
    assert got == {2: 1, 3: 1, 30: 1, 9: 8, 20: 16, 19: 16, 18: 16, 17: 16} | {i: 100 for i in range(101, 161)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


@pytest.fixture(scope="module")
def brute(spark):
    """Ids, signatures, and all pairs of sf0.01 within MAX_BITS."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    sig, has = S.signatures(pa.array([t for _, t in rows]))
    wide, near = sig.view(np.uint64), set()
    for i in range(len(rows)):
        near |= {(i, i + 1 + int(j)) for j in np.flatnonzero(np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(1) <= S.MAX_BITS) if has[i] and has[i + 1 + j]}
    return rows, sig, near


def test_near_matches_brute_force(spark, brute):
    rows, _, near = brute
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = {(rows[i][0], rows[find(i)][0]) for i in range(len(rows)) if find(i) != i}
    got = {tuple(r) for r in S.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got & wanted) >= 0.98 * len(wanted) and len(got - wanted) <= 0.02 * len(wanted)


def test_candidates_meet_nine_tenths_of_near_pairs(brute):
    _, sig, near = brute
    budget = np.arange(1, S.CHAIN + 1) * S.MAX_BITS / S.SEGMENTS
    met = 0
    for a, b in near:
        d = np.bitwise_count(sig[a] ^ sig[b]).astype(int)
        met += any(not d[i : i + S.AGREE].any() and (np.cumsum(np.roll(d, -i)[: S.CHAIN]) <= budget).all() for i in range(0, S.SEGMENTS, S.AGREE))
    assert met >= 0.98 * len(near) and len(near) > 150


def plain_signature(text):
    """Every occurrence of every three words votes for every bit, one at a time."""
    off, data = buffers(pa.array([text]))
    hashes, _, _, first = words(data, off)
    runs, _ = shingles(hashes, first, S.SHINGLE)
    out = []
    for j in range(S.SEGMENTS):
        sums = [0.0] * S.BITS
        for r in runs.tolist():
            v = ((r ^ int(S._SEED[j])) * int(S._MUL[j])) & (1 << 64) - 1
            vote = int(mix(np.array([v], np.uint64))[0])
            for bit in range(S.BITS):
                sums[bit] += (1 if vote >> bit & 1 else -1) / (v + 1.0) ** 4
        out.append(sum(1 << bit for bit in range(S.BITS) if sums[bit] > 0))
    return out


def test_every_feature_votes(brute):
    rows, sig, _ = brute
    pick = [i for i in range(0, len(rows), 53) if len(rows[i][1]) < 3000] + [i for i, (_, t) in enumerate(rows) if len(t.split()) < 6][:5]
    for i in pick:
        assert sig[i].tolist() == plain_signature(rows[i][1])


def test_forest_spans_the_pairs_of_a_bucket():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (6, S.SEGMENTS)).astype(np.uint16)
    rows = np.repeat(base, 5, axis=0)
    rows[:, :2] = 7
    rows[::2, 9] ^= np.uint16(0b1011)
    edges = S.forest(rows, 0)
    assert len(edges) == 24 and all(a // 5 == b // 5 for a, b in edges)


def test_crowded_buckets_are_compared_whole(spark):
    """In a crowd that is cut into groups, each two rows share a block."""
    df = spark.range(90).selectExpr("id AS uid", "array_repeat(int(5), 16) AS sig").union(spark.createDataFrame([(100, [*range(16)]), (101, [0, *range(20, 35)]), (102, [*range(50, 66)])], "uid bigint, sig array<int>"))
    blocks = {}
    for r in S.candidates(df, crowd=8).collect():
        blocks.setdefault((r.pos, r.seg, r.block), set()).add(r.uid)
    assert max(map(len, blocks.values())) < 45 and len({k[2] for k in blocks}) > 60
    pairs = {(a, b) for k, v in blocks.items() if k[0] == 3 for a in v for b in v if a < b}
    assert pairs == {(a, b) for a in range(90) for b in range(a + 1, 90)}
    assert [v for k, v in blocks.items() if k[1] == 0] == [{100, 101}] and not any(102 in v for v in blocks.values())


def test_crowds_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = pairs(S.near_duplicates(docs))
    monkeypatch.setattr(S, "CROWD", 2)
    assert pairs(S.near_duplicates(docs)) == whole and len(whole) > 10


def test_near_of_edited_copies(spark):
    """Copies with a changed word in twenty are caught; documents of their own, and those that share a passage, are left."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i:x}" for i in rng.integers(0, 1 << 40, 4000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows, truth = [], {}
    for i in range(150):
        text = list(rng.choice(vocabulary, 300))
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            copy = [str(rng.choice(vocabulary)) if rng.random() < 0.05 else w for w in text]
            rows.append((1000 + i, " ".join(copy).upper().replace(" ", ",\n ", 20)))
            truth[1000 + i] = i
        if i % 3 == 1:
            rows[-1] = (i, passage + " " + rows[-1][1])
    got = dict(tuple(r) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert len(truth.keys() & got.keys()) >= 0.97 * len(truth) and all(truth.get(a) == b for a, b in got.items())


def test_near_of_odd_rows(table, odd_rows):
    df = table(odd_rows)
    assert pairs(S.near_duplicates(df)) == sorted([(2, 1), (2, 1), (None, 1), (8, 7)], key=str)
    kept = S.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, None, 7, 9, 10], key=str)


def test_input_that_isnt_stable_is_written(spark):
    df = spark.createDataFrame([(i, f"text {i % 5} of some words") for i in range(40)], "doc_id bigint, text string").repartition(7).sample(0.99, seed=1)
    assert E.drop_exact_duplicates(df).count() == 5
    assert S.drop_near_duplicates(df).count() == 5


def test_rows_of_files_are_numbered_in_place(spark, tmp_path):
    """Nothing is written for a plain scan, whose rows have the same numbers at each read; any other plan is written."""
    from textloom.llm import common

    at = str(tmp_path / "od d%")
    spark.range(50).selectExpr("id", "id % 7 AS number", "'x' AS `file`", "'y' AS `a.b`").repartition(3).write.parquet(at)
    begun, rows = common.made(), common.numbered(spark.read.parquet(at), "uid")
    assert common.made() == begun and rows.columns == ["id", "number", "file", "a.b", "uid"]
    first = {r.id: r.uid for r in rows.collect()}
    spark.conf.set("spark.sql.files.minPartitionNum", "9")
    try:
        assert {r.id: r.uid for r in rows.select("id", "uid").collect()} == first and len(set(first.values())) == 50
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    for other in (spark.read.parquet(at).where("id < 30"), spark.range(5).toDF("id"), spark.read.parquet(at).withColumn("_metadata", F.lit(1)), spark.read.parquet(at).limit(0)):
        begun = common.made()
        assert common.numbered(other, "uid").select("uid").distinct().count() == other.count() and common.made() == begun + 1
    spark.read.parquet(at).where("id < 0").coalesce(1).write.parquet(str(tmp_path / "none"))
    assert common.numbered(spark.read.parquet(str(tmp_path / "none")), "uid").count() == 0


def test_splits_that_change_between_reads(spark, tmp_path, monkeypatch):
    """Each written table is followed by reads with other splits, as when executors come or go."""
    texts = [" ".join(f"w{(i % 30) * 40 + k}" for k in range(40)) for i in range(64)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    name, turn = "spark.sql.files.minPartitionNum", iter(range(100))
    for module in (E, S):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, what, real=real: (real(df, what), spark.conf.set(name, str((1, 8)[next(turn) % 2])))[0])
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        for drop, find in ((E.drop_exact_duplicates, E.exact_duplicates), (S.drop_near_duplicates, S.near_duplicates)):
            spark.conf.set(name, "8")
            assert sorted(r.doc_id for r in drop(docs).collect()) == list(range(30))
            spark.conf.set(name, "8")
            assert sorted(r.doc_id for r in find(docs).collect()) == list(range(30, 64))
    finally:
        spark.conf.unset(name)
