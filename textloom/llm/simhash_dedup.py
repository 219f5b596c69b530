"""SimHash near-duplicates, with pigeonring filtering of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, batched, buffers, chunks, col, fresh, mix, numbered, partitions, shingles, small, words, written
from .graph import components

#: A signature is SEGMENTS segments of 16 bits.
SEGMENTS, BITS = 32, 16
#: Words in a feature.
SHINGLE = 3
#: Signatures that differ in at most this many of the 512 bits are near-duplicates.
MAX_BITS = 144
#: Pairs are met where AGREE consecutive segments, from every second one on, are equal. Of CHAIN consecutive segments
#: from there the cumulative differences must stay within the proportional budget.
AGREE, CHAIN = 2, 8
#: Signatures that a task compares with each other; more with the same segments are spread over tasks, each pair in one.
CROWD = 2048
#: Features under this share of their text's greatest weight are summed only where they could decide a bit.
LIGHT = 1 / 1024

_SEED = mix(np.arange(1, SEGMENTS + 1, dtype=U) * U(0x1234567))
_MUL = mix(np.arange(100, 100 + SEGMENTS, dtype=U)) | U(1)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 of each feature for each bit of a segment."""
    return np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8)[:, : BITS // 8], axis=1, bitorder="little").astype(np.float64) * 2 - 1


def signatures(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of SEGMENTS 16-bit words for each text, and which texts have any word.

    A bit is the sign of the sum, over every occurrence of every feature of the whole text, of +1 or -1 by the feature's
    hash, times its weight: a hashed number with a heavy tail, 1 / u^4 for u even in (0, 1), another for each segment. So
    a changed word disturbs the few segments where it weighs much and leaves the others as they are. Occurrences of
    little weight are added up only for texts in which they could change a bit that the others decide.
    """
    off, data = buffers(array)
    out, has = np.zeros((len(off) - 1, SEGMENTS), np.uint16), np.zeros(len(off) - 1, bool)
    for lo, hi in chunks(off):
        hashes, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        runs, first = shingles(hashes, first, SHINGLE)
        counts = np.diff(first)
        ok = counts > 0
        has[lo:hi] = ok
        if not ok.any():
            continue
        starts, counts = first[:-1][ok], counts[ok]
        rows = lo + np.flatnonzero(ok)
        text = np.repeat(np.arange(len(starts), dtype=np.int32), counts)
        weight = np.empty(len(runs))
        for j in range(SEGMENTS):
            v = runs ^ _SEED[j]
            v *= _MUL[j]
            weight[:] = v
            weight += 1.0
            np.multiply(weight, weight, out=weight)
            np.multiply(weight, weight, out=weight)
            np.divide(1.0, weight, out=weight)
            total = np.add.reduceat(weight, starts)
            heavy = np.flatnonzero(weight >= np.repeat(total * LIGHT, counts))
            of, w = text[heavy], weight[heavy]
            at = np.searchsorted(of, np.arange(len(starts) + 1))
            some = at[1:] > at[:-1]
            sums = np.zeros((len(starts), BITS))
            sums[some] = np.add.reduceat(_votes(v[heavy]) * w[:, None], at[:-1][some], axis=0)
            rest = total - np.bincount(of, w, len(starts))
            # the margin is far above what rounding can do
            open_ = (np.abs(sums) <= (rest + 1e-9 * total)[:, None]).any(axis=1)
            if open_.any():
                every = np.flatnonzero(open_[text])
                begin = np.flatnonzero(np.r_[True, text[every][1:] != text[every][:-1]])
                sums[open_] = np.add.reduceat(_votes(v[every]) * weight[every][:, None], begin, axis=0)
            out[rows, j] = np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint16)[:, 0]
    return out, has


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def simhash(text: pa.Array) -> pa.Array:
    """The signature of each text, two segments to a number; null where it has no word."""
    sig, has = signatures(text)
    pairs = sig.view(np.int32)
    values = pa.array(pairs.ravel()[np.repeat(has, pairs.shape[1])], pa.int32())
    offsets = np.concatenate(([0], np.cumsum(has))) * pairs.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(~has, False)), values)


def forest(sig: np.ndarray, at: int, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that span the near-duplicate graph of rows that agree in the segments from at on.

    Each pair of rows that earlier edges don't connect meets the chain test, from segment at on round the ring, and
    then the full Hamming check.
    """
    n = len(sig)
    ring = np.ascontiguousarray(np.roll(sig, -at, axis=1))
    wide = ring.view(np.uint64)
    budget = np.arange(1, CHAIN + 1) * max_bits / SEGMENTS
    group, out = np.arange(n), []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not len(rest):
            continue
        near = np.cumsum(np.bitwise_count(ring[rest, :CHAIN] ^ ring[i, :CHAIN]), axis=1)
        rest = rest[(near <= budget).all(axis=1)]
        rest = rest[np.bitwise_count(wide[rest] ^ wide[i]).sum(axis=1) <= max_bits]
        while len(rest):
            j = int(rest[0])
            out.append((i, j))
            group[group == group[j]] = group[i]
            rest = rest[group[rest] != group[i]]
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the rows of each block; rows come sorted by (pos, seg, block), and a block may span batches."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: tuple | None = None

    def flush(key: np.ndarray, uid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        a, b = [], []
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(key)], strict=True):
            for i, j in forest(sig[lo:hi], AGREE * int(key[lo, 0])):
                a.append(uid[lo + i])
                b.append(uid[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kind)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        sig = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint16).reshape(-1, SEGMENTS)
        now = (key, batch.column(3).to_numpy(zero_copy_only=False), sig)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        other = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield flush(*(x[:last] for x in now))
        held = tuple(x[last:].copy() for x in now)
    if held is not None:
        yield flush(*held)


def candidates(unique: DataFrame, crowd: int | None = None) -> DataFrame:
    """(pos, seg, block, uid): the rows of unique (uid, sig) that are to be compared with those of the same block.

    Buckets are counted before anything is brought together, so that those of one row go at once. A bucket of more than
    `crowd` rows is cut into groups by a hash of uid, and has a block for every two of them: each pair of its rows is in
    a block, and no block has more than about two groups.
    """
    every = unique.select("uid", F.posexplode("sig").alias("pos", "seg"))
    # as many shared buckets as documents, nearly, so they are never broadcast; a skewed one's rows may be split
    sizes = every.groupBy("pos", "seg").agg(F.count("*").alias("n")).where("n > 1")
    met = every.join(sizes, ["pos", "seg"]).withColumn("groups", F.ceil(F.col("n") / F.lit(float(crowd or CROWD))).cast("int"))
    group = F.pmod(F.xxhash64("uid"), F.col("groups")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda k: F.least(group, k).cast("bigint") * F.col("groups") + F.greatest(group, k))
    return met.select("pos", "seg", F.explode(blocks).alias("block"), "uid")


def near_groups(rows: DataFrame, uid: str, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, keep_uid, keep_id) of each row of rows that isn't the one its group keeps."""
    signed = batched(rows).select(col(uid).alias("uid"), col(id_col).alias("id"), simhash(col(text_col)).alias("sig"))
    # written before the filter, which else would have the signatures computed a second time, for itself
    signed = written(signed, "simhash").where("sig IS NOT NULL")
    unique = written(signed.groupBy("sig").agg(F.min("uid").alias("uid")), "simhash-unique")
    key = ["pos", "seg", "block"]
    met = candidates(unique).join(unique, "uid").select(*key, "uid", "sig").repartition(partitions(rows), *key).sortWithinPartitions(*key, "uid")
    rooted = components(met.mapInArrow(_edges, "a bigint, b bigint"), "simhash-edges")
    rooted = rooted.withColumnRenamed("node", "uid")
    # members of one signature hang on its least uid; roots that are in no edge stand for themselves
    same = signed.join(unique.withColumnRenamed("uid", "rep"), "sig").select("uid", "id", "rep")
    of = same.join(rooted.withColumnRenamed("uid", "rep"), "rep", "left").select("uid", "id", F.coalesce("root", "rep").alias("root"))
    first = F.struct(F.col("id").isNull(), "id", "uid")
    keep = of.groupBy("root").agg(F.count("*").alias("n"), F.min(first).alias("keep")).where("n > 1").select("root", F.col("keep.id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"))
    return of.join(keep, "root").where("uid <> keep_uid").select("uid", "id", "keep_uid", "keep_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) for each document that is a near-duplicate, with the document that its group keeps.

    Groups are the connected components of pairs whose 512-bit signatures differ in at most MAX_BITS bits; a group
    keeps its least doc_id, nulls last, and of equal ones the first row. The search is approximate: it meets pairs that
    agree in AGREE segments in a row and pass the chain test from there; all that agree are compared, however many they
    are. Signatures ignore case, punctuation and
    white space. Null texts and texts without a word (empty ones too) are no one's near-duplicate. Repeated rows are
    near-duplicates of each other, each with a row of its own here. Null ids are carried as null. An empty table has no
    near-duplicates. Other columns, whatever their names, play no part; very long texts are read whole.
    """
    (uid,) = fresh(docs, "uid")
    # the rows are read once, for the signatures that are written
    found = near_groups(docs.withColumn(uid, F.monotonically_increasing_id()), uid, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "keep_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all its columns and their names, but for those that near_duplicates lists; one row of each group stays.

    The row that stays is the one with the least id, nulls last, and of equal ones the first. Null texts and texts
    without a word stay, each of them. Repeated rows leave one. Null ids and nulls in other columns are carried as they
    are; long texts are read whole. An empty table gives none.
    """
    (uid,) = fresh(docs, "uid")
    rows = numbered(docs, uid)
    lost = written(near_groups(rows, uid, id_col, text_col).select(F.col("uid").alias(uid)), "simhash-lost")
    return rows.join(small(lost, 40), uid, "left_anti").select(*map(col, docs.columns))
