"""Exact duplicates, found through an extendible-hash index on shared files."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, batched, col, fresh, mounted, numbered, partitions, shared_dir, small, written

#: Keys that a bucket holds before it splits.
BUCKET = 1024
#: Index files that a worker holds open.
OPEN = 64


def owner_bits(partitions: int) -> int:
    """Leading bits of a key that name its owner: some four owners to a partition, so that owners stay small as clusters and inputs grow."""
    return max(4, (4 * partitions - 1).bit_length())


class Bucket:
    """Entries (key, row, count) whose keys share their leading depth bits, sorted by key; entries of equal keys are a chain, in the order in which they came."""

    __slots__ = ("counts", "depth", "keys", "rows")

    def __init__(self, depth: int, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        self.depth, self.keys, self.rows, self.counts = depth, keys, rows, counts

    def distinct(self) -> int:
        return int((self.keys[1:] != self.keys[:-1]).sum()) + 1 if len(self.keys) else 0


class ExtendibleIndex:
    """Extendible hashing of 64-bit keys of one owner: the bits after the owner's select the directory's slot.

    A bucket with more than `bucket` keys splits on its next bit; where its depth is the directory's, the directory
    doubles first. Equal keys chain their rows. owned: leading bits that all keys of the owner share; keys are told
    apart by the others, after which a bucket may grow.
    """

    def __init__(self, owned: int, bucket: int = BUCKET):
        none = np.zeros(0, np.int64)
        self.owned, self.bucket, self.depth, self.directory = owned, bucket, 0, [Bucket(0, none.view(np.uint64), none, none)]

    def slots(self, keys: np.ndarray, depth: int) -> np.ndarray:
        return ((keys << np.uint64(self.owned)) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)

    def extend(self, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
        """Adds entries; those of a bucket come together and split it as often as it needs."""
        order = np.argsort(keys, kind="stable")
        keys, rows, counts = keys[order], rows[order], counts[order]
        slots = self.slots(keys, self.depth)
        cuts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(keys) else []
        # a bucket's slots lie side by side, so its entries do too
        parts: list[tuple[Bucket, int]] = []
        for lo in cuts:
            if not parts or parts[-1][0] is not self.directory[slots[lo]]:
                parts.append((self.directory[slots[lo]], int(lo)))
        for (at, lo), hi in zip(parts, [*(lo for _, lo in parts[1:]), len(keys)], strict=True):
            joined = np.concatenate((at.keys, keys[lo:hi]))
            by = np.argsort(joined, kind="stable")
            at.keys, at.rows, at.counts = joined[by], np.concatenate((at.rows, rows[lo:hi]))[by], np.concatenate((at.counts, counts[lo:hi]))[by]
            self._split(at)

    def _split(self, at: Bucket) -> None:
        todo = [at]
        while todo:
            at = todo.pop()
            if at.distinct() <= self.bucket or at.depth >= 64 - self.owned:
                continue
            if at.depth == self.depth:
                self.directory = [b for b in self.directory for _ in range(2)]
                self.depth += 1
            half = int(np.searchsorted(self.slots(at.keys, at.depth + 1) & 1, 1))
            low, high = (Bucket(at.depth + 1, at.keys[s], at.rows[s], at.counts[s]) for s in (slice(half), slice(half, None)))
            room = 1 << (self.depth - at.depth)
            first = int(self.slots(at.keys[:1], at.depth)[0]) * room
            self.directory[first : first + room] = [low] * (room // 2) + [high] * (room // 2)
            todo += [low, high]

    def save(self, path: str) -> None:
        """One file: owner's bits, directory depth, slots, then bucket pages of keys, rows and counts. Written aside and renamed, so a repeated task replaces it whole."""
        at: dict[int, int] = {}
        pages = []
        for b in self.directory:
            if id(b) not in at:
                at[id(b)] = len(at)
                pages.append(b)
        slots = np.array([at[id(b)] for b in self.directory], np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(b.keys) for b in pages]))).astype(np.int64)
        head = np.array([self.owned, self.depth, len(slots), len(pages), int(bounds[-1])], np.int64)
        aside = f"{path}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            for part in (head, slots, bounds, *(b.keys for b in pages), *(b.rows for b in pages), *(b.counts for b in pages)):
                f.write(part.tobytes())
        os.replace(aside, path)


class SavedIndex:
    """A saved index, memory-mapped: a lookup touches the directory's slot and one bucket's page."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.int64, "r")
        self.owned, self.depth, slots, buckets, keys = (int(x) for x in raw[:5])
        ends = np.cumsum([5, slots, buckets + 1, keys, keys, keys])
        self.slots, self.bounds, k, self.rows, self.counts = (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        self.keys = k.view(np.uint64)

    def _first(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's chain begins in its bucket's page, and whether it is there; a binary search of all at once."""
        slot = ((keys << np.uint64(self.owned)) >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)
        page = self.slots[slot]
        lo, end = np.array(self.bounds[page]), self.bounds[page + 1]
        hi = np.array(end)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            below = self.keys[mid] < keys[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
        found = lo < end
        found[found] = self.keys[lo[found]] == keys[found]
        return lo, found

    def chain(self, key: int) -> np.ndarray:
        """The rows with this key, in the order in which they came."""
        at, found = self._first(np.array([key], np.uint64))
        if not found[0]:
            return self.rows[:0]
        n = int(np.searchsorted(self.keys[at[0] :], np.uint64(key), "right"))
        return self.rows[at[0] : at[0] + n]

    def heads(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each key's chain, and how many rows of the table have the key (0 for a key that isn't held)."""
        at, found = self._first(keys)
        rows, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        rows[found], counts[found] = self.rows[at[found]], self.counts[at[found]]
        return rows, counts


def _build(folder: str, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index files of this task's owners, whose keys come together; a row for each tells how many keys it has."""
        os.makedirs(folder, exist_ok=True)
        owner, parts = None, []

        def close() -> pa.RecordBatch:
            index = ExtendibleIndex(bits)
            for part in parts:
                index.extend(*part)
            index.save(f"{folder}/{owner:04x}")
            return pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([sum(len(k) for k, _, _ in parts)], pa.int64())], names=["owner", "keys"])

        for batch in batches:
            keys, rows, counts = (batch.column(k).to_numpy() for k in range(3))
            keys = keys.view(np.uint64)
            of = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
                if of[lo] != owner:
                    if owner is not None:
                        yield close()
                    owner, parts = int(of[lo]), []
                parts.append((keys[lo:hi].copy(), rows[lo:hi].copy(), counts[lo:hi].copy()))
        if owner is not None:
            yield close()

    return run


_OPENED: OrderedDict[str, SavedIndex] = OrderedDict()


def _opened(path: str) -> SavedIndex:
    index = _OPENED.pop(path, None) or SavedIndex(path)
    _OPENED[path] = index
    while len(_OPENED) > OPEN:
        _OPENED.popitem(last=False)
    return index


def _probe(folder: str, bits: int) -> Callable[[F.Column], F.Column]:
    """The first row with a key, for keys that several rows have; null for others. The keys of a batch visit the owners' files in order."""

    @F.arrow_udf("bigint")
    def run(key: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False).view(np.uint64)
        of = (keys >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else []
        heads, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
            at = order[lo:hi]
            heads[at], counts[at] = _opened(f"{folder}/{of[at[0]]:04x}").heads(keys[at])
        return pa.array(heads, pa.int64(), mask=counts < 2)

    # else the filter on the result would have it computed a second time
    return run.asNondeterministic()


def equal_groups(rows: DataFrame, uid: str, id_col: str, text_col: str, key: F.Column | None = None) -> DataFrame:
    """(uid, keep_uid, id, keep_id) of each row whose text's bytes an earlier row has, in the order of id (nulls last) and uid. rows is read several times, so its uids must be stored."""
    folder = mounted(shared_dir(rows.sparkSession, "hash-index"))
    n = partitions(rows)
    bits = owner_bits(n)
    present = batched(rows).where(col(text_col).isNotNull()).select(col(uid).alias("uid"), col(id_col).alias("id"), col(text_col).alias("text")).withColumn("key", F.xxhash64("text") if key is None else key)
    # a key's copies are counted before they are exchanged; signed keys sort their leading bit the wrong way round, but an owner's still come together
    keys = present.groupBy("key").agg(F.min("uid").alias("head"), F.count("*").alias("n"))
    owned = keys.repartition(n, F.shiftrightunsigned("key", 64 - bits)).sortWithinPartitions("key")
    owned.mapInArrow(_build(folder, bits), "owner bigint, keys bigint").agg(F.sum("keys")).first()
    left = written(present.withColumn("head", _probe(folder, bits)("key")).where("head IS NOT NULL"), "hash-shared")
    same = None
    while True:
        # copies meet the text of their chain's head, which goes to wherever they are; a skewed head's copies may be split
        heads = left.where("uid = head").select("head", F.col("text").alias("head_text"))
        fits = (heads.agg(F.sum(F.octet_length("head_text") + 32)).first()[0] or 0) <= BROADCAST_BYTES
        met = left.join(F.broadcast(heads) if fits else heads, "head").select("uid", "id", "head", "key", (F.col("text") == F.col("head_text")).alias("equal"))
        met = written(met, "hash-compared")
        found = met.where("equal").select("uid", "id", "head")
        same = found if same is None else same.union(found)
        # texts of the same key that aren't the head's begin a chain of their own
        other = met.where("NOT equal").select("uid", "key")
        if not other.take(1):
            break
        again = other.join(other.groupBy("key").agg(F.min("uid").alias("head")), "key").select("uid", "head")
        left = written(left.drop("head").join(again, "uid"), "hash-shared")
    keep = same.groupBy("head").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("keep"))
    return same.join(keep, "head").where("uid <> keep.uid").select("uid", F.col("keep.uid").alias("keep_uid"), "id", F.col("keep.id").alias("keep_id"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) for each document whose text has the same bytes as that of the document which its group keeps.

    The first pass sends each 64-bit hash with its first row and its number of rows to the owner of the hash's range,
    which builds an extendible-hash index on shared files. The second asks these files for the hash of each text; only
    texts whose hash others have too are kept, and compared byte by byte with their chain's head. Texts of one hash that
    differ begin further chains. A group keeps its least doc_id, nulls last, and of equal ones the first row. Null texts
    are equal to nothing; empty texts are equal to each other. Repeated rows are duplicates, each with a row of its own
    here. Null ids are carried as null. An empty table has no duplicates. Other columns, whatever their names, play no
    part; long texts are compared whole.
    """
    (uid,) = fresh(docs, "uid")
    found = equal_groups(numbered(docs.select(*map(col, dict.fromkeys((id_col, text_col)))), uid), uid, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "keep_id")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all its columns and their names, but for those that exact_duplicates lists.

    The row that stays is the one with the least id, nulls last, and of equal ones the first. Null texts stay, each of
    them; of empty texts one does. Repeated rows leave one. Null ids and nulls in other columns are carried as they are;
    long texts are compared whole. An empty table gives none.
    """
    (uid,) = fresh(docs, "uid")
    rows = numbered(docs, uid)
    lost = written(equal_groups(rows, uid, id_col, text_col).select(F.col("uid").alias(uid)), "hash-lost")
    return rows.join(small(lost, 40), uid, "left_anti").select(*map(col, docs.columns))


EXACT_DEDUP_SQL = """
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL)
SELECT doc_id, keep_id FROM g WHERE doc_id <> keep_id
"""
