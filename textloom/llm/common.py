"""Helpers that the corpus operators share: fresh names, the shared folder, size-checked broadcast, vectorised text hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only while its estimated size stays under this many bytes.
BROADCAST_BYTES = 32 << 20
#: Text bytes that are turned into arrays at a time; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of a batch that goes to a Python worker, at most; session settings that `batched` lowers to this.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20

_LOCAL: list[str] = []
#: Folders in the shared folder that this process made and hasn't deleted, in order.
_MADE: list[str] = []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have in any case, made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's address under spark.checkpoint.dir; under a folder of this machine only where that is unset, as in local tests. It lasts until it is discarded, or the driver's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="textloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    _MADE.append(f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def mounted(address: str) -> str:
    """The path of a shared folder that executors see as files."""
    if address.startswith("file:"):
        return "/" + address[5:].lstrip("/")
    if "://" in address:
        raise ValueError(f"{address}: memory-mapped files need a shared folder that is mounted as a file system")
    return address


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage, and safe when executors are lost."""
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def made() -> int:
    """A mark for release: how many folders there are so far."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the folders made since a mark, but for those of the written tables in keep. Nothing that is still to be evaluated may read them."""
    kept = {df.written_at for df in keep}
    gone = [at for at in _MADE[since:] if at not in kept]
    for at in gone:
        _delete(at, spark)
        _MADE.remove(at)


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing will read any more."""
    if df.written_at in _MADE:
        _MADE.remove(df.written_at)
        _delete(df.written_at, df.sparkSession)


def _delete(at: str, spark: SparkSession | None) -> None:
    if at.startswith("file:") or "://" not in at:
        shutil.rmtree(mounted(at), ignore_errors=True)
    elif spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    while _MADE:
        _delete(_MADE.pop(), spark)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else as it is, for a shuffled join. df should be a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Bits of a row's number that count rows within its file.
ROW_BITS = 38


def numbered(df: DataFrame, uid: str) -> DataFrame:
    """df with a row number as column uid that every later read gives again.

    Rows of a plain scan of files are numbered by their file and their place in it, which don't depend on the scan's
    splits (these follow the cores that are there when it is read); nothing is written. Rows of any other plan are
    numbered once and written with their numbers.
    """
    files = _scanned(df)
    if files is None:
        return written(df.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    names = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "file string, number bigint")
    place, at, file, number = fresh(df, "place", "at", "file", "number")
    rows = df.select("*", F.col("_metadata.file_path").alias(place), F.col("_metadata.row_index").alias(at))
    known = rows.join(F.broadcast(names.toDF(file, number)), col(place) == col(file))
    return known.withColumn(uid, F.shiftleft(col(number), ROW_BITS) + col(at)).select(*map(col, df.columns), col(uid))


def _scanned(df: DataFrame) -> list[str] | None:
    """The files of a plain scan of Parquet, in order; None where df is anything else, or its list of files is too large to broadcast."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or not plan.toString().rstrip().endswith(" parquet") or "_metadata" in (c.lower() for c in df.columns):
        return None
    # as the scan itself names them; it reads no column for this
    paths = sorted(row.path for row in df.select(F.col("_metadata.file_path").alias("path")).distinct().collect())
    return paths if sum(map(len, paths)) + 64 * len(paths) <= BROADCAST_BYTES else None


def batched(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches have been kept small enough for several workers to a machine."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    conf.set(size, str(BATCH_BYTES))
    return df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- arrays over the UTF-8 bytes of a batch -------------------------------------------------------------------------

U = np.uint64
_C1, _C2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_POW = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(256)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; a null counts as an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type != pa.large_string():
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(off: np.ndarray, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes and at most `rows` rows; a longer text is a range of its own."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, (hi := min(hi, lo + rows, n))
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters U+00C0..U+00DE, the same length in bytes."""
    out = LOWER[data]
    if len(data) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes (ASCII letters and digits, all non-ASCII); no run crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    return np.flatnonzero(is_word & (~before | edge[:-1])), np.flatnonzero(is_word & (~after | edge[1:])) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are sorted and don't overlap."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    # position and byte are hashed together, so that spans over 256 bytes keep their order too
    return mix(np.add.reduceat((data[at].astype(U) + U(1)) * (_POW[pos & 255] + (pos >> 8).astype(U) * _C1), first) + lens.astype(U))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the folded words, and each text's first word (one more at the end). off begins at 0. Long texts are hashed in pieces cut between words."""
    starts, ends = word_spans(data, off)
    hashes = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, "right")))
        a, b = starts[lo], ends[hi - 1]
        hashes[lo:hi] = hash_spans(fold(data[a:b]), starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return hashes, starts, ends, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words (of all its words, if it has fewer), and each text's first run (one more at the end)."""
    count = np.diff(first)
    total = len(hashes)
    if not total:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    left = np.repeat(first[1:], count) - np.arange(total)  # words from here to the text's end
    out = hashes.copy()
    for k in range(1, n):
        nxt = np.zeros(total, U)
        nxt[: total - k] = hashes[k:]
        nxt[left <= k] = 0
        out = out * U(0x9E3779B97F4A7C15) + nxt
    full = np.repeat(count >= n, count)
    at_start = np.repeat(first[:-1], count) == np.arange(total)
    keep = np.where(full, left >= n, at_start)
    per_text = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return mix(out[keep]), np.concatenate(([0], np.cumsum(per_text)))
