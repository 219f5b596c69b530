"""Files of directory trees as a Spark data source: the driver walks, executors read."""

from __future__ import annotations

import heapq
import json
import os
import pickle
import stat
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import ConfigError
from ..plans.config import FilterConfig, WalkOptions
from ..schema import FILES
from .ignore import Overrides, Rules
from .path_safety import SanitizeOptions, is_path_safe, sanitize_path

NAME = "textloom_files"
#: Bytes of content in a batch, and of a partition; a larger file is one of its own.
BATCH_BYTES, PARTITION_BYTES = 16 << 20, 128 << 20
#: Bytes of the largest content that a row can hold; a larger file is an error.
MOST_BYTES = (1 << 31) - (64 << 20)


@dataclass
class Found:
    path: str
    size: int
    mtime: float | None


def extension(name: str) -> str:
    """What follows the last dot of a name, in its own case; a name that begins with its only dot has none."""
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else ""


def _normal(exts: list[str]) -> set[str]:
    return {e.strip().lstrip(".").lower() for e in exts} - {""}


def keeps(name: str, size: int, mtime: float | None, filters: FilterConfig, allow: set[str], deny: set[str]) -> bool:
    """The filters that metadata decides; bounds are inclusive."""
    if allow or deny:
        ext = extension(name).strip().lstrip(".").lower()
        if allow and ext not in allow or ext and ext in deny:
            return False
    if filters.min_size is not None and size < filters.min_size or filters.max_size is not None and size > filters.max_size:
        return False
    if filters.mtime_since is None and filters.mtime_until is None:
        return True
    if mtime is None:
        return False
    at = datetime.fromtimestamp(mtime, timezone.utc)
    return (filters.mtime_since is None or at >= filters.mtime_since.astimezone(timezone.utc)) and (filters.mtime_until is None or at <= filters.mtime_until.astimezone(timezone.utc))


class Walker:
    """Regular files under the roots, without those that hidden names, ignore files and globs leave out.

    .ignore files hold everywhere; .gitignore and .git/info/exclude inside a git work tree, including those of
    directories above a root. Entries that can't be read are passed over.
    """

    def __init__(self, options: WalkOptions, filters: FilterConfig):
        self.options, self.filters = options, filters
        if options.roots:
            self.overrides = Overrides([*options.override_include, *("!" + g for g in options.override_exclude), *filters.include_patterns, *("!" + g for g in filters.exclude_patterns)])
            self.base = os.path.abspath(options.roots[0])
        self.allow, self.deny = _normal(filters.allow_ext), _normal(filters.deny_ext)
        self.types = _normal(options.types) if options.types is not None else None
        self.seen: set[tuple[int, int]] = set()

    def check_roots(self) -> None:
        limits = SanitizeOptions(allow_symlinks=self.options.follow_links, max_depth=self.options.max_depth or 256)
        for root in self.options.roots:
            if not is_path_safe(root):
                raise ConfigError(f"Potentially unsafe path: {root}")
            if os.path.exists(root):
                sanitize_path(root, limits)

    def _rules(self, folder: str, in_git: bool) -> list[tuple[str, Rules]]:
        names = [".gitignore"] if in_git and self.options.git_ignore else []
        if in_git and self.options.git_ignore and os.path.isdir(os.path.join(folder, ".git")):
            names.insert(0, ".git/info/exclude")
        return [(folder, r) for n in (*names, ".ignore") if (r := Rules.read(os.path.join(folder, n))).rules]

    def _above(self, folder: str) -> tuple[list[tuple[str, Rules]], bool]:
        """Rules from the directories above, and whether one is a git work tree's root."""
        up, chain = os.path.abspath(folder), []
        while up != (parent := os.path.dirname(up)):
            chain.append(up := parent)
        top = next((i for i, f in enumerate([os.path.abspath(folder), *chain]) if os.path.exists(os.path.join(f, ".git"))), None)
        rules: list[tuple[str, Rules]] = []
        for i, f in reversed(list(enumerate(chain, 1))):
            rules += self._rules(f, top is not None and i <= top)
        return rules, top is not None

    def _hides(self, folder: str, rules: list[tuple[str, Rules]]) -> Callable[[str, bool], bool]:
        """Whether an entry of a folder is left out, by its name and whether it is a directory."""
        below = lambda top: os.path.abspath(folder).rstrip("/")[len(os.path.abspath(top).rstrip("/")) + 1 :]
        under = lambda top: below(top) and below(top) + "/"
        inside = f"{os.path.abspath(folder).rstrip('/')}/".startswith(f"{self.base.rstrip('/')}/")
        places = [(own.decide, under(top)) for top, own in reversed(rules)]
        overrides = [(self.overrides.decide, under(self.base))] if inside and self.overrides.rules.rules else []
        types, hidden = self.types, self.options.hidden

        def hides(name: str, is_dir: bool) -> bool:
            for decide, prefix in overrides:
                said = decide(prefix + name, is_dir)
                if said is not None:
                    return said
            kept = False
            for decide, prefix in places:
                said = decide(prefix + name, is_dir)
                if said:
                    return True
                if said is not None:
                    kept = True
                    break
            if types is not None and not is_dir:
                kept = extension(name).lower() in types
                if not kept:
                    return True
            return not hidden and not kept and name.startswith(".")

        return hides

    def files(self) -> Iterator[Found]:
        for folder, name, size, mtime in self.entries():
            yield Found(folder + name, size, mtime)

    def entries(self) -> Iterator[tuple[str, str, int, float]]:
        """The files: what comes before the name in the path, the name, size and time."""
        if not self.options.roots:
            return
        self.check_roots()
        for root in self.options.roots:
            try:
                info = os.stat(root) if self.options.follow_links else os.lstat(root)
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode):
                name = os.path.basename(root)
                if keeps(name, info.st_size, info.st_mtime, self.filters, self.allow, self.deny):
                    yield root.removesuffix(name), name, info.st_size, info.st_mtime
            elif stat.S_ISDIR(info.st_mode):
                rules, in_git = self._above(root)
                yield from self._walk(root, 1, rules, in_git)

    def _walk(self, top: str, depth: int, rules: list[tuple[str, Rules]], in_git: bool) -> Iterator[tuple[str, str, int, float]]:
        todo, follow = [(top, depth, rules, in_git)], self.options.follow_links
        while todo:
            folder, depth, rules, in_git = todo.pop()
            if self.options.max_depth is not None and depth > self.options.max_depth:
                continue
            in_git = in_git or os.path.lexists(os.path.join(folder, ".git"))
            rules = rules + self._rules(folder, in_git)
            hides, prefix, folders = self._hides(folder, rules), os.path.join(folder, ""), []
            for e in _scanned(folder):
                try:
                    is_dir = e.is_dir(follow_symlinks=follow)
                    if not is_dir and not e.is_file(follow_symlinks=follow) or hides(e.name, is_dir):
                        continue
                    info = e.stat(follow_symlinks=follow)
                except OSError:
                    continue
                if is_dir:
                    folders.append((e.name, info.st_dev, info.st_ino))
                elif keeps(e.name, info.st_size, info.st_mtime, self.filters, self.allow, self.deny):
                    yield prefix, e.name, info.st_size, info.st_mtime
            for name, *inode in sorted(folders):
                if follow:
                    if tuple(inode) in self.seen:
                        continue
                    self.seen.add(tuple(inode))
                todo.append((prefix + name, depth + 1, rules, in_git))


def _scanned(folder: str) -> Iterator[os.DirEntry[str]]:
    """A folder's entries, one at a time, as far as they can be read."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError:
        return


class _Batch(InputPartition):
    """Files of a partition, as few bytes: those of all partitions pass through the driver."""

    def __init__(self, files: list[Found]):
        super().__init__(0)
        names = [os.path.basename(f.path) for f in files]
        folders = {f.path.removesuffix(n): None for f, n in zip(files, names, strict=True)}
        number = {f: i for i, f in enumerate(folders)}
        self._hold([*folders], [number[f.path.removesuffix(n)] for f, n in zip(files, names, strict=True)], names, [f.size for f in files], [f.mtime for f in files])

    def _hold(self, *columns: list) -> None:
        self.held = zlib.compress(pickle.dumps(columns, 5), 1)

    @property
    def files(self) -> Iterator[Found]:
        folders, *columns = pickle.loads(zlib.decompress(self.held))
        return (Found(folders[k] + name, size, mtime) for k, name, size, mtime in zip(*columns, strict=True))


class Listing:
    """Files by column: some 30 bytes each besides the name, however long the path is."""

    def __init__(self, entries: Iterator[tuple[str, str, int, float]]):
        self.folders: list[str] = []
        self.folder, self.sizes, self.mtimes, self.ends, self.names = array("i"), array("q"), array("d"), array("q"), bytearray()
        for folder, name, size, mtime in entries:
            if not self.folders or folder is not self.folders[-1]:
                self.folders.append(folder)
            self.folder.append(len(self.folders) - 1)
            self.sizes.append(size)
            self.mtimes.append(mtime)
            self.names += name.encode("utf-8", "surrogateescape")
            self.ends.append(len(self.names))

    def batch(self, of: np.ndarray) -> _Batch:
        """A partition of these of the files."""
        batch, of = _Batch([]), of.tolist()
        used, begins = {}, lambda i: self.ends[i - 1] if i else 0
        folder = [used.setdefault(self.folder[i], len(used)) for i in of]
        names = [self.names[begins(i) : self.ends[i]].decode("utf-8", "surrogateescape") for i in of]
        batch._hold([self.folders[k] for k in used], array("i", folder), names, array("q", [self.sizes[i] for i in of]), array("d", [self.mtimes[i] for i in of]))
        return batch


def bins(sizes: Sequence[int], least: int) -> list[np.ndarray]:
    """Places of the sizes in bins of much the same sum: at least `least`, and as many as PARTITION_BYTES asks for. Each file costs a little besides its bytes."""
    cost = np.asarray(sizes, np.int64) + (64 << 10)
    n = max(1, min(len(cost), max(least, -(-int(cost.sum()) // PARTITION_BYTES))))
    order, into, heap = np.argsort(-cost, kind="stable"), np.empty(len(cost), np.int32), [(0, i) for i in range(n)]
    for at in range(0, len(order), 1 << 16):
        some, to = order[at : at + (1 << 16)], []
        for c in cost[some].tolist():
            load, i = heap[0]
            to.append(i)
            heapq.heapreplace(heap, (load + c, i))
        into[some] = to
    by = np.argsort(into, kind="stable")
    return [b for b in np.split(by, np.searchsorted(into[by], np.arange(1, n))) if len(b)]


def pack(files: list[Found], least: int) -> list[list[Found]]:
    """Files in such bins."""
    return [[files[i] for i in b] for b in bins([f.size for f in files], least)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        raw = json.loads(options["config"])
        filters = raw["filter"]
        for k in ("mtime_since", "mtime_until"):
            filters[k] = filters[k] and datetime.fromisoformat(filters[k])
        self.walk, self.filter = WalkOptions(**raw["walk"]), FilterConfig(**filters)

    def partitions(self) -> Sequence[InputPartition]:
        found = Listing(Walker(self.walk, self.filter).entries())
        return [found.batch(b) for b in bins(found.sizes, self.walk.threads)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("ext", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(len(kind))], schema=kind)

        for f in partition.files:
            content = error = None
            try:
                with open(f.path, "rb") as file:
                    # room for what is asked is taken before anything is read, so the bound itself is asked only of a file that grew
                    content = file.read(min(f.size, MOST_BYTES) + 1)
                    if f.size < len(content) <= MOST_BYTES:
                        content += file.read(MOST_BYTES + 1 - len(content))
                if len(content) > MOST_BYTES:
                    content, error = None, f"Failed to read file '{f.path}': over {MOST_BYTES} bytes"
            except Exception as bad:  # whatever it is, it concerns this file alone
                error = f"Failed to read file '{f.path}': {getattr(bad, 'strerror', None) or bad or type(bad).__name__}"
            name = os.path.basename(f.path)
            rows.append((f.path, f.size, None if f.mtime is None else int(f.mtime * 1e6), extension(name), name, content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FilesSource(DataSource):
    """Rows of schema.FILES. Option config: JSON of walk and filter options."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_files(spark: SparkSession, walk: WalkOptions, filters: FilterConfig | None = None) -> DataFrame:
    """The files that the options find. A root that isn't there gives none; bad options raise ConfigError here."""
    filters = filters or FilterConfig()
    Walker(walk, filters).check_roots()
    spark.dataSource.register(FilesSource)
    raw = {"walk": asdict(walk), "filter": asdict(filters)}
    for k in ("mtime_since", "mtime_until"):
        moment = raw["filter"][k]
        raw["filter"][k] = moment and moment.astimezone(timezone.utc).isoformat()
    return spark.read.format(NAME).option("config", json.dumps(raw)).load()
