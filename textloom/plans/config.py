"""Options of a run, and the parsers of their literals."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from ..errors import ConfigError

FORMATS = ("table", "csv", "tsv", "json", "yaml", "md", "jsonl")
SORT_KEYS = ("lines", "chars", "words", "size", "name", "ext", "sloc")


@dataclass
class WalkOptions:
    """Which files are found."""

    roots: list[str] = field(default_factory=list)
    threads: int = 1
    hidden: bool = False
    git_ignore: bool = True
    max_depth: int | None = None
    follow_links: bool = False
    override_include: list[str] = field(default_factory=list)
    override_exclude: list[str] = field(default_factory=list)
    types: list[str] | None = None


@dataclass
class FilterConfig:
    """Which files are kept: by metadata before they are read, by counts after."""

    allow_ext: list[str] = field(default_factory=list)
    deny_ext: list[str] = field(default_factory=list)
    min_lines: int | None = None
    max_lines: int | None = None
    min_chars: int | None = None
    max_chars: int | None = None
    min_words: int | None = None
    max_words: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    mtime_since: datetime | None = None
    mtime_until: datetime | None = None
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    map_ext: dict[str, str] = field(default_factory=dict)
    #: An SQL condition over the statistics (an addition of this engine).
    condition: str | None = None


@dataclass
class Config:
    """A whole run. by and top are additions of this engine."""

    walk: WalkOptions = field(default_factory=WalkOptions)
    filter: FilterConfig = field(default_factory=FilterConfig)
    format: str = "table"
    sort: list[tuple[str, bool]] = field(default_factory=list)
    total_row: bool = False
    count_newlines_in_chars: bool = False
    progress: bool = False
    count_words: bool = False
    count_sloc: bool = False
    strict: bool = False
    watch: bool = False
    watch_interval: float = 1.0
    watch_output: str = "full"
    compare: tuple[str, str] | None = None
    by: str | None = None
    top: int | None = None
    output: str | None = None

    def resolved(self) -> Config:
        """With words and sloc on where a filter or a sort key needs them."""
        keys = {k for k, _ in self.sort}
        self.count_words |= self.filter.min_words is not None or self.filter.max_words is not None or "words" in keys
        self.count_sloc |= "sloc" in keys
        return self


_SIZE = re.compile(r"(\+?[0-9]+)\s*(?:([kmgt])(?:i?b)?)?")


def parse_size(text: str) -> int:
    """Bytes: a whole number, _ allowed in it, with a suffix of powers of 1024 such as k, KB or KiB."""
    m = _SIZE.fullmatch(text.strip().replace("_", "").lower())
    if not m:
        raise ConfigError(f"Invalid size number: {text}")
    return int(m[1]) << (10 * (" kmgt".index(m[2]) if m[2] else 0))


def parse_datetime(text: str) -> datetime:
    """RFC 3339, or local `YYYY-MM-DD HH:MM:SS`, or a local date at midnight; a local time that occurs twice or never is refused."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)", text):
        try:
            return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper()))
        except ValueError as bad:
            raise ConfigError(f"Cannot parse datetime: {text}") from bad
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            naive = datetime.strptime(text, form)
        except ValueError:
            continue
        early, late = naive.replace(fold=0).astimezone(), naive.replace(fold=1).astimezone()
        if early.utcoffset() != late.utcoffset() or early.replace(tzinfo=None) != naive:
            break
        return early
    raise ConfigError(f"Cannot parse datetime: {text}")


def parse_bounded(text: str, least: int = 1, most: int | None = None) -> int:
    """A whole number within bounds."""
    if not re.fullmatch(r"\+?[0-9]+", text):
        raise ConfigError(f"invalid number '{text}'")
    value = int(text)
    if value < least:
        raise ConfigError(f"value must be at least {least}")
    if most is not None and value > most:
        raise ConfigError(f"value must be at most {most}")
    return value


def parse_pair(text: str) -> tuple[str, str]:
    """key=value, cut at the first =."""
    key, sign, value = text.partition("=")
    if not sign:
        raise ConfigError(f"invalid KEY=value: no `=` found in `{text}`")
    return key, value


def parse_sort(text: str) -> list[tuple[str, bool]]:
    """Keys and whether each descends: only exactly `desc` or `DESC` after a colon does."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, _, direction = part.partition(":")
        key = key.strip().lower()
        if key not in SORT_KEYS:
            raise ConfigError(f"Unknown sort key: {key}")
        out.append((key, direction.strip() in ("desc", "DESC")))
    return out


def default_threads() -> int:
    return os.cpu_count() or 1


def utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc)
