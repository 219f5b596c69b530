"""Statistics of rows with a text or a binary content, filters over them, order and totals."""

from __future__ import annotations

import re
from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..plans.config import FilterConfig


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores where it has fewer, as a table in one small file has; larger ones are left as they are, and nothing is exchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(f: FilterConfig) -> set[str]:
    """The counts that a filter's bounds or its condition name."""
    named = set(re.findall(r"\w+", (f.condition or "").lower()))
    return {n for n in ("lines", "chars", "words", "sloc") if n in named or any(getattr(f, f"{m}_{n}", None) is not None for m in ("min", "max"))}


def _counted(df: DataFrame, counts: dict[str, Column], first: set[str]) -> DataFrame:
    """df with counts. Those of `first` stand behind a generator of one row, below which no condition on them moves: there
    each of its parts would decode and count the text anew. A filter on them is put above it, and below the other counts."""
    held = {n: f"_first_{n}" for n in counts if n in first}
    if held:
        own = df.columns
        df = df.withColumns({at: counts[n] for n, at in held.items()}).select(*own, F.inline(F.array(F.struct(*held.values()))))
    return df.withColumns({n: F.col(held[n]) if n in held else c for n, c in counts.items()}).drop(*held.values())


def analyze_table(df: DataFrame, text_col: str, ext: str | Column = "", words: bool = True, sloc: bool = True, newlines: bool = False, first: set[str] = frozenset()) -> DataFrame:
    """df with lines, chars, words and sloc of a text column; ext is one extension for all rows or a column. What isn't asked for is null and not computed. first: counts that a filter will be over (`bounded`)."""
    text = F.col(text_col)
    none = F.lit(None).cast("bigint")
    return _counted(df, {
        "lines": M.line_count(text), "chars": M.chars_by_ext(text, ext, newlines),
        "words": M.word_count(text) if words else none, "sloc": M.code_count(text, ext) if sloc else none,
    }, first)


def line_stats(df: DataFrame, key_col: str, text_col: str, ext: str | Column = "", newlines: bool = False) -> DataFrame:
    """(key, line, sloc, chars, words) of every line of a text column; lines count from 0. A null or empty text has none."""
    ext = F.lit(ext) if isinstance(ext, str) else ext
    text = F.col("text")
    base = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), ext.alias("ext"))
    zipped = F.arrays_zip(M.lines_of(text).alias("body"), M.code_flags(text, F.col("ext")).alias("code"))
    ended = F.regexp_count(text, F.lit("\n"))
    each = base.select("key", "ext", ended.alias("ended"), F.posexplode(zipped).alias("line", "row")).select("key", "ext", "line", (F.col("line") < F.col("ended")).alias("ended"), "row.*")
    # a line is counted as it stands in the text, with its own end
    whole = F.concat("body", F.when(F.col("ended"), F.lit("\n")).otherwise(F.lit("")))
    return each.select("key", F.col("line").cast("bigint").alias("line"), F.col("code").cast("bigint").alias("sloc"), M.chars_by_ext(whole, F.col("ext"), newlines).alias("chars"), M.word_count(whole).alias("words"))


def file_stats(files: DataFrame, words: bool, sloc: bool, newlines: bool, mapping: dict[str, str] | None = None, first: set[str] = frozenset()) -> DataFrame:
    """Rows of schema.FILE_STATS, with the error, from those of schema.FILES. A binary content has no lines or characters, and null words and sloc; one that couldn't be read has null counts. first: counts that a filter will be over (`bounded`)."""
    marked = files.withColumn("is_binary", M.is_binary(F.col("content")))
    text = M.decoded(F.when(~F.col("is_binary"), F.col("content")))
    ext = M.mapped_ext(F.col("ext"), mapping)
    none = F.lit(None).cast("bigint")
    zero = lambda c: F.when(F.col("is_binary"), F.lit(0).cast("bigint")).otherwise(c)
    shown = marked.withColumn("text", text)
    body = F.col("text")
    counts = {
        "lines": zero(M.line_count(body)), "chars": zero(M.chars_by_ext(body, ext, newlines)),
        "words": F.when(~F.col("is_binary"), M.word_count(body)) if words else none,
        "sloc": F.when(~F.col("is_binary"), M.code_count(body, ext)) if sloc else none,
    }
    return _counted(shown, counts, first).select("path", *counts, "size", "mtime", "ext", "name", "is_binary", "error")


def filter_stats(stats: DataFrame, f: FilterConfig) -> DataFrame:
    """Rows within the inclusive bounds of counts; null words are within none. Then the SQL condition."""
    for name in ("lines", "chars", "words"):
        least, most = getattr(f, f"min_{name}"), getattr(f, f"max_{name}")
        if least is not None:
            stats = stats.where(F.col(name) >= least)
        if most is not None:
            stats = stats.where(F.col(name) <= most)
    return stats.where(f.condition) if f.condition else stats


def filter_metadata(df: DataFrame, f: FilterConfig, size_col: str = "size", mtime_col: str = "mtime", ext_col: str = "ext") -> DataFrame:
    """Rows of a table of files within the inclusive bounds of size and time and with an allowed extension; a missing time is within no bounds. The scan takes the bounds as pushed filters."""
    for name, least, most in ((size_col, f.min_size, f.max_size), (mtime_col, f.mtime_since, f.mtime_until)):
        for bound, op in ((least, F.Column.__ge__), (most, F.Column.__le__)):
            if bound is not None:
                # a moment is given in the column's own type, so that the scan can compare it
                at = F.lit(bound) if isinstance(bound, int) else F.lit(bound.astimezone(timezone.utc).replace(tzinfo=None).isoformat(" ")).cast(df.schema[name].dataType)
                df = df.where(op(F.col(name), at))
    return filter_ext(df, f.allow_ext, f.deny_ext, ext_col) if f.allow_ext or f.deny_ext else df


def filter_ext(df: DataFrame, allow: list[str], deny: list[str] = (), ext_col: str = "ext") -> DataFrame:
    """Rows whose extension, without case, is allowed and not denied; with an allow list, rows without one go."""
    clean = lambda xs: sorted({x.strip().lstrip(".").lower() for x in xs} - {""})
    ext = F.lower(F.col(ext_col))
    if clean(allow):
        df = df.where(ext.isin(clean(allow)))
    if clean(deny):
        df = df.where(F.coalesce(~ext.isin(clean(deny)), F.lit(True)))
    return df


def sort_keys(spec: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns: null words and sloc stand for 0, ties go by path."""
    if not spec:
        return []
    keys = [F.coalesce(F.col(k), F.lit(0)) if k in ("words", "sloc") else F.col(k) for k, _ in spec]
    return [c.desc() if down else c.asc() for c, (_, down) in zip(keys, spec, strict=True)] + [F.col("path").asc()]


def sort_stats(stats: DataFrame, spec: list[tuple[str, bool]]) -> DataFrame:
    keys = sort_keys(spec)
    return stats.orderBy(*keys) if keys else stats


def totals(stats: DataFrame, *by: str) -> DataFrame:
    """Files and the sums of their counts, of all rows or by columns; a sum over nulls or nothing is 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return stats.groupBy(*by).agg(F.count("*").alias("files"), *map(total, ("lines", "chars", "words", "sloc")))
