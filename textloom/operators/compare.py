"""Comparison of two snapshots."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("lines", "chars", "words")


def last_of_each(snapshot: DataFrame, key: str = "path", order: str = "position") -> DataFrame:
    """The last row of each key, by its position; all rows where there is no position."""
    if order not in snapshot.columns:
        return snapshot
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return snapshot.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", order)


def diff_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old and new counts, difference of each) for every path of either side.

    status: added, removed, modified where lines, chars or words differ (null words differ from any number), unchanged.
    A side that is missing counts as 0; the difference of words needs them on both sides, or on the one there is.
    """
    side = lambda df, s: last_of_each(df).select(F.col("path"), F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in COUNTS])
    both = side(old, "old").join(side(new, "new"), "path", "full_outer")
    same = F.lit(True)
    for c in COUNTS:
        same &= F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    change = lambda c: F.coalesce(f"new_{c}", F.lit(0)) - F.coalesce(f"old_{c}", F.lit(0))
    paired = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    words = F.when(paired & (F.col("old_words").isNull() | F.col("new_words").isNull()), F.lit(0)).otherwise(change("words"))
    return both.select("path", status.alias("status"), *[f"{s}_{c}" for c in COUNTS for s in ("old", "new")], change("lines").alias("diff_lines"), change("chars").alias("diff_chars"), words.alias("diff_words"))


def diff_summary(rows: DataFrame) -> DataFrame:
    """One row: files by status, and the summed differences of those that aren't unchanged."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("status") != "unchanged", F.col(c))), F.lit(0)).cast("bigint").alias(c)
    return rows.agg(*map(count, ("added", "removed", "modified", "unchanged")), *map(total, ("diff_lines", "diff_chars", "diff_words")))


def by_component(path: str = "path") -> F.Column:
    """A sort key that compares paths component by component."""
    return F.split(path, "/")


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose path old lacks."""
    return last_of_each(new).join(old.select("path"), "path", "left_anti")


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old whose path new lacks."""
    return added(new, old)


def section_lines(rows: DataFrame) -> DataFrame:
    """(section, path, line) of each path that isn't unchanged, a line of the report; sections are 1 added, 2 removed, 3 modified. orderBy("section", by_component()) is the report's order."""
    number = lambda c: F.col(c).cast("string")
    signed = lambda c: F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), number(c))
    one = lambda mark, side: F.concat(F.lit(f"{mark} "), "path", F.lit(" (L:"), number(f"{side}_lines"), F.lit(", C:"), number(f"{side}_chars"), F.lit(")"))
    both = F.concat(F.lit("~ "), "path", F.lit(" (Lines: "), signed("diff_lines"), F.lit(", Chars: "), signed("diff_chars"), F.lit(")"))
    status = F.col("status")
    section = F.when(status == "added", 1).when(status == "removed", 2).when(status == "modified", 3)
    line = F.when(status == "added", one("+", "new")).when(status == "removed", one("-", "old")).otherwise(both)
    return rows.where("status <> 'unchanged'").select(section.alias("section"), "path", line.alias("line"))


def report(old: DataFrame, new: DataFrame) -> Iterator[str]:
    """The comparison's lines of text, one at a time. The two sides are joined once, and kept for the summary and the sections."""
    rows = diff_rows(old, new)
    rows = rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows.persist(StorageLevel.MEMORY_AND_DISK)
    s = diff_summary(rows).first()
    has_words = lambda df: bool(df.where("words IS NOT NULL").take(1))
    yield from ("Comparison Summary", "-------------------", f"Files: +{s.added_files} -{s.removed_files} ~{s.modified_files} ({s.unchanged_files} unchanged)", f"Lines: {s.diff_lines:+}", f"Chars: {s.diff_chars:+}")
    if has_words(old) and has_words(new):
        yield f"Words: {s.diff_words:+}"
    yield ""
    open_section = 0
    for r in section_lines(rows).orderBy("section", by_component()).toLocalIterator():
        if r.section != open_section:
            if open_section:
                yield ""
            open_section = r.section
            yield f"### {('Added', 'Removed', 'Modified')[r.section - 1]} Files"
        yield r.line
    if open_section in (1, 2):
        yield ""
