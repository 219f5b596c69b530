"""Results as text: each format is a column of lines, so that it can be written by executors or printed."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..plans.config import Config
from ..schema import FILE_STATS
from .stats import sort_keys, totals

PROGRAM = "textloom"
_ORDER = [f.name for f in FILE_STATS]


def presented(stats: DataFrame, config: Config) -> DataFrame:
    """What is shown: no binary files, in the order asked for, the first rows where a top is given."""
    shown = stats.where(~F.col("is_binary"))
    keys = sort_keys(config.sort)
    shown = shown.orderBy(*keys) if keys else shown
    return shown.limit(config.top) if config.top is not None else shown


def _counts(config: Config, fill: bool = True) -> list[Column]:
    names = ["lines", *(["sloc"] if config.count_sloc else []), "chars", *(["words"] if config.count_words else [])]
    return [(F.coalesce(F.col(n), F.lit(0)) if fill else F.col(n)).cast("string") for n in names]


def separated(config: Config, sep: str) -> Column:
    path = F.col("path")
    if sep == ",":
        path = F.when(path.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(path)
    return F.concat_ws(sep, *_counts(config), path)


def markdown(config: Config) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *_counts(config), F.replace(F.col("path"), F.lit("|"), F.lit("\\|"))), F.lit(" |"))


def _rfc3339() -> Column:
    """mtime with its zone's offset and no more digits of the second than it has, by threes."""
    text = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.regexp_replace(F.regexp_replace(text, r"\.000000", ""), r"(\.\d{3})000", "$1")


def json_object(extra: dict[str, str] | None = None, alphabetical: bool = False) -> Column:
    """A row as a JSON object with all its fields."""
    fields = {n: _rfc3339() if n == "mtime" else F.col(n) for n in _ORDER} | {k: F.lit(v) for k, v in (extra or {}).items()}
    names = sorted(fields) if alphabetical else list(fields)
    return F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"})


def table_row(config: Config) -> Column:
    widths = [9, 16, 16] if config.count_sloc else [9, 16]
    cells = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("lines", *(("sloc",) if config.count_sloc else ()), "chars")]
    return F.concat(*[F.when(F.length(c) < w, F.lpad(c, w, " ")).otherwise(c) for c, w in zip(cells, widths, strict=True)], F.lit("      "), F.col("path"))


def _json_value(name: str) -> Column:
    """A field's value as JSON has it."""
    value = _rfc3339() if name == "mtime" else F.col(name)
    object_ = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(object_, F.lit(len('{"v":') + 1), F.length(object_) - len('{"v":}'))


def json_block() -> Column:
    """A row as a JSON object over several lines, as an element of an array."""
    fields = [F.concat(F.lit(f'    "{n}": '), _json_value(n)) for n in _ORDER]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))


#: Strings that YAML takes for strings without quotes; those of them that mean something else; characters that need escapes.
_PLAIN = r"[A-Za-z0-9_./+-][^\n\t:#\"'\\]*"
_MEANS = r"(?s)(?:(?i:~|null|true|false|yes|no|on|off|y|n)|[-+.]?[0-9][0-9_.,:eExXa-fA-F+-]*|-.*|.*\s|\.(?:inf|nan))"
_CONTROL = r"[\x00-\x1f]"


def _yaml_scalar(text: Column, name: str) -> Column:
    """A string as YAML has it: plain where it can't be taken for anything else."""
    plain = text.rlike(f"^(?:{_PLAIN})\\z") & ~text.rlike(f"^(?:{_MEANS})\\z")
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(plain, text).when(text.rlike(_CONTROL), _json_value(name)).otherwise(quoted)


def yaml_block() -> Column:
    """A row as a mapping, an element of a sequence, over several lines."""
    kinds = {f.name: f.dataType.simpleString() for f in FILE_STATS}
    out = []
    for n in _ORDER:
        value = _yaml_scalar(_rfc3339(), n) if n == "mtime" else _yaml_scalar(F.col(n), n) if kinds[n] == "string" else F.col(n).cast("string")
        out.append(F.concat(F.lit(f"  {n}: " if out else f"- {n}: "), F.coalesce(value, F.lit("null"))))
    return F.concat_ws("\n", *out)


def _lines(df: DataFrame, line: Column) -> Iterator[str]:
    # a sort must not be undone: the line is computed beside it and the rows come in order
    return (r.line for r in df.select(line.alias("line")).toLocalIterator())


def line_of(config: Config) -> Column:
    """A row's line, or lines, in the format asked for."""
    return {
        "csv": lambda: separated(config, ","), "tsv": lambda: separated(config, "\t"), "md": lambda: markdown(config), "jsonl": lambda: json_object({"type": "file"}, alphabetical=True),
        "json": json_block, "yaml": yaml_block, "table": lambda: table_row(config),
    }[config.format]()


def head_lines(config: Config) -> list[str]:
    """What comes before the rows."""
    names = ["lines", *(["sloc"] if config.count_sloc else []), "chars", *(["words"] if config.count_words else [])]
    if config.format in ("csv", "tsv"):
        return [("," if config.format == "csv" else "\t").join([*names, "path"])]
    if config.format == "md":
        heads = [{"sloc": "SLOC"}.get(n, n.capitalize()) for n in names]
        return ["### File Statistics", "", "| " + " | ".join([*heads, "File"]) + " |", "|" + ":---:|" * len(heads) + ":---|"]
    if config.format == "table":
        return [f"{PROGRAM} v{__version__} · parallel={config.walk.threads}", "", "    LINES" + ("            SLOC" if config.count_sloc else "") + "        CHARACTERS     FILE", "-" * 46]
    return []


def foot_lines(total: DataFrame, config: Config) -> DataFrame:
    """(line) of what comes after the rows, from their totals; one row, whose line may hold several."""
    if config.format in ("csv", "tsv"):
        line = separated(config, "," if config.format == "csv" else "\t")
        return total.withColumn("path", F.lit("TOTAL")).select(line.alias("line")).where(F.lit(config.total_row))
    if config.format == "jsonl":
        fields = {"chars": F.col("chars"), "files": F.col("files"), "lines": F.col("lines"), "sloc": F.col("sloc"), "type": F.lit("total"), "version": F.lit(__version__), "words": F.col("words")}
        return total.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("line"))
    if config.format == "table":
        row = total.withColumn("path", F.format_string("TOTAL (%d files)", "files"))
        return row.select(F.concat(F.lit("---\n"), table_row(config), F.format_string(f"\n\n[{PROGRAM}] Completed: %d files processed.", "files")).alias("line"))
    return total.select(F.lit("").alias("line")).where(F.lit(config.format == "md"))


def render(stats: DataFrame, config: Config) -> Iterator[str]:
    """The report's lines. Rows pass through the driver one at a time; write_lines doesn't need that."""
    shown = presented(stats, config)
    if config.by:
        yield from (json.dumps(r.asDict(), ensure_ascii=False, default=str) for r in totals(shown, config.by).orderBy(config.by).toLocalIterator())
        return
    yield from head_lines(config)
    if config.format in ("json", "yaml"):
        last = None
        for block in _lines(shown, line_of(config)):
            if config.format == "json":
                yield from ["["] if last is None else (last + ",").split("\n")
            else:
                yield from block.split("\n")
            last = block
        yield from ["[]"] if last is None else [*last.split("\n"), "]"] if config.format == "json" else [""]
        return
    yield from _lines(shown, line_of(config))
    for r in foot_lines(totals(shown), config).collect():
        yield from r.line.split("\n")


def write_lines(stats: DataFrame, config: Config, path: str) -> None:
    """The report as text files that executors write, headers and totals too; in the order of their names they are the whole. JSON is written as jsonl is, an object a line, since a written array would need to know its last row."""
    shown = presented(stats, config)
    if config.format == "json":
        shown.select(json_object().alias("value")).write.text(path)
        return
    body = shown.select(line_of(config).alias("value"))
    spark = stats.sparkSession
    head = spark.createDataFrame([("\n".join(head_lines(config)),)] if head_lines(config) else [], "value string").coalesce(1)
    foot = foot_lines(totals(shown), config).withColumnRenamed("line", "value")
    head.union(body).union(foot).write.text(path)
