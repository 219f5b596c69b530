"""Queries over the tables of a folder, one for each operator, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import metrics as M
from ..functions.analyzers import PREFIXES
from ..operators import compare, reports
from ..operators.stats import analyze_table, bounded, filter_ext, filter_metadata, filter_stats, line_stats, spread, totals
from ..sources.snapshot import parse_snapshot
from .config import Config, FilterConfig, WalkOptions, parse_datetime, parse_size, parse_sort
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INK = f"[^{_WS}]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_lines(t: str) -> str:
    nl = f"(length({t}) - length(replace({t}, chr(10), '')))"
    return f"({nl} + CASE WHEN {t} = '' OR right({t}, 1) = chr(10) THEN 0 ELSE 1 END)::BIGINT"


def sql_chars(t: str) -> str:
    return f"(length({t}) - (length({t}) - length(replace({t}, chr(10), ''))) - (length({t}) - length(replace({t}, chr(13) || chr(10), ''))) // 2)::BIGINT"


def sql_words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{INK}+'))::BIGINT"


def sql_sloc(t: str, keep: str = f"regexp_matches(l, '{INK}')") -> str:
    """Lines that a condition over l keeps; the emptiness after a last line feed isn't a line."""
    ended = f"({t} = '' OR right({t}, 1) = chr(10))"
    parts = f"string_split({t}, chr(10))"
    return f"len(list_filter(CASE WHEN {ended} THEN {parts}[1:len({parts}) - 1] ELSE {parts} END, lambda l: {keep}))::BIGINT"


def stats_sql(key: str, table: str, t: str = "text", where: str = "TRUE") -> str:
    return f"SELECT {key}, {sql_lines(t)} AS lines, {sql_chars(t)} AS chars, {sql_words(t)} AS words, {sql_sloc(t)} AS sloc FROM {table} WHERE {where}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def doc_stats(spark: SparkSession, sf_dir: str, words: bool = True, sloc: bool = True, first: set[str] = frozenset()) -> DataFrame:
    """Statistics of the documents as if they were files: doc_id is the path, source the extension."""
    df = analyze_table(_table(spark, sf_dir, "documents"), "text", "txt", words, sloc, first=first)
    return df.select(F.col("doc_id").cast("string").alias("path"), "lines", "chars", "words", "sloc", F.octet_length("text").cast("bigint").alias("size"), F.col("source").alias("ext"), "lang")


DOCS = f"SELECT doc_id::VARCHAR AS path, lines, chars, words, sloc, size, source AS ext, lang FROM ({stats_sql('doc_id, source, lang, strlen(text)::BIGINT AS size', 'documents')})"
SHOWN = ["path", "lines", "chars", "words", "sloc"]


@query("file_stats_text", stats_sql("doc_id", "documents"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return analyze_table(_table(spark, d, "documents"), "text", "txt").select("doc_id", "lines", "chars", "words", "sloc")


@query("page_stats", stats_sql("page_id", "pages", "html"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return analyze_table(_table(spark, d, "pages"), "html", "txt").select("page_id", "lines", "chars", "words", "sloc")


@query("conversation_stats", f"SELECT conv_id, count(*)::BIGINT AS turns, sum(lines)::BIGINT AS lines, sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words FROM ({stats_sql('conv_id', 'conversations')}) GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = analyze_table(_table(spark, d, "conversations"), "text", "txt", sloc=False)
    return df.groupBy("conv_id").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in ("lines", "chars", "words")])


@query("line_stats", f"SELECT doc_id, (k - 1)::BIGINT AS line, regexp_matches(l[k], '{INK}')::BIGINT AS sloc, length(l[k])::BIGINT AS chars, {sql_words('l[k]')} AS words FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return line_stats(_table(spark, d, "documents"), "doc_id", "text", "txt").withColumnRenamed("key", "doc_id")


@query("words_unicode", f"SELECT doc_id, {sql_words('t')} AS words FROM (SELECT doc_id, replace(text, ' the ', chr(8195) || 'the' || chr(12288)) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(" the "), F.lit("\u2003the\u3000"))
    return _table(spark, d, "documents").select("doc_id", M.word_count(text).alias("words"))


@query("chars_with_newlines", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", M.char_count(F.col("text"), newlines=True).alias("chars"))


@query("chars_c_family", "SELECT doc_id, length(replace(replace(t, chr(13), ''), chr(10), ''))::BIGINT AS chars FROM (SELECT doc_id, replace(text, ' ', chr(13)) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", M.chars_by_ext(F.replace(F.col("text"), F.lit(" "), F.lit("\r")), "c").alias("chars"))


@query("chars_crlf", f"SELECT doc_id, {sql_chars('t')} AS chars FROM (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", M.chars_by_ext(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "txt").alias("chars"))


@query("binary_flag", "SELECT doc_id, doc_id % 3 = 0 AS is_binary FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A NUL at byte 8191 makes a content binary, one at byte 8192 doesn't."""
    lead = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("a"), F.lit(M.PROBE - 1))).otherwise(F.repeat(F.lit("a"), F.lit(M.PROBE)))
    content = F.concat(lead.cast("binary"), F.lit(b"\0"), F.col("text").cast("binary"))
    return _table(spark, d, "documents").select("doc_id", M.is_binary(content).alias("is_binary"))


@query("lossy_decode", "SELECT doc_id, (length(text) + 2)::BIGINT AS chars FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.lit(b"\xe3\x81"), F.col("text").cast("binary"), F.lit(b"\xff"))
    return _table(spark, d, "documents").select("doc_id", F.length(M.decoded(content)).cast("bigint").alias("chars"))


@query("filter_lines_chars", f"SELECT {', '.join(SHOWN)} FROM ({DOCS}) WHERE lines >= 3 AND lines <= 40 AND chars >= 200 AND chars <= 5000")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = FilterConfig(min_lines=3, max_lines=40, min_chars=200, max_chars=5000)
    return filter_stats(doc_stats(spark, d, first=bounded(f)), f).select(SHOWN)


@query("filter_words_null", f"SELECT path, CASE WHEN lang <> 'en' THEN words END AS words FROM ({DOCS}) WHERE CASE WHEN lang <> 'en' THEN words END BETWEEN 50 AND 400")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Null words are within no bounds."""
    f = FilterConfig(min_words=50, max_words=400)
    df = doc_stats(spark, d, sloc=False, first=bounded(f)).withColumn("words", F.when(F.col("lang") != "en", F.col("words")))
    return filter_stats(df, f).select("path", "words")


@query("filter_size", f"SELECT path, size FROM ({DOCS}) WHERE size BETWEEN 1024 AND 2048")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filter_metadata(doc_stats(spark, d, False, False), FilterConfig(min_size=parse_size("1k"), max_size=parse_size("2KiB"))).select("path", "size")


@query("filter_ext_list", "SELECT doc_id, source FROM documents WHERE lower(source) IN ('src1', 'src2', 'src17')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filter_ext(_table(spark, d, "documents"), [" .SRC1", "src2", "src17", ""], [], "source").select("doc_id", "source")


@query("filter_deny_ext", "SELECT doc_id, source FROM documents WHERE source IS NULL OR lower(source) NOT IN ('src0', 'src3')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filter_ext(_table(spark, d, "documents"), [], ["src0", ".src3"], "source").select("doc_id", "source")


@query("filter_condition", f"SELECT {', '.join(SHOWN)} FROM ({DOCS}) WHERE words > 10 * lines AND ext = 'src4'")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = FilterConfig(condition="words > 10 * lines AND ext = 'src4'")
    return filter_stats(doc_stats(spark, d, first=bounded(f)), f).select(SHOWN)


@query("mtime_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-06-30 12:00:00'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The bounds that --mtime-since and --mtime-until parse to, pushed down to the scan."""
    bounds = FilterConfig(mtime_since=parse_datetime("1995-03-01T00:00:00Z"), mtime_until=parse_datetime("1996-06-30T12:00:00Z"))
    return filter_metadata(_table(spark, d, "orders"), bounds, mtime_col="o_orderdate").select("o_orderkey", "o_orderdate")


@query("sort_multikey_top", f"SELECT path, lines, words FROM (SELECT path, lines, CASE WHEN lang <> 'fr' THEN words END AS words FROM ({DOCS})) ORDER BY coalesce(words, 0) DESC, lines, path LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Null words sort as 0; ties go by path."""
    df = doc_stats(spark, d, sloc=False).withColumns({"words": F.when(F.col("lang") != "fr", F.col("words")), "is_binary": F.lit(False)})
    return reports.presented(df, Config(sort=parse_sort("words:desc, lines"), top=25)).select("path", "lines", "words")


_TOTALS = "count(*)::BIGINT AS files, coalesce(sum(lines), 0)::BIGINT AS lines, coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(sloc), 0)::BIGINT AS sloc"


@query("totals", f"SELECT {_TOTALS} FROM ({DOCS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return totals(doc_stats(spark, d))


@query("totals_by_lang", f"SELECT lang, {_TOTALS} FROM ({DOCS}) GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    return totals(doc_stats(spark, d), "lang")


@query("totals_empty", "SELECT 0::BIGINT AS files, 0::BIGINT AS lines, 0::BIGINT AS chars, 0::BIGINT AS words, 0::BIGINT AS sloc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return totals(doc_stats(spark, d).where("lines < 0"))


# --- snapshots: two made from the documents ---------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old lacks every seventh document, and some words; new lacks every eleventh and has every fifth longer. Some of new come twice, the last counting."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def side(df: DataFrame, text: Column) -> DataFrame:
        path = F.format_string("d%d/f-%d", F.col("doc_id") % 10, "doc_id")
        return analyze_table(df.select("doc_id", path.alias("path"), text.alias("text")), "text", "txt", sloc=False)

    old = side(docs.where("doc_id % 7 <> 0"), F.col("text")).withColumn("words", F.when(F.col("doc_id") % 13 != 0, F.col("words")))
    new = side(docs.where("doc_id % 11 <> 0"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    again = new.where("doc_id % 17 = 0").withColumn("lines", F.col("lines") + 1)
    cols = ["path", "lines", "chars", "words"]
    new = new.withColumn("position", F.col("doc_id")).unionByName(again.withColumn("position", F.col("doc_id") + 1_000_000_000))
    return old.select(*cols), new.select(*cols, "position")


_OLD = f"SELECT path, lines, chars, CASE WHEN doc_id % 13 <> 0 THEN words END AS words FROM ({stats_sql('''doc_id, 'd' || (doc_id % 10) || '/f-' || doc_id AS path''', 'documents', 'text', 'doc_id % 7 <> 0')})"
_LONGER = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'one more line' ELSE text END AS text FROM documents)"
_NEW = f"SELECT path, lines + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS lines, chars, words FROM ({stats_sql('''doc_id, 'd' || (doc_id % 10) || '/f-' || doc_id AS path''', _LONGER, 'text', 'doc_id % 11 <> 0')})"
_DIFF = f"""
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
       WHEN o.lines IS DISTINCT FROM n.lines OR o.chars IS DISTINCT FROM n.chars OR o.words IS DISTINCT FROM n.words THEN 'modified' ELSE 'unchanged' END AS status,
  o.lines AS old_lines, n.lines AS new_lines, o.chars AS old_chars, n.chars AS new_chars, o.words AS old_words, n.words AS new_words,
  coalesce(n.lines, 0) - coalesce(o.lines, 0) AS diff_lines, coalesce(n.chars, 0) - coalesce(o.chars, 0) AS diff_chars,
  CASE WHEN o.path IS NOT NULL AND n.path IS NOT NULL AND (o.words IS NULL OR n.words IS NULL) THEN 0 ELSE coalesce(n.words, 0) - coalesce(o.words, 0) END AS diff_words
FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.path = n.path"""


@query("snapshot_diff_rows", _DIFF)
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_rows(*snapshots(spark, d))


@query(
    "snapshot_diff_summary",
    f"SELECT count(*) FILTER (status = 'added')::BIGINT AS added_files, count(*) FILTER (status = 'removed')::BIGINT AS removed_files, count(*) FILTER (status = 'modified')::BIGINT AS modified_files, count(*) FILTER (status = 'unchanged')::BIGINT AS unchanged_files, "
    f"coalesce(sum(diff_lines) FILTER (status <> 'unchanged'), 0)::BIGINT AS diff_lines, coalesce(sum(diff_chars) FILTER (status <> 'unchanged'), 0)::BIGINT AS diff_chars, coalesce(sum(diff_words) FILTER (status <> 'unchanged'), 0)::BIGINT AS diff_words FROM ({_DIFF})",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_summary(compare.diff_rows(*snapshots(spark, d)))


@query("snapshot_added", f"SELECT * FROM ({_NEW}) WHERE path NOT IN (SELECT path FROM ({_OLD}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.added(*snapshots(spark, d))


@query("snapshot_removed", f"SELECT * FROM ({_OLD}) WHERE path NOT IN (SELECT path FROM ({_NEW}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.removed(*snapshots(spark, d))


@query("snapshot_dedupe_last", f"SELECT * FROM ({_NEW})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.last_of_each(snapshots(spark, d)[1])


@query("snapshot_order", f"SELECT path, (row_number() OVER (ORDER BY string_split(path, '/')))::BIGINT AS nth FROM ({_OLD})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Paths compare component by component. The numbering needs one partition; a report's sort doesn't."""
    return snapshots(spark, d)[0].select("path", F.row_number().over(Window.orderBy(compare.by_component())).cast("bigint").alias("nth"))


_SIGNED = "CASE WHEN {0} >= 0 THEN '+' ELSE '' END || {0}"


@query(
    "diff_report",
    f"""SELECT CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END::INTEGER AS section, path,
  CASE status WHEN 'added' THEN '+ ' || path || ' (L:' || new_lines || ', C:' || new_chars || ')' WHEN 'removed' THEN '- ' || path || ' (L:' || old_lines || ', C:' || old_chars || ')'
  ELSE '~ ' || path || ' (Lines: ' || {_SIGNED.format('diff_lines')} || ', Chars: ' || {_SIGNED.format('diff_chars')} || ')' END AS line FROM ({_DIFF}) WHERE status <> 'unchanged'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.section_lines(compare.diff_rows(*snapshots(spark, d)))


@query("snapshot_source", f"SELECT path, lines, chars, words, NULL::BIGINT AS sloc, lines - 1 AS position FROM ({_OLD}) WHERE path LIKE 'd3/%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot's JSON as read_snapshot parses it: an array in one text, without the counts that it lacks."""
    old = snapshots(spark, d)[0].where("path LIKE 'd3/%'").select("path", "lines", "chars", "words")
    whole = old.groupBy().agg(F.to_json(F.collect_list(F.struct("path", "lines", "chars", "words")), {"ignoreNullFields": "false"}).alias("value"))
    return parse_snapshot(whole).select("path", "lines", "chars", "words", "sloc", (F.col("lines") - 1).alias("position"))


# --- reports ----------------------------------------------------------------------------------------------------------


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, Config]:
    df = doc_stats(spark, d).withColumns({"is_binary": F.lit(False), "name": F.col("ext"), "mtime": F.lit(None).cast("timestamp"), "path": F.concat_ws(",", F.col("lang"), F.lit('a"|'), F.col("path"))})
    return df, Config(count_sloc=True, count_words=True)


_NAMED = f"SELECT * REPLACE (lang || ',a\"|,' || path AS path) FROM ({DOCS})"


@query("report_csv", f"SELECT lines || ',' || sloc || ',' || chars || ',' || words || ',\"' || replace(path, '\"', '\"\"') || '\"' AS line FROM ({_NAMED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, config = _report(spark, d)
    return df.select(reports.separated(config, ",").alias("line"))


@query("report_tsv", f"SELECT lines || chr(9) || sloc || chr(9) || chars || chr(9) || words || chr(9) || path AS line FROM ({_NAMED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, config = _report(spark, d)
    return df.select(reports.separated(config, "\t").alias("line"))


@query("report_md", f"SELECT '| ' || lines || ' | ' || sloc || ' | ' || chars || ' | ' || words || ' | ' || replace(path, '|', '\\|') || ' |' AS line FROM ({_NAMED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, config = _report(spark, d)
    return df.select(reports.markdown(config).alias("line"))


@query("report_table", f"SELECT lpad(lines::VARCHAR, greatest(9, length(lines::VARCHAR))::INTEGER, ' ') || lpad(sloc::VARCHAR, 16, ' ') || lpad(chars::VARCHAR, 16, ' ') || '      ' || path AS line FROM ({_NAMED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, config = _report(spark, d)
    return df.select(reports.table_row(config).alias("line"))


@query("report_json", f"""SELECT chr(32) || chr(32) || '{{' || chr(10) || '    "path": "' || replace(path, '"', '\\"') || '",' || chr(10) || '    "lines": ' || lines || ',' || chr(10) || '    "chars": ' || chars || ',' || chr(10) || '    "words": ' || words || ',' || chr(10) || '    "sloc": ' || sloc || ',' || chr(10) || '    "size": ' || size || ',' || chr(10)
  || '    "mtime": null,' || chr(10) || '    "ext": "' || ext || '",' || chr(10) || '    "name": "' || ext || '",' || chr(10) || '    "is_binary": false' || chr(10) || '  }}' AS line FROM ({_NAMED})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[0].select(reports.json_block().alias("line"))


@query("report_yaml", f"""SELECT '- path: ' || chr(39) || path || chr(39) || chr(10) || '  lines: ' || lines || chr(10) || '  chars: ' || chars || chr(10) || '  words: ' || words || chr(10) || '  sloc: ' || sloc || chr(10) || '  size: ' || size || chr(10)
  || '  mtime: null' || chr(10) || '  ext: ' || ext || chr(10) || '  name: ' || ext || chr(10) || '  is_binary: false' AS line FROM ({_NAMED})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[0].select(reports.yaml_block().alias("line"))


@query("report_jsonl", f"""SELECT '{{"chars":' || chars || ',"ext":"' || ext || '","is_binary":false,"lines":' || lines || ',"mtime":null,"name":"' || ext || '","path":"' || replace(path, '"', '\\"') || '","size":' || size || ',"sloc":' || sloc || ',"type":"file","words":' || words || '}}' AS line FROM ({_NAMED})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[0].select(reports.json_object({"type": "file"}, alphabetical=True).alias("line"))


_FEET = {
    "csv": "SELECT 'TOTAL' AS what, lines || ',' || sloc || ',' || chars || ',' || words || ',TOTAL' AS line",
    "jsonl": f"""SELECT 'TOTAL' AS what, '{{"chars":' || chars || ',"files":' || files || ',"lines":' || lines || ',"sloc":' || sloc || ',"type":"total","version":"{__version__}","words":' || words || '}}' AS line""",
    "table": f"SELECT 'TOTAL' AS what, '---' || chr(10) || lpad(lines::VARCHAR, greatest(9, length(lines::VARCHAR))::INTEGER, ' ') || lpad(sloc::VARCHAR, 16, ' ') || lpad(chars::VARCHAR, 16, ' ') || '      TOTAL (' || files || ' files)' || chr(10) || chr(10) || '[{reports.PROGRAM}] Completed: ' || files || ' files processed.' AS line",
}


def _add_foot(fmt: str) -> None:
    @query(f"report_{fmt}_total", f"{_FEET[fmt]} FROM (SELECT {_TOTALS} FROM ({DOCS}))")
    def _(spark: SparkSession, d: str) -> DataFrame:
        df, config = _report(spark, d)
        config.format, config.total_row = fmt, True
        return reports.foot_lines(totals(df), config).select(F.lit("TOTAL").alias("what"), "line")


for _fmt in _FEET:
    _add_foot(_fmt)


# --- source lines of each style ---------------------------------------------------------------------------------------

#: Characters that some style reads. They are taken out of the documents, so that only the marks that are put in count.
_READ = "\"'`#\\/*<>{}=%;@$!&|:()[]-"
_CLEAN_SQL = "translate(text, '" + _READ.replace("'", "''") + "', '')"


class Styled(NamedTuple):
    """A style's marks. Every document's lines that begin with T become line comments, with A comments of one line, with S
    code with a literal that holds marks, with I three lines with a comment or a document over them; a blank line follows
    those with E. counts: the code lines that a T, an A and an I line make."""

    name: str
    ext: str
    line: str
    block: tuple[str, str] = ("", "")
    literal: tuple[str, str] = ("", "")
    lines: tuple[str, str] = ("", "")
    blanks: bool = False
    counts: tuple[int, int, int] = (0, 0, 0)


_C = {"block": ("/* ", " */"), "lines": ("/* a\n", "\nb */")}
STYLED = (
    Styled("c", "c", "// ", **_C, literal=('s = "// ', ' \\" /* ";')), Styled("cpp", "cpp", "  // ", ("/*", "*/"), ('s = R"x(// ) " ', ' /* )x";'), ("/*\n", "\n*/")),
    Styled("csharp", "cs", "// ", **_C, literal=('s = @"// ""', ' /* \\";')), Styled("java", "java", "// ", **_C, literal=('s = """// "', ' /* """;')), Styled("go", "go", "// ", **_C, literal=("s := `// \"", " /* ` ")),
    Styled("rust", "rs", "// ", ("/* /* ", " */ */"), ('s = r#"// "', ' /* "#;'), ("/* /*\n", "\n*/ a\n*/")), Styled("kotlin", "kt", "// ", **_C, literal=('s = "// ', ' /* "')),
    Styled("javascript", "ts", "// ", **_C, literal=("s = `// ", " ${ a /* b */ } /* `;")), Styled("swift", "swift", "// ", **_C, literal=('s = #"// "', ' /* "#'), blanks=True),
    Styled("d", "d", "// ", ("/+ ", " +/"), ('s = "// ', ' /+ /* ";'), ("/+ /+\n", "\n+/ +/"), True), Styled("php", "php", "# ", **_C, literal=('$s = "# ', ' // /* ";')),
    Styled("python", "py", "# ", ('"""', '"""'), ("s = f'# ", " {a} #'"), ('"""\n', '\n"""')), Styled("ruby", "rb", "  # ", ("# ", ""), ('s = "# ', ' #{a} #"'), ("=begin\n", "\n=end")),
    Styled("perl", "pl", "# ", ("# ", ""), ('$s = "# ', ' #";'), ("=pod\n", "\n=cut")), Styled("shell", "sh", "# ", ("# ", ""), ('s="# ', ' #"'), ('cat << "EOF"\n# ', "\nEOF"), counts=(0, 0, 3)),
    Styled("hash", "toml", "# ", ("# ", ""), ('s = "# ', ' #"'), ("# ", "\n# a\n# b"), True), Styled("powershell", "ps1", "# ", ("<# ", " #>"), ('$s = "# ', ' #"'), ("<#\n", "\n#>")),
    Styled("lua", "lua", "-- ", ("--[[ ", " ]]"), ("s = '-- ", " --[['"), ("--[==[\n", " ]]\n]==]"), True), Styled("html", "html", "<!-- x -->", ("<!-- ", " -->"), ("<a>", "</a><!-- x -->"), ("<!--\n", "\n-->"), True, (1, 0, 0)),
    Styled("sql", "sql", "-- ", ("/* ", " */"), ("s = '-- ''", " /* '"), ("/*\n", "\n*/"), True), Styled("haskell", "hs", "-- ", ("{- ", " -}"), ("s = ", " -- x"), ("{- {-\n", " -}\n-}"), True),
    Styled("julia", "jl", "# ", ("#= ", " =#"), ("s = ", " # x"), ("#= #=\n", " =#\n=#"), True), Styled("ocaml", "ml", "(* x *) ", ("(* ", " *)"), ("s = ", " (* x *)"), ("(* (*\n", " *)\n*)"), True, (1, 0, 0)),
    Styled("matlab", "mlx", "% ", ("% ", ""), ("s = ", " % x"), ("%{\n", "\n%}"), True), Styled("gas", "s", "@ ", ("/* ", " */"), ("mov ", " /* x */"), ("/*\n", "\n*/"), True),
    Styled("fortran", "f90", "  ! ", ("! ", ""), ("s = ", " ! x"), ("! ", "\n!\nc a")), Styled("plain", "txt", "", counts=(1, 1, 1)),
)


def styled(text: Column, style: Styled) -> Column:
    """A document with the style's marks put in."""
    wrap = lambda line, marks: F.concat(F.lit(marks[0]), line, F.lit(marks[1]))

    def change(line: Column) -> Column:
        begins = lambda c: F.startswith(line, F.lit(c))
        return (
            F.when(begins("T"), wrap(line, (style.line, ""))).when(begins("A"), wrap(line, style.block)).when(begins("S"), wrap(line, style.literal))
            .when(begins("I"), wrap(line, style.lines)).when(begins("E"), wrap(line, ("", "\n "))).otherwise(line)
        )

    return F.array_join(F.transform(F.split(F.translate(text, _READ, ""), "\n"), change), "\n")


def styled_sql(style: Styled) -> str:
    """Code lines by what each line of the documents was made into."""
    blank = int(style.blanks)
    t, a, i = style.counts
    other = "WHEN regexp_matches(l, '^[Cc]') THEN 0 " if style.name == "fortran" else ""
    weight = f"CASE WHEN starts_with(l, 'T') THEN {t} WHEN starts_with(l, 'A') THEN {a} WHEN starts_with(l, 'S') THEN 1 WHEN starts_with(l, 'I') THEN {i} WHEN starts_with(l, 'E') THEN {1 + blank} {other}WHEN regexp_matches(l, '{INK}') THEN 1 ELSE {blank} END"
    return f"SELECT doc_id, coalesce(list_sum(list_transform(CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END, lambda l: {weight})), 0)::BIGINT AS sloc FROM (SELECT doc_id, string_split({_CLEAN_SQL}, chr(10)) AS l FROM documents)"


def _add_style(style: Styled) -> None:
    @query(f"sloc_{style.name}", styled_sql(style))
    def _(spark: SparkSession, d: str) -> DataFrame:
        return _table(spark, d, "documents").select("doc_id", M.code_count(styled(F.col("text"), style), style.ext).alias("sloc"))


for _style, _ext in (("vhdl", "vhd"), ("erlang", "tex"), ("lisp", "el"), ("assembly", "asm"), ("batch", "cmd"), ("basic", "vbs")):
    _mark = PREFIXES[_style][0][-1]
    STYLED += (Styled(f"prefix_{_style}", _ext, "\t" + _mark.lower(), (_mark, ""), ("x ", f" {_mark} y"), (_mark, f"\n {_mark} a\n{_mark} b"), True),)
for _entry in STYLED:
    _add_style(_entry)


@query("sloc_mixed_ext", f"SELECT doc_id, {sql_sloc('t', 'CASE WHEN doc_id % 2 = 0 THEN NOT starts_with(l, chr(35)) ELSE TRUE END AND regexp_matches(l, ' + chr(39) + INK + chr(39) + ')')} AS sloc FROM (SELECT doc_id, regexp_replace({_CLEAN_SQL}, '(?m)^(T.*)$', '# \\1', 'g') AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A different style for each row: Python's for even documents, none for the others; Python workers get only the former."""
    text = F.regexp_replace(F.translate("text", _READ, ""), "(?m)^(T.*)$", "# $1")
    ext = F.when(F.col("doc_id") % 2 == 0, "PY").otherwise("txt")
    return _table(spark, d, "documents").select("doc_id", M.code_count(text, ext).alias("sloc"))


#: Line after line: whether a comment is open, and the code lines so far.
_HTML_FOLD = f"""
WITH lines AS (SELECT page_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)),
folded AS (SELECT page_id, list_reduce(list_prepend({{'l': '', 'inside': FALSE, 'n': 0::BIGINT}}, list_transform(l, lambda x: {{'l': x, 'inside': FALSE, 'n': 0::BIGINT}})), lambda a, x: {{
  'l': '',
  'inside': CASE WHEN a.inside THEN strpos(x.l, '-->') = 0 ELSE strpos(x.l, '<!--') > 0 AND strpos(substr(x.l, strpos(x.l, '<!--') + 4), '-->') = 0 END,
  'n': a.n + CASE
    WHEN a.inside THEN CASE WHEN strpos(x.l, '-->') > 0 AND regexp_matches(substr(x.l, strpos(x.l, '-->') + 3), '{INK}') THEN 1 ELSE 0 END
    WHEN strpos(x.l, '<!--') = 0 OR regexp_matches(substr(x.l, 1, strpos(x.l, '<!--') - 1), '{INK}') THEN 1
    WHEN strpos(substr(x.l, strpos(x.l, '<!--') + 4), '-->') > 0 AND regexp_matches(substr(x.l, strpos(x.l, '<!--') + 4 + strpos(substr(x.l, strpos(x.l, '<!--') + 4), '-->') + 2), '{INK}') THEN 1 ELSE 0 END}}) AS f FROM lines)
SELECT page_id, f.n AS sloc FROM folded"""


@query("sloc_html_all_pages", _HTML_FOLD)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", M.code_count(F.col("html"), "html").alias("sloc"))


@query("map_ext", "SELECT doc_id, CASE source WHEN 'src1' THEN 'PY' WHEN 'src2' THEN 'rs' ELSE source END AS ext FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", M.mapped_ext(F.col("source"), {"src1": "PY", "src2": "rs", "SRC3": "c"}).alias("ext"))


@query("scan_files")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The folder's own files, found and analysed."""
    found = Engine(spark).run(Config(walk=WalkOptions(roots=[d], threads=4, follow_links=True), filter=FilterConfig(max_size=1 << 20)))
    return found.stats.select("name", "ext", "size", "lines", "chars", "is_binary")


