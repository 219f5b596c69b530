"""Queries that scan a tree of files made from the documents, with the same in DuckDB's SQL over the documents."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from .config import Config, FilterConfig, WalkOptions
from .engine import Engine, RunResult
from .queries import query, stats_sql

#: Where a document's file lies, by its number: in the root, one folder down, or deeper than any root that is used here.
DEEP = "/".join(["sub", *["x"] * 20])
#: Name by number: every fifth number has another extension; every eleventh is hidden, every thirteenth is ignored.
_EXT = "CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'rs' WHEN 2 THEN 'txt' WHEN 3 THEN 'html' ELSE 'PY' END"
_NAME = f"CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN 'skip_' ELSE '' END || 'd' || doc_id || '.' || {_EXT}"
_FOLDER = f"CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'sub/' ELSE '{DEEP}/' END"
_TREES: dict[tuple[str, str], str] = {}


def tree(spark: SparkSession, sf_dir: str) -> str:
    """The folder with a file for each document, written by executors once for a process; it goes when the process ends."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TREES:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/" + shared.removeprefix("file:").lstrip("/") if shared else tempfile.gettempdir()
        root = os.path.join(base, f"textloom-tree-{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, root, True)
        for folder in ("", ".git", DEEP):
            os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, ".gitignore"), "w") as f:
            f.write("skip_*\n")

        def write(rows) -> None:
            for r in rows:
                with open(f"{root}/{r.path}", "w", encoding="utf-8", newline="") as f:
                    f.write(r.text)

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
        docs.select(F.expr(f"{_FOLDER} || {_NAME}").alias("path"), "text").foreachPartition(write)
        _TREES[key] = root
    return _TREES[key]


def scan(spark: SparkSession, sf_dir: str, walk: dict | None = None, **filters) -> RunResult:
    options = WalkOptions(roots=[tree(spark, sf_dir)], threads=4, **(walk or {}))
    return Engine(spark).run(Config(walk=options, filter=FilterConfig(**filters), count_words=True))


def shown(result: RunResult) -> DataFrame:
    # the tree's own .gitignore is hidden, and shows where hidden files do
    return result.stats.where("name <> '.gitignore'").select("name", "ext", "size", "lines", "chars", "words")


def _sql(where: str) -> str:
    of = stats_sql(f"doc_id, {_NAME} AS name, {_EXT} AS ext, strlen(text)::BIGINT AS size", "documents", where=where)
    return f"SELECT name, ext, size, lines, chars, words FROM ({of})"


#: The ignored names begin with their mark, so a hidden one isn't ignored.
_HELD = "NOT (doc_id % 13 = 0 AND doc_id % 11 <> 0)"
_SEEN = "doc_id % 11 <> 0 AND doc_id % 13 <> 0"


@query("scan_tree", _sql(_SEEN))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Neither hidden nor ignored files."""
    return shown(scan(spark, d))


@query("scan_hidden", _sql(_HELD))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(scan(spark, d, {"hidden": True}))


@query("scan_no_gitignore", _sql("doc_id % 11 <> 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(scan(spark, d, {"git_ignore": False}))


@query("scan_max_depth", _sql(f"{_SEEN} AND doc_id % 3 <> 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same bound holds for the root's own path, which has fewer parts."""
    return shown(scan(spark, d, {"max_depth": 15}))


@query("scan_globs", _sql("doc_id % 5 IN (1, 3) AND doc_id % 3 = 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """What no glob names is left out; of globs that name a file the last decides. They come before all other rules."""
    return shown(scan(spark, d, {"override_include": ["*.rs", "*.html"], "override_exclude": ["sub/"]}))


@query("scan_types", _sql(f"{_HELD} AND doc_id % 5 = 3"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """A file of a wanted type is seen even if it is hidden, but not if it is ignored."""
    return shown(scan(spark, d, {"types": ["html"]}))


@query("scan_ext_and_size", _sql(f"{_SEEN} AND doc_id % 5 IN (0, 4) AND strlen(text) BETWEEN 500 AND 3000"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Extensions match without case; sizes are decided before anything is read."""
    return shown(scan(spark, d, allow_ext=[".py"], min_size=500, max_size=3000))


@query("scan_result_bounds", f"SELECT * FROM ({_sql(_SEEN)}) WHERE words BETWEEN 50 AND 400 AND lines <= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(scan(spark, d, min_words=50, max_words=400, max_lines=20))


@query("scan_counts", f"SELECT count(*)::BIGINT AS files, 0::BIGINT AS errors, FALSE AS has_errors FROM documents WHERE {_SEEN}")
def _(spark: SparkSession, d: str) -> DataFrame:
    result = scan(spark, d)
    return spark.createDataFrame([(result.file_count(), result.error_count(), result.has_errors())], "files bigint, errors bigint, has_errors boolean")


@query("scan_errors", "SELECT * FROM (VALUES ('missing', 0::BIGINT, 0::BIGINT), ('none', 0, 0), ('unsafe', 0, 1), ('too deep', 0, 1)) AS t(roots, files, errors)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """No roots and roots that aren't there give nothing; unsafe ones, and ones deeper than the bound, an error."""
    root = tree(spark, d)
    rows = []
    for name, roots, depth in (("missing", [f"{root}/nothing"], None), ("none", [], None), ("unsafe", ["../" * 40 + "x"], None), ("too deep", [root], 1)):
        result = Engine(spark).run(Config(walk=WalkOptions(roots=roots, max_depth=depth)))
        rows.append((name, result.file_count(), result.error_count()))
    return spark.createDataFrame(rows, "roots string, files bigint, errors bigint")
