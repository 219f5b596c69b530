"""The command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import __version__
from .errors import ConfigError, EngineError
from .operators import compare, reports
from .plans import config as C
from .plans.engine import Engine
from .sources.snapshot import read_snapshot
from .streaming.watch import watch


def _of(parse: Callable) -> Callable:
    """A parser whose errors argparse shows."""

    def run(text: str):
        try:
            return parse(text)
        except ConfigError as bad:
            raise argparse.ArgumentTypeError(str(bad)) from bad

    return run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=reports.PROGRAM, description="Counts lines, characters, words and source lines of files.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("paths", nargs="*")
    names = _of(lambda t: [x for x in t.split(",")])
    count, positive, jobs = _of(lambda t: C.parse_bounded(t, 0)), _of(C.parse_bounded), _of(lambda t: C.parse_bounded(t, 1, 512))
    out = p.add_argument_group("output")
    out.add_argument("--format", choices=C.FORMATS, default="table")
    out.add_argument("--sort", type=_of(C.parse_sort), default=[("lines", False)], metavar="KEY[:desc],...")
    for flag in ("--total-row", "--count-newlines-in-chars", "--progress"):
        out.add_argument(flag, action="store_true")
    f = p.add_argument_group("filters")
    for flag in ("--include", "--exclude", "--ext"):
        f.add_argument(flag, type=names, action="extend", default=[])
    for flag in ("--max-size", "--min-size"):
        f.add_argument(flag, type=_of(C.parse_size))
    for flag in ("--min-lines", "--max-lines", "--min-chars", "--max-chars", "--min-words", "--max-words"):
        f.add_argument(flag, type=count)
    f.add_argument("--words", action="store_true")
    f.add_argument("--sloc", action="store_true")
    for flag in ("--mtime-since", "--mtime-until"):
        f.add_argument(flag, type=_of(C.parse_datetime))
    f.add_argument("--map-ext", type=_of(C.parse_pair), action="append", default=[])
    s = p.add_argument_group("scan")
    for flag in ("--hidden", "--follow", "--no-gitignore"):
        s.add_argument(flag, action="store_true")
    s.add_argument("--jobs", type=jobs)
    s.add_argument("--max-depth", type=positive)
    s.add_argument("--walk-threads", type=jobs)
    for flag in ("--override-include", "--override-exclude"):
        s.add_argument(flag, type=names, action="extend", default=[])
    b = p.add_argument_group("behaviour")
    b.add_argument("--strict", action="store_true")
    b.add_argument("-w", "--watch", action="store_true")
    b.add_argument("--watch-interval", type=positive, default=1)
    b.add_argument("--watch-output", choices=("full", "jsonl"), default="full")
    b.add_argument("--compare", nargs=2, metavar=("OLD", "NEW"))
    x = p.add_argument_group("additions")
    x.add_argument("--by", choices=("ext", "name", "is_binary"), help="totals by a column")
    x.add_argument("--filter", help="an SQL condition over the statistics")
    x.add_argument("--top", type=positive, help="the first rows of the order")
    x.add_argument("--output", metavar="DIR", help="have executors write the report there instead of printing it")
    return p


def config_of(a: argparse.Namespace) -> C.Config:
    walk = C.WalkOptions(
        roots=a.paths or ["."], threads=a.walk_threads or a.jobs or C.default_threads(), hidden=a.hidden, git_ignore=not a.no_gitignore, max_depth=a.max_depth, follow_links=a.follow,
        override_include=a.override_include, override_exclude=a.override_exclude,
    )
    bounds = {k: getattr(a, k) for k in ("min_lines", "max_lines", "min_chars", "max_chars", "min_words", "max_words", "min_size", "max_size", "mtime_since", "mtime_until")}
    chosen = C.FilterConfig(allow_ext=a.ext, include_patterns=a.include, exclude_patterns=a.exclude, map_ext=dict(a.map_ext), condition=a.filter, **bounds)
    return C.Config(
        walk=walk, filter=chosen, format=a.format, sort=a.sort, total_row=a.total_row, count_newlines_in_chars=a.count_newlines_in_chars, progress=a.progress, count_words=a.words, count_sloc=a.sloc,
        strict=a.strict, watch=a.watch, watch_interval=a.watch_interval, watch_output=a.watch_output, compare=tuple(a.compare) if a.compare else None, by=a.by, top=a.top, output=a.output,
    ).resolved()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    config = config_of(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName(reports.PROGRAM).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if config.compare:
            for line in compare.report(*(read_snapshot(spark, p) for p in config.compare)):
                print(line)
        elif config.watch:
            watch(Engine(spark), config)
        else:
            result = Engine(spark).run(config, once=True)
            for r in result.errors.toLocalIterator():
                print(f"Error processing {r.path}: {r.error}", file=sys.stderr)
            if config.output:
                reports.write_lines(result.stats, config, config.output)
                return 0
            for line in reports.render(result.stats, config):
                print(line)
    except EngineError as bad:
        print(f"Application Error: {bad}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
