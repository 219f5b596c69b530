"""Watching: a stream of changes of the watched trees, each of which has the batch plan run again."""

from __future__ import annotations

import hashlib
import json
import os
import sys
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import ConfigError, EngineError
from ..operators.reports import PROGRAM, render
from ..plans.config import Config
from ..plans.engine import Engine

NAME = "textloom_changes"
CLEAR = "\x1b[2J\x1b[1;1H"


def fingerprint(roots: list[str]) -> str:
    """A digest of names, sizes and times of everything below the roots."""
    seen = hashlib.sha256()
    for root in roots:
        for folder, dirs, files in os.walk(root):
            dirs.sort()
            for name in sorted([*dirs, *files]):
                try:
                    info = os.lstat(os.path.join(folder, name))
                    seen.update(f"{folder}/{name}\0{info.st_size}\0{info.st_mtime_ns}\0".encode("utf-8", "surrogateescape"))
                except OSError:
                    continue
        if os.path.isfile(root):
            info = os.stat(root)
            seen.update(f"{root}\0{info.st_size}\0{info.st_mtime_ns}\0".encode())
    return seen.hexdigest()


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.interval = json.loads(options["roots"]), float(options.get("interval", 0))

    def initialOffset(self) -> dict[str, str]:
        return {"print": ""}

    def read(self, start: dict[str, str]) -> tuple[Iterator[tuple], dict[str, str]]:
        now = fingerprint(self.roots)
        if start["print"] and now != start["print"]:
            # what changes within an interval of the first change belongs to it
            time.sleep(self.interval)
            now = fingerprint(self.roots)
        return iter([] if now == start["print"] else [(now,)]), {"print": now}

    def readBetweenOffsets(self, start: dict[str, str], end: dict[str, str]) -> Iterator[tuple]:
        return iter([] if end["print"] == start["print"] else [(end["print"],)])


class ChangesSource(DataSource):
    """A row for each state of the trees that differs from the one before; the first state is a row too."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "print string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def on_change(spark: SparkSession, roots: list[str], interval: float, run: Callable[[], None], checkpoint: str | None = None) -> StreamingQuery:
    """Runs `run` once, and again an interval after every change of the trees; changes within that interval count as one. On a cluster the stream's checkpoint needs spark.checkpoint.dir."""
    spark.dataSource.register(ChangesSource)
    changes = spark.readStream.format(NAME).option("roots", json.dumps(roots)).option("interval", str(interval)).load()

    def each(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            run()

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if checkpoint is None and not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
    if checkpoint is None and shared:
        checkpoint = f"{shared.rstrip('/')}/{PROGRAM}/watch-{uuid.uuid4().hex}"
    writer = changes.writeStream.foreachBatch(each).trigger(processingTime=f"{max(1, round(interval * 1000))} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def cycle(engine: Engine, config: Config, say: Callable[[str], None] = print) -> None:
    """One run with its report; errors are told and don't end the watch."""
    if config.watch_output == "full":
        say(CLEAR)
    try:
        result = engine.run(config, once=True)
        for r in result.errors.toLocalIterator():
            print(f"Error processing {r.path}: {r.error}", file=sys.stderr)
        for line in render(result.stats, config):
            say(line)
    except EngineError as bad:
        print(f"Error in watch cycle: {bad}", file=sys.stderr)


def watch(engine: Engine, config: Config) -> None:
    """Never returns."""
    print(f"[{PROGRAM}] Starting watch mode...")
    query = on_change(engine.spark, [r for r in config.walk.roots if os.path.exists(r)], config.watch_interval, lambda: cycle(engine, config))
    while query.isActive:
        time.sleep(1)
