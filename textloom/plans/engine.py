"""A run: from options to statistics and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EngineError, FileReadError
from ..operators.stats import bounded, file_stats, filter_stats
from ..schema import ERRORS, FILE_STATS
from ..sources.files import read_files
from .config import Config


@dataclass
class RunResult:
    """stats: a row for each analysed file, binary ones included. errors: (path, error) of the others."""

    stats: DataFrame
    errors: DataFrame

    def file_count(self) -> int:
        return self.stats.count()

    def error_count(self) -> int:
        return self.errors.count()

    def has_errors(self) -> bool:
        return bool(self.errors.take(1))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def run(self, config: Config, once: bool = False) -> RunResult:
        """Lazy, but in strict mode, where the first error is raised.

        once: files are read now, a single time, and what is kept of them serves statistics, errors and totals alike, so
        that these agree even while files change. It is checkpointed where there is a folder for that, else cached; then
        rows of an executor that is lost are read again.
        """
        config = config.resolved()
        try:
            files = read_files(self.spark, config.walk, config.filter)
        except EngineError as bad:
            if config.strict or not isinstance(bad, ConfigError):
                raise
            return RunResult(self.spark.createDataFrame([], FILE_STATS), self.spark.createDataFrame([("<walk>", str(bad))], ERRORS))
        each = file_stats(files, config.count_words, config.count_sloc, config.count_newlines_in_chars, config.filter.map_ext, bounded(config.filter))
        if once or config.strict:
            each = each.checkpoint() if self.spark.conf.get("spark.checkpoint.dir", None) else each.persist(StorageLevel.MEMORY_AND_DISK)
        stats = filter_stats(each.where("error IS NULL"), config.filter)
        errors = each.where("error IS NOT NULL").select("path", "error")
        if config.strict and (first := errors.orderBy("path").take(1)):
            raise FileReadError(first[0].error)
        return RunResult(stats.select(*[F.col(f.name) for f in FILE_STATS]), errors)
