"""Saved results as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE_STATS


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of file statistics, with `position`, their place in it. Counts that it lacks are null; anything but such an array is an error."""
    return parse_snapshot(spark.read.text(path, wholetext=True))


def parse_snapshot(whole: DataFrame) -> DataFrame:
    """read_snapshot of arrays that are texts in the column `value`."""
    rows = F.from_json("value", f"array<{FILE_STATS.simpleString()}>", {"mode": "FAILFAST"})
    return whole.select(F.posexplode(rows).alias("position", "row")).select("position", "row.*")


def write_snapshot(stats: DataFrame, path: str) -> None:
    """One JSON object for each file, as Spark writes them; read_snapshot_lines reads them again."""
    stats.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot written by write_snapshot, which scales beyond one file. Rows have no position."""
    return spark.read.schema(FILE_STATS).json(path)
