"""The queries of the corpus operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.stats import spread

from . import bpe_codec, chat, exact_dedup, language_id, license_scan, media, mixing, secret_scan, simhash_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(spread(_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), copy_col="copy")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spread(_table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spread(_table(spark, sf_dir, "documents")))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(spread(_table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(_table(spark, sf_dir, "documents")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages declare the type that their address's extension stands for, and HTML where it has none."""
    declared = F.coalesce(media.declared_by_address(F.col("url")), F.lit("text/html"))
    return media.sniff_media(spread(_table(spark, sf_dir, "pages")), "page_id", "html", declared).withColumnRenamed("id", "page_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spread(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_exact_dedup, op3_mix_sources, op4_simhash_near_dedup, op5_chat_format,
        op6_license_scan, op7_bpe_codec, op8_token_counts, op9_media_columns, op10_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
    "op3_mix_sources": mixing.MIX_SQL,
    "op5_chat_format": chat.CHAT_SQL,
}
