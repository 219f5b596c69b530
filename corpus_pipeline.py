"""The corpus pipeline: raw documents to a mixed, tokenised corpus, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe_codec import encode
from textloom.llm.common import made, release, written
from textloom.llm.exact_dedup import drop_exact_duplicates
from textloom.llm.language_id import keep_identified
from textloom.llm.mixing import mix_sources
from textloom.llm.simhash_dedup import drop_near_duplicates


#: What holds for every stage: rows with nulls in any column, empty and very long texts, ties, repeated rows and columns
#: of any name are rows like others; texts are used whole; an empty table gives an empty one.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that are rejected go.

    Null and empty texts, and texts without letters, can't be told and go. Ids, labels and other columns may be null and
    are carried as they are; a null or blank label is not learnt from, and without any label every document goes.
    Repeated rows stay or go together. An empty table gives none.
    """
    return keep_identified(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the least doc_id, nulls last, and of equal ones the first row.

    Null texts are equal to nothing and stay; empty texts are equal to each other. Nulls in other columns are carried.
    Long texts are compared whole. An empty table gives none.
    """
    return drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, nulls last, and of equal ones the first row.

    Null texts and texts without a word are no one's near-duplicate and stay. Nulls in other columns are carried. The
    signatures are of whole texts. An empty table gives none.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a random order.

    A null source is one of its own. A null text weighs nothing and follows its source's rate; a source without any
    characters gets no rows. Equal rows are repeated equally often; nulls in other columns are carried. An empty table
    gives none.
    """
    return mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture, as (doc_id, token_ids, n_tokens, round_trip).

    A null text has null in the last three, an empty one no ids. Null ids are carried; repeated rows give equal rows.
    Long texts are encoded whole. An empty table gives none.
    """
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("mix_sources", mix),
    ("bpe_encode", tokenise),
]

#: The language, near-duplicate and encoding stages can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's result written to the shared folder and read again.

    What a stage left in the shared folder is deleted once its result is written, and a result once the next is. Odd
    rows and tables have the results that the stages state.
    """
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, begun, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
