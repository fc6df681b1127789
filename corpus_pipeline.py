"""From raw documents to token ids: quality rules, near-dedup, secrets, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last return the columns of their docs, others than those of documents too. Stages work on whole texts;
an empty table passes through all of them as an empty one, and ties are settled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import mixing, pieces, quality, secrets, simhash
from granary.sources.tables import read_table, ship_package, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; null, empty and blank texts go. See ``quality.keep_quality`` for all other cases."""
    ship_package(spark)
    return quality.keep_quality(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies; different texts that share a key stay. See ``simhash.drop_near_copies``."""
    ship_package(spark)
    return simhash.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, nulls and repeated rows too, with live credentials masked. See ``secrets.redact_secrets``."""
    ship_package(spark)
    return secrets.redact_secrets(docs)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source in the target weights, some of them more than once; null keys and texts are not eligible. See ``mixing.mix``."""
    ship_package(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded) of every row; null for null, other columns go. See ``pieces.encode``."""
    ship_package(spark)
    return pieces.encode(docs, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("secret scans", redact),
    ("mixing", blend),
    ("SentencePiece", tokenize),
]

#: The signatures of the near-dedup can't be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage but the last is written to a new folder in the shared checkpoint folder, for as long as the application runs."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
