"""Named queries of the training-data operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.sources.tables import read_table

from . import langid, media, mixing, pieces, quality, secrets, sharding, simhash, substrings, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: langid.identify(_docs(s, d)),
        "op2_quality_rules": lambda s, d: quality.keep_quality(_docs(s, d)),
        "op3_simhash_dedup": lambda s, d: simhash.groups(_docs(s, d)),
        "op4_mixing": lambda s, d: mixing.mix(_docs(s, d)),
        "op5_substring_dedup": lambda s, d: substrings.repeats(_docs(s, d)),
        "op6_sentencepiece": lambda s, d: pieces.encode(_docs(s, d), decoded=True),
        "op7_toxicity": lambda s, d: toxicity.find_toxic(_docs(s, d), read_table(s, d, "labels")),
        "op8_sharding": lambda s, d: sharding.shards(_docs(s, d)),
        "op9_media": lambda s, d: media.fingerprint_audio(media.sonify(_docs(s, d)), "doc_id", "wav"),
        "op10_secret_scan": lambda s, d: secrets.scan_secrets(_docs(s, d)),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {
        "op2_quality_rules": quality.KEEP_SQL,
        "op4_mixing": mixing.MIX_SQL,
        "op8_sharding": sharding.SHARDS_SQL,
        "op10_secret_scan": secrets.SCAN_SQL,
    }
