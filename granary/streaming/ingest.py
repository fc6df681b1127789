"""Memories as a stream: each micro-batch is numbered after the last one and appended as observations, or added to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from granary.memory import Memory
from granary.operators.ingest import number_memories


def append_memories(stream: DataFrame, path: str, checkpoint: str, bucket: str, order: list[str]) -> StreamingQuery:
    """Write every arriving row, numbered, to the folder of its batch under ``path``.

    A batch's folder is overwritten if the batch is run again, and numbers go on from the batches before it: a
    restart gives the same rows as a run without failures. How far each batch came is a row of its own under
    ``path`` + '-ends', so a batch reads no earlier rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = 0
        try:
            start = spark.read.schema("memory_index bigint, batch int").parquet(f"{path}-ends").where(F.col("batch") < number).agg(F.max("memory_index")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        out = number_memories(batch, F.expr(bucket), order, start)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        end = spark.read.parquet(f"{path}/batch={number}").agg(F.coalesce(F.max("memory_index"), F.lit(start).cast("long")).alias("memory_index"))
        end.coalesce(1).write.mode("overwrite").parquet(f"{path}-ends/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(stream: DataFrame, memory: Memory, checkpoint: str, order: list, bucket: Column | None = None) -> StreamingQuery:
    """Add every micro-batch of a stream of memories to the graph of ``memory``: parse, entities, nodes, edges and vectors. A batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        memory.ingest(batch, order, bucket, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
