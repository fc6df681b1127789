"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; where its top bits are zero, a chunk may end. As the hash looks only at the last 16
bytes, a passage gets the same cuts wherever it stands, whatever was inserted before it. Each chunk is known by a 128-bit
digest. The first place of a digest (lowest key, then lowest offset) keeps its chunk; every other place repeats it.
What a passage has before its first cut and after its last one lies in chunks with other text and is not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix64, need, span_hashes, text_bytes, text_slices

#: Least and most bytes of a chunk; a cut is due at one in 2^CUT_BITS places.
LEAST, MOST, CUT_BITS = 24, 512, 5
#: Repeats are reported from this many bytes in a row: some 16 words, more than the lines that unrelated texts share.
MIN_SPAN = 96
with np.errstate(over="ignore"):
    GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x2545F4914F6CDD1D)) >> U64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR[byte] << age over the last 16 bytes, built by doubling."""
    h = GEAR[data]
    for j in range(4):
        step = 1 << j
        older = np.zeros_like(h)
        older[step:] = h[:-step] << step
        h = h + older
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, chunks before each row): greedy cuts of each row at the places that the hash allows, between characters."""
    starts_char = np.append((data & 0xC0) != 0x80, True)
    may = np.flatnonzero((gear_hashes(data) >> (16 - CUT_BITS) == 0) & starts_char[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    between = np.searchsorted(may, offsets)
    may, ends, counts = may.tolist(), [], [0]
    for row in range(len(offsets) - 1):
        last, end = int(offsets[row]), int(offsets[row + 1])
        for c in [*may[between[row] : between[row + 1]], end]:
            if c - last < LEAST and c != end:
                continue
            while c - last > MOST:
                last += MOST
                while not starts_char[last]:
                    last -= 1
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c
        counts.append(len(ends))
    return np.array(ends, np.int64), np.array(counts, np.int64)


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, size, hi, lo) of every chunk of every text: its first byte, number of bytes, and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in text_slices(b.column(1)):
                data, offsets = text_bytes(part)
                ends, counts = chunk_ends(data, offsets)
                starts = np.empty_like(ends)
                starts[1:] = ends[:-1]
                per = np.diff(counts)
                starts[counts[:-1][per > 0]] = offsets[:-1][per > 0]
                row = np.repeat(np.arange(len(part)), per)
                digest = [span_hashes(data, starts, ends, lane).view(np.int64) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)).take(pa.array(row)), pa.array((starts - offsets[row]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *map(pa.array, digest)], ["doc_id", "start", "size", "hi", "lo"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"doc_id {kind}, start int, size int, hi bigint, lo bigint")


def repeats(df: DataFrame, min_span: int = MIN_SPAN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, chunks, kept_in): maximal runs of repeated chunks of at least ``min_span`` bytes.

    start and end are byte offsets in the UTF-8 text; kept_in lists the documents that hold the first places of the
    run's chunks. Within one document a later repeat counts too. Null, empty and blank texts have no repeats; rows with a
    null key are left out, as nothing can refer to them. Rows that share a key are one document: equal chunks at equal
    offsets are one place. Texts are chunked whole. An empty table gives no rows; other columns are ignored.
    """
    need(df, key, text)
    places = chunks(df.where(F.col(key).isNotNull()), key, text)
    first = places.groupBy("hi", "lo").agg(F.count("*").alias("places"), F.min(F.struct("doc_id", "start")).alias("first")).where("places > 1").select("hi", "lo", "first")
    again = places.join(first, ["hi", "lo"]).where("doc_id <> first.doc_id OR start <> first.start")
    again = again.groupBy("doc_id", "start").agg(F.max("size").alias("size"), F.min("first.doc_id").alias("kept"))
    by = Window.partitionBy("doc_id").orderBy("start")
    end = F.col("start") + F.col("size")
    again = again.withColumn("end", end).withColumn("new", (F.coalesce(F.lag(end).over(by), F.lit(-1)) != F.col("start")).cast("int"))
    again = again.withColumn("run", F.sum("new").over(by))
    runs = again.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("chunks"), F.sort_array(F.collect_set("kept")).alias("kept_in"))
    return runs.where(F.col("end") - F.col("start") >= min_span).select("doc_id", "start", "end", "chunks", "kept_in")


def cut_repeats(df: DataFrame, min_span: int = MIN_SPAN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``df``, with its columns, and the repeats cut out of their texts.

    Rows that share a key are told apart by a hash of their texts; of texts under one key that of the lower hash counts as
    first. Repeated rows (equal key and text) are one document and stay alike. Null keys, and null, empty and blank texts, stay
    as they are. Very long texts are cut whole. An empty table gives an empty one; other columns pass through, whatever their names.
    """
    need(df, key, text)
    unit = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")))
    spans = repeats(df.select(unit.alias("unit"), F.col(text).alias("text")), min_span, "unit", "text")
    spans = spans.groupBy(F.col("doc_id").alias("_r_unit")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r_spans"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r_row"), unit.alias("_r_unit"))
    joined = row.join(spans, "_r_unit", "left").select(*[F.col("_r_row")[c].alias(f"c{i}") for i, c in enumerate(df.columns)], "_r_spans")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            cut = np.flatnonzero(np.asarray(b.column(b.num_columns - 1).is_valid()))
            if len(cut):
                values = texts.to_pylist()
                for i in cut.tolist():
                    raw, kept, last = values[i].encode(), [], 0
                    for s in b.column(b.num_columns - 1)[i].as_py():
                        kept.append(raw[last : s["start"]])
                        last = s["end"]
                    values[i] = b"".join([*kept, raw[last:]]).decode()
                texts = pa.array(values, texts.type)
            columns = b.columns[:-1]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return joined.mapInArrow(run, joined.drop("_r_spans").schema).toDF(*df.columns)
