"""Sharding along a Hilbert curve, so that every shard covers a small box of several metadata dimensions.

Four dimensions (language, source, length, position of the key) are cut into 32 steps each. A cell's index on the curve
is computed once a cell. Documents are ordered by index and key, and a shard is a run of them of about
``shard_chars`` characters: a filter on any of the dimensions then skips most files by their column ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from granary.sources.tables import written

from .common import cut_lineage, fresh, join_small, need

BITS, DIMS = 5, 4
SHARD_CHARS = 128 << 20
_X = [f"x{i}" for i in range(DIMS)]


_INDEX = " + ".join(f"((x{i} & {1 << b}) {{div}} {1 << b}) * {1 << (b * DIMS + DIMS - 1 - i)}" for b in range(BITS) for i in range(DIMS))


def hilbert_numbers(axes: np.ndarray) -> np.ndarray:
    """The curve index of each row of whole numbers 0..31 in ``axes`` (rows x DIMS), by Skilling's transform."""
    x = [axes[:, i].astype(np.int64) for i in range(DIMS)]
    for bit in range(BITS - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(DIMS):
            high, swap = (x[i] & q) != 0, (x[0] ^ x[i]) & p
            first = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, DIMS):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(BITS - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    out = np.zeros_like(flip)
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            out = out << 1 | ((x[i] ^ flip) >> b) & 1
    return out


@F.pandas_udf(LongType())
def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_numbers(np.stack([a, b, c, d], axis=1)))


def _codes(df: DataFrame, name: str, out: str, axis: str) -> DataFrame:
    """(out, axis): each name of a column with its place among all distinct names, scaled to 0..31; null sorts first."""
    names = df.select(F.col(name).alias(out)).distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(out).asc_nulls_first())) - 1
    return names.withColumn("_p", place).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).select(out, F.expr(f"int((_p * {1 << BITS}) div _n)").alias(axis))


def shards(df: DataFrame, shard_chars: int = SHARD_CHARS, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` with columns hilbert (index on the curve), shard (run number) and before (characters before it in curve order).

    The key must be a whole number of any size. Null languages and sources are names of their own and sort first; a null
    key has position 0, a null or empty text length 0. Ties in the index are ordered by key (nulls first), then by the MD5 of the
    text; repeated rows (equal key and text in one cell) stand at one place and have the same ``before``, that of the first. A document
    longer than a shard is not cut: it lies in the shard in which it begins. Where ``df`` already has a column of these names,
    the new one gets underscores. An empty table gives an empty one.

    The running sum is taken over narrow rows without text, cut into ranges of even size, so that neither a crowded cell
    nor one key is a task's whole work.
    """
    need(df, key, lang, source, text)
    if shard_chars < 1:
        raise ValueError("shard_chars must be positive")
    names = []
    for n in ("hilbert", "shard", "before"):
        names.append(fresh(df, n))
    span = df.agg(F.min(key).cast("decimal(20,0)").alias("lo"), F.max(key).cast("decimal(20,0)").alias("hi"))
    place = f"coalesce(int(((cast(key AS decimal(20,0)) - lo) * {1 << BITS}) div (hi - lo + 1)), 0)"
    t = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.col(lang).alias("l"), F.col(source).alias("s"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.md5(text).alias("tie"))
    lc, sc = _codes(df, lang, "lk", "x0"), _codes(df, source, "sk", "x1")
    t = join_small(join_small(t, lc, F.col("l").eqNullSafe(F.col("lk"))), sc, F.col("s").eqNullSafe(F.col("sk"))).crossJoin(F.broadcast(span))  # span is one row
    t = t.selectExpr("row", "key", "tie", "chars", "x0", "x1", f"least(length(bin(chars)), {(1 << BITS) - 1}) AS x2", f"{place} AS x3")
    # Python sees each cell once; there are at most 2^20, however many documents.
    cells = cut_lineage(t.select(*_X).distinct().withColumn("h", _hilbert(*_X)))
    t = join_small(t, cells, _X)
    order = [F.col("h"), F.col("key").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    places = t.groupBy("h", "key", "tie").agg(F.sum("chars").cast("decimal(38,0)").alias("chars"))
    # Which range a row falls in depends on a sample, so it is written down.
    places = written(places.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = places.groupBy("part").agg(F.sum("chars").alias("all"))
    parts = parts.withColumn("start", F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("all"))
    within = F.sum("chars").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")
    places = join_small(places.withColumn("within", within), parts.select("part", "start"), ["part"]).select(F.col("h").alias("ph"), F.col("key").alias("pk"), F.col("tie").alias("pt"), (F.col("start") + F.col("within")).cast("long").alias("b"))
    t = t.join(places, F.col("h").eqNullSafe(F.col("ph")) & F.col("key").eqNullSafe(F.col("pk")) & F.col("tie").eqNullSafe(F.col("pt")))
    return t.select("row.*", F.col("h").alias(names[0]), F.expr(f"b div {shard_chars}").alias(names[1]), F.col("b").alias(names[2]))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", hilbert: str = "hilbert", most_rows: int = 1_000_000) -> None:
    """A folder a shard under ``path``, its rows in curve order, in files of at most ``most_rows`` rows.

    Null shards (there are none in a table that ``shards`` made) go to a folder of their own. Repeated rows, nulls in other columns and very
    long texts are written as they are, ties of the index in any order. An empty table writes no shard. ``path`` must be new.
    """
    sharded.repartition(F.col(shard)).sortWithinPartitions(shard, hilbert).write.option("maxRecordsPerFile", most_rows).partitionBy(shard).parquet(path)


def _curve_steps(xor: str) -> list[dict[str, str]]:
    """Successive projections that turn the axes x0.. into the transposed Hilbert index; ``xor`` formats an exclusive or."""
    x = lambda a, b: xor.format(a=a, b=b)
    steps = []
    for bit in range(BITS - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(DIMS):
            swap = f"({x('x0', _X[i])} & {p})"
            steps.append({"x0": f"CASE WHEN (x{i} & {q}) <> 0 THEN {x('x0', p)} ELSE {x('x0', swap)} END"} | ({_X[i]: f"CASE WHEN (x{i} & {q}) <> 0 THEN x{i} ELSE {x(_X[i], swap)} END"} if i else {}))
    for i in range(1, DIMS):
        steps.append({_X[i]: x(_X[i], _X[i - 1])})
    flip = "0"
    for bit in range(BITS - 1, 0, -1):
        q = 1 << bit
        flip = x(flip, f"(CASE WHEN (x{DIMS - 1} & {q}) <> 0 THEN {q - 1} ELSE 0 END)")
    steps.append({"flip": flip})
    steps.append({a: x(a, "flip") for a in _X})
    return steps


def _sql() -> str:
    inner = f"""SELECT d.*, coalesce(length(text), 0) AS chars, x0, x1, least(length(bin(coalesce(length(text), 0))), {(1 << BITS) - 1}) AS x2,
    coalesce((((doc_id::HUGEINT - lo) * {1 << BITS}) // (hi - lo + 1))::INT, 0) AS x3, 0 AS flip
  FROM documents d JOIN (SELECT lang AS lk, ((row_number() OVER (ORDER BY lang NULLS FIRST) - 1) * {1 << BITS}) // count(*) OVER () AS x0 FROM (SELECT DISTINCT lang FROM documents)) ON lang IS NOT DISTINCT FROM lk
  JOIN (SELECT source AS sk, ((row_number() OVER (ORDER BY source NULLS FIRST) - 1) * {1 << BITS}) // count(*) OVER () AS x1 FROM (SELECT DISTINCT source FROM documents)) ON source IS NOT DISTINCT FROM sk
  CROSS JOIN (SELECT min(doc_id)::HUGEINT AS lo, max(doc_id)::HUGEINT AS hi FROM documents)"""
    for step in _curve_steps("xor({a}, {b})"):
        inner = "SELECT * REPLACE (" + ", ".join(f"{e} AS {a}" for a, e in step.items()) + f") FROM ({inner})"
    return f"""WITH c AS (SELECT *, {_INDEX.format(div='//')} AS hilbert FROM ({inner})),
o AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY hilbert, doc_id NULLS FIRST, md5(text) NULLS FIRST GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
SELECT doc_id, text, lang, source, n_chars, hilbert::BIGINT AS hilbert, before // {SHARD_CHARS} AS shard, before FROM o"""


SHARDS_SQL = _sql()
