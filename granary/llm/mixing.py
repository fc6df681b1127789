"""Mixing sources to target weights by Pareto order sampling of fixed size.

Each source gets a whole number of output rows from its target weight. Within a source a document expects copies in
proportion to its size, a whole number; the whole part of that is certain, and the rest is an inclusion chance. The
documents are ranked by random odds divided by inclusion odds, and the lowest ranks get one more copy, exactly as many
as are still missing. All arithmetic before the ranks is in whole numbers, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.tables import written

from .common import cut_lineage, hash_unit, join_small, need

#: Target weights of sources; a source that is not named has weight 1, one of weight 0 gets no rows.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}
SEED = "mix-1"
#: Steps into which the ranks between two bounds are counted.
BUCKETS = 4096


def allocate(sizes: DataFrame, weights: dict[str, int], total: int | None) -> DataFrame:
    """(source, rows): ``total`` (all eligible documents where None) split by weight, by largest remainders; ties by name."""
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    w = F.coalesce(given[F.col("source")], F.lit(1)) if weights else F.lit(1)
    one = Window.partitionBy(F.lit(0))
    t = sizes.withColumn("w", w.cast("long")).where("w > 0").withColumn("all_w", F.sum("w").over(one))
    t = t.withColumn("total", F.sum("docs").over(one) if total is None else F.lit(total).cast("long"))
    t = t.withColumn("base", F.expr("(total * w) div all_w")).withColumn("rest", F.expr("(total * w) % all_w"))
    rank = F.row_number().over(one.orderBy(F.desc("rest"), "source"))
    t = t.withColumn("short", F.col("total") - F.sum("base").over(one)).withColumn("rank", rank)
    return t.select("source", "size", (F.col("base") + (F.col("rank") <= F.col("short")).cast("long")).alias("rows"))


def mix(df: DataFrame, weights: dict[str, int] | None = None, total: int | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as many times as it is taken (0, 1 or more), with the columns of ``df``.

    A document's size is the number of binary digits of its length, so a text of twice the length expects one step
    more. Null and empty texts, and null keys, are not eligible. A null source counts as ''. Repeated rows count as so
    many documents; their random numbers, made of key and text, are equal, so they stand next to each other in rank. Ties of
    rank are of repeated rows, which are alike but for other columns: those whose columns sort first as JSON are taken first. An
    empty table, or weights that are all 0, gives no rows. Very long texts count by their whole length. Other columns pass
    through, whatever their names.

    The text itself is not shuffled: the rank at which a source's sample ends is found on narrow rows (``_ends``), and
    each document is decided by comparing its own rank with that. Only rows that tie with it are gathered, by counts.
    """
    need(df, key, source, text)
    weights = WEIGHTS if weights is None else weights
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(source, F.lit("")).alias("source"), F.length(text).alias("chars"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.where("key IS NOT NULL AND chars > 0").withColumn("size", F.length(F.bin("chars")).cast("long"))
    rows = rows.withColumn("u", hash_unit(F.concat_ws(":", F.col("key").cast("string"), F.md5("text")), seed)).drop("key", "text", "chars")
    sizes = written(rows.select("source", "size", "u"))
    plan = allocate(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size")), weights, total)
    plan = cut_lineage(plan.withColumnRenamed("size", "all_size"))
    ranked = _ranked(rows, cut_lineage(plan.join(_ends(_ranked(sizes, plan).where("rest > 0")), "source", "left")))
    more = F.coalesce((F.col("q") < F.col("end")).cast("long"), F.lit(0))
    ties = F.coalesce(F.col("q") == F.col("end"), F.lit(False))
    fixed = ranked.where(~ties).select("row", (F.col("sure") + more).alias("copies"))
    tied = ranked.where(ties).groupBy("source", "row", "sure", "at_end").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy(F.to_json("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    tied = tied.withColumn("copies", F.col("sure") * F.col("n") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("at_end") - before))).select("row", "copies")
    taken = fixed.unionByName(tied).where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return taken.select("row.*")


def _ranked(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with sure copies, the rest as a share of all_size, and the Pareto rank q of the rest."""
    t = join_small(docs, plan, ["source"]).withColumn("sure", F.expr("(rows * size) div all_size")).withColumn("rest", F.expr("(rows * size) % all_size"))
    u, p = F.col("u"), F.col("rest") / F.col("all_size")
    return t.withColumn("q", F.when(F.col("rest") > 0, (u / (1 - u)) * ((1 - p) / p)))


def _ends(ranked: DataFrame) -> DataFrame:
    """(source, end, at_end): the rank of the last document that each source still takes, and how many with exactly that rank it takes.

    The ranks of a source between two bounds are counted in BUCKETS even steps, the step in which the sample ends gives the next
    bounds, and so on until it holds one rank. A round reads narrow rows and shuffles counts; their number hardly grows with the
    rows, as each cuts the step to one of BUCKETS.
    """
    state = ranked.groupBy("source").agg(F.expr("sum(rest) div max(all_size)").alias("wanted"), F.min(F.log("q")).alias("lo"), F.max(F.log("q")).alias("hi"), F.min("q").alias("q_lo"), F.max("q").alias("q_hi"))
    state = cut_lineage(state.where("wanted > 0"))
    while state.where("q_lo < q_hi").limit(1).count():
        open_ = state.where("q_lo < q_hi")
        inside = join_small(ranked.select("source", "q"), open_, ["source"]).where("q BETWEEN q_lo AND q_hi")
        step = F.expr(f"int(least({BUCKETS - 1}, floor((ln(q) - lo) / (hi - lo) * {BUCKETS})))")
        # Bounds that logarithms can't tell apart any more are cut by the ranks themselves.
        plain = F.expr(f"int(least({BUCKETS - 1}, floor((q - q_lo) / (q_hi - q_lo) * {BUCKETS})))")
        counts = inside.withColumn("step", F.when(F.col("hi") > F.col("lo"), step).otherwise(plain)).groupBy("source", "wanted", "step").agg(F.count("*").alias("n"), F.min("q").alias("q_lo"), F.max("q").alias("q_hi"))
        to = F.sum("n").over(Window.partitionBy("source").orderBy("step"))
        found = counts.withColumn("to", to).where("to >= wanted AND to - n < wanted")
        found = found.select("source", (F.col("wanted") - (F.col("to") - F.col("n"))).alias("wanted"), F.log("q_lo").alias("lo"), F.log("q_hi").alias("hi"), "q_lo", "q_hi")
        state = cut_lineage(state.where("q_lo >= q_hi").unionByName(found))
    return state.select("source", F.col("q_lo").alias("end"), F.col("wanted").alias("at_end"))


_W = "CASE ks " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END"
MIX_SQL = f"""WITH d AS (
  SELECT *, coalesce(source, '') AS ks, length(bin(length(text))) AS size FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0
), s AS (SELECT ks, count(*) AS docs, sum(size)::BIGINT AS all_size, {_W} AS w FROM d GROUP BY ks),
a AS (SELECT *, (sum(docs) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w FROM s WHERE w > 0),
b AS (SELECT *, (total * w) // all_w AS base, row_number() OVER (ORDER BY (total * w) % all_w DESC, ks) AS rank FROM a),
plan AS (SELECT ks, all_size, base + (rank <= total - (sum(base) OVER ())::BIGINT)::INT AS rows_ FROM b),
r AS (
  SELECT d.*, all_size, (rows_ * size) // all_size AS sure, (rows_ * size) % all_size AS rest,
    (('0x' || substr(md5('{SEED}:' || doc_id || ':' || md5(text)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN plan USING (ks)
), o AS (
  SELECT *, (sum(rest) OVER (PARTITION BY ks))::BIGINT // all_size AS wanted,
    row_number() OVER (PARTITION BY ks ORDER BY rest = 0, (u / (1 - u)) * ((1 - rest::DOUBLE / all_size) / (CASE WHEN rest > 0 THEN rest::DOUBLE / all_size END)), doc_id, text) AS rank
  FROM r
)
SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, unnest(range(sure + (rest > 0 AND rank <= wanted)::INT)) FROM o)"""
