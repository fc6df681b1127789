"""Named queries and the SQL that gives the same rows.

The tables have no parsed memories, so each operator runs over the table that has its shape: lineitem as mentions (an
order mentions parts), events as observed preferences, embeddings as granules, conversations as memories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import Config, audit
from granary.functions import ids, parse
from granary.functions.text import STOP, sentences
from granary.operators import canonical, derived, diagnostics, graph, ingest, recall, traverse, vectors
from granary.sources.tables import read_table as table
from granary.sources.tables import scratch, written

c = F.col


def _text(name: str) -> F.Column:
    return c(name).cast("string")


# Memories, sentences, n-grams.


def memories(spark: SparkSession, d: str) -> DataFrame:
    order = [c("conv_id").asc_nulls_first(), c("turn").asc_nulls_first(), "role", "text"]
    return ingest.number_memories(table(spark, d, "conversations"), F.expr("conv_id div 1024"), order)


def memory_append(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("conv_id", "turn", "memory_index", "memory_id", "turn_id")


def granule_part_of(spark: SparkSession, d: str) -> DataFrame:
    t = memories(spark, d).select("turn_id", F.posexplode(sentences("text")).alias("segment_index", "text"))
    return t.select(ids.segment_id(c("turn_id"), c("segment_index")).alias("segment_id"), "turn_id", "segment_index", "text")


def token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(STOP))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    t = granule_part_of(spark, d).select("segment_id", words.alias("w")).select("segment_id", F.explode(pairs).alias("text"))
    return t.groupBy("segment_id", "text").agg(F.count("*").alias("n"))


def synthetic_graph(spark: SparkSession, d: str, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the conversations as memories, read by the rule parser; entities by equal or similar form, as the settings say."""
    m = memories(spark, d).select("memory_index", "memory_id", "turn_id", c("text").alias("content"), F.concat(F.lit("2026-01-01T00:00:00+00:"), F.lpad((c("turn") % 60).cast("string"), 2, "0")).alias("timestamp"), c("role").alias("speaker"), F.concat(F.lit("conversation "), _text("conv_id")).alias("source"), F.array(F.struct(F.lit("turn").alias("k"), _text("turn").alias("v"))).alias("metadata"))
    n, e = ingest.ingest(ingest.parse_memories(m, config), config)
    return written(graph.upsert_nodes(n, list(ingest.PAYLOADS))), written(graph.upsert_edges(e))


def ingest_coverage(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.coverage(*synthetic_graph(spark, d))


def ingest_derived(spark: SparkSession, d: str) -> DataFrame:
    """(index, row): the five derived indexes of the graph, each row as JSON."""
    out = None
    for name, df in derived.rebuild(*synthetic_graph(spark, d)).items():
        t = df.select(F.lit(name).alias("index"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = t if out is None else out.unionByName(t)
    return out


def _recalled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every turn of the conversations as a query, its intent by the nearest centroid; the graph is written first, as every step reads it again."""
    from granary.sources import store

    config = Config()
    n, e = synthetic_graph(spark, d, config)
    path = scratch(spark, "graph")
    store.save(path, n, e, config)
    g = store.load(spark, path, config)
    granules = ingest.embed_granules(g["nodes"], dimension=config.dimension)
    granules.write.parquet(f"{path}/granules")
    granules = spark.read.parquet(f"{path}/granules")
    turns = g["nodes"].where("turn IS NOT NULL").select(c("id").alias("query_id"), "turn.text", F.lit(None).cast("string").alias("hint"))
    queries = turns.join(granules.select(c("node_id").alias("query_id"), "vec"), "query_id")
    said = g["edges"].where("type = 'mentions'").join(g["nodes"].select(c("id").alias("dst"), c("entity.entity_type").alias("kind")), "dst").select(c("src").alias("query_id"), c("surface_form").alias("surface"), "kind")
    return recall.recall(queries, g["nodes"], g["edges"], granules, derived.rebuild(g["nodes"], g["edges"]), said, config, written(recall.intent_centroids(spark, dimension=config.dimension)))


def recall_passages(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d)[0]


def recall_facts(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d)[1]


# A graph whose parse SQL can give too: names are words with a capital, n-grams the first two words of a sentence, and a memory claims
# that its first two names are near each other and that its speaker likes its first word.

LITERAL = Config(match_threshold=None, dimension=3)


def literal_parse(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d).select("memory_index", "memory_id", "turn_id", c("text").alias("content"), F.concat(F.lit("2026-01-01T"), F.lpad((c("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00Z")).alias("timestamp"), c("role").alias("speaker"), F.lit("conversations").alias("source"), F.array().cast("array<struct<k:string,v:string>>").alias("metadata"))
    none, zero = F.array(), F.lit(0)
    m = m.withColumn("s", F.explode(F.array(F.coalesce(sentences("content"), none.cast("array<string>"))))).withColumn("n", F.coalesce(F.regexp_extract_all("content", F.lit("([A-Z][a-z]{2,})"), F.lit(1)), none.cast("array<string>")))
    m = m.withColumn("first", F.lower(F.regexp_extract(F.coalesce("content", F.lit("")), "[A-Za-z]+", 0)))
    segments = F.transform("s", lambda x, i: F.struct(i.alias("index"), x.alias("text"), zero.alias("start"), zero.alias("end")))
    words = F.transform("s", lambda x, i: F.struct(i.alias("i"), F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), F.lit(1)).alias("w")))
    pair = lambda x: F.concat(F.get(x["w"], zero), F.lit(" "), F.get(x["w"], F.lit(1)))
    grams = F.transform(F.filter(words, lambda x: F.size(x["w"]) > 1), lambda x: F.struct(x["i"].alias("segment"), F.lit("noun_chunk").alias("kind"), pair(x).alias("text"), pair(x).alias("surface"), zero.alias("start"), zero.alias("end")))
    names = F.transform("n", lambda x: F.struct(x.alias("surface"), F.lit("NAME").alias("kind"), zero.alias("start"), zero.alias("end")))
    claim = lambda speaker, subject, object_, literal, predicate: F.struct(zero.alias("segment"), F.lit(speaker).alias("speaker"), F.lit(subject).cast("int").alias("subject"), F.lit(object_).cast("int").alias("object"), literal.alias("literal"), F.lit(predicate).alias("predicate"), F.lit("asserted").alias("modality"), F.lit("present").alias("tense"))
    near = F.when(F.size("n") > 1, claim(False, 0, 1, F.lit(None).cast("string"), "near"))
    likes = F.when(c("first") != "", claim(True, None, None, c("first"), "like"))
    return m.withColumn("segments", segments).withColumn("grams", grams).withColumn("mentions", names).withColumn("claims", F.array_compact(F.array(near, likes))).drop("s", "n", "first")


def literal_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = ingest.ingest(literal_parse(spark, d), LITERAL)
    return written(graph.upsert_nodes(n, list(ingest.PAYLOADS))), written(graph.upsert_edges(e))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = literal_graph(spark, d)
    value = F.coalesce("memory.content", "turn.text", "utterance_segment.text", "ngram.normalized_text", "entity.canonical_form", "claim.predicate", "preference.target_literal", "time_anchor.iso_timestamp")
    return nodes.select("id", F.array_join("labels", ",").alias("label"), F.array_join("layers", ",").alias("layer"), value.alias("value"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return literal_graph(spark, d)[1].select("src", "dst", "type", "weight", "surface_form", "source_memory_id", "asserted_at")


def graph_coverage(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.coverage(*literal_graph(spark, d))


def graph_derived(spark: SparkSession, d: str) -> DataFrame:
    """(index, a, b, value): the five derived indexes of the graph."""
    index = derived.rebuild(*literal_graph(spark, d))
    text = lambda *names: F.concat_ws("|", *[F.coalesce(c(n).cast("string"), F.lit("")) for n in names])
    shapes = {
        "aliases": ("entity_id", F.lit(""), F.array_join("aliases", "|")),
        "co_occurrence": ("entity_a", c("entity_b"), text("count")),
        "reinforcement": ("node_id", c("kind"), text("count", "earliest", "latest")),
        "current_preference": ("holder_id", c("target_key"), text("polarity", "preference_id", "asserted_at")),
        "time_anchor_chain": ("time_anchor_id", c("iso_timestamp"), text("prev_id", "next_id")),
    }
    out = None
    for name, (first, second, value) in shapes.items():
        t = index[name].select(F.lit(name).alias("index"), c(first).alias("a"), second.alias("b"), value.alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def _literal_recall(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every turn is a query that names what it mentions, the intents in turn; a text's vector is made of its length."""
    nodes, edges = literal_graph(spark, d)
    vec = lambda t: F.array((F.length(t) % 7).cast("float"), (F.length(t) % 11).cast("float"), F.lit(1.0).cast("float"))
    kind = F.when(c("turn").isNotNull(), "turn").when(c("utterance_segment").isNotNull(), "sentence").when(c("ngram").isNotNull(), "ngram")
    granules = nodes.select(c("id").alias("node_id"), kind.alias("granularity"), vec(F.coalesce("turn.text", "utterance_segment.text", "ngram.normalized_text")).alias("vec")).where("granularity IS NOT NULL")
    order = F.array(*[F.lit(i) for i in recall.INTENTS])
    queries = nodes.where("turn IS NOT NULL").join(nodes.where("memory IS NOT NULL").select(c("id").alias("m"), "memory.memory_index"), c("turn.memory_id") == c("m"))
    queries = queries.select(c("id").alias("query_id"), "turn.text", vec(c("turn.text")).alias("vec"), F.element_at(order, (c("memory_index") % len(recall.INTENTS) + 1).cast("int")).alias("hint"))
    said = edges.where("type = 'mentions'").select(c("src").alias("query_id"), c("surface_form").alias("surface"), F.lit("NAME").alias("kind"))
    return recall.recall(queries, nodes, edges, granules, derived.rebuild(nodes, edges), said, LITERAL)


def graph_passages(spark: SparkSession, d: str) -> DataFrame:
    t = _literal_recall(spark, d)[0]
    return t.select("query_id", "rank", "id", "granularity", F.round("score", 6).alias("score"), "source_memory_id", "source_memory_index", "timestamp", "speaker", F.array_join("supporting_edges", ";").alias("supporting_edges"))


def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    t = _literal_recall(spark, d)[1]
    return t.select("query_id", "rank", "kind", "subject", "predicate", "object", "value", "timestamp", F.array_join("supporting_memory_ids", ",").alias("memories"))


def failure_classes_graph(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as answers that recall missed, against the entities of the graph and the pairs that meet in a memory."""
    nodes, edges = literal_graph(spark, d)
    none = F.array().cast("array<string>")
    cases = table(spark, d, "benchmark").where("item_id IS NOT NULL").select(_text("item_id").alias("question_id"), c("text").alias("gold"), none.alias("passages"), none.alias("facts"), F.lit(False).alias("judged_correct"), F.lit("benchmark").alias("bucket"))
    names = nodes.where("entity IS NOT NULL").select("id", c("entity.canonical_form").alias("text"))
    pairs_ = derived.rebuild(nodes, edges)["co_occurrence"].select(c("entity_a").alias("src"), c("entity_b").alias("dst"))
    return diagnostics.classify_failures(cases, names, pairs_).select("question_id", "kind", F.round("node_recall", 6).alias("node_recall"))


# Graph writes and derived indexes.


def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").select(F.concat(F.lit("o:"), _text("l_orderkey")).alias("src"), F.concat(F.lit("p:"), _text("l_partkey")).alias("dst"), F.lit("mentions").alias("type"), c("l_quantity").alias("weight"), _text("l_suppkey").alias("surface_form"), F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("seq"))
    return graph.upsert_edges(seen, ["weight", "surface_form"])


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    a = table(spark, d, "customer").select(F.concat(F.lit("n:"), _text("c_nationkey")).alias("id"), F.array("c_mktsegment").alias("labels"), none.alias("layers"), F.struct(c("c_name").alias("name")).alias("p"), c("c_custkey").cast("long").alias("seq"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("n:"), _text("s_nationkey")).alias("id"), F.array(F.lit("SUPPLIER")).alias("labels"), F.array(F.lit("supply")).alias("layers"), F.lit(None).cast("struct<name:string>").alias("p"), (c("s_suppkey") + 10**9).cast("long").alias("seq"))
    t = graph.upsert_nodes(a.unionByName(b), ["p"])
    return t.select("id", F.array_join("labels", ",").alias("labels"), F.array_join("layers", ",").alias("layers"), c("p.name").alias("name"))


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    t = derived.aliases(table(spark, d, "part"), "p_brand", "p_type")
    return t.select("entity_id", F.array_join("aliases", "|").alias("aliases"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return derived.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).withColumn("weight", F.round("weight", 6))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.concat(_text("user_id"), F.lit(":"), c("event_type")).alias("node"), at.alias("at"), F.concat(F.lit("literal:"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("target"))


def reinforcement(spark: SparkSession, d: str) -> DataFrame:
    return derived.reinforcement(_observed(spark, d), "node", "event_type", "at")


def current_preference(spark: SparkSession, d: str) -> DataFrame:
    return derived.current_preference(_observed(spark, d), "user_id", "target", "event_type", "event_id", "at")


def change_events(spark: SparkSession, d: str) -> DataFrame:
    return derived.change_events(_observed(spark, d), "user_id", "target", "event_type", "event_id", "at")


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    from granary.functions.text import round_iso

    t = table(spark, d, "events").withColumn("iso", round_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "hour"))
    return t.withColumn("anchor", ids.anchor_id(c("iso")))


def time_anchor_chain(spark: SparkSession, d: str) -> DataFrame:
    return derived.time_anchor_chain(_anchored(spark, d).where("iso IS NOT NULL"), "anchor", "iso")


def temporal_at_fanin(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).where("iso IS NOT NULL").groupBy("anchor", "iso").agg(F.count("*").alias("n"))


# Vectors.


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", c("embedding").alias("vec"), "label")


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's 12 nearest others."""
    v = _vectors(spark, d)
    return vectors.knn(v, v, 12)


def knn_per_granularity(spark: SparkSession, d: str) -> DataFrame:
    """Labels as granularities with weights 1.0, 0.9, ... 0.1."""
    v = _vectors(spark, d).where("label IS NOT NULL")
    labels = v.select("label").distinct()
    found = vectors.knn(v, v.select("vec_id", "vec"), 12, same="label")
    weights = labels.select(c("label").cast("string").alias("granularity"), ((10 - c("label")) / 10).alias("weight"))
    t = vectors.per_granularity(found.withColumnRenamed("label", "granularity"), weights, 12)
    return t.withColumn("score", F.round("score", 9))


def centroid_classify(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vectors.classify(v, vectors.centroids(v, "label"), 0.05, "single_fact")


def discrimination_margin(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with an even id make the centroids, the others are held out."""
    v = _vectors(spark, d)
    return vectors.median_margins(v.where("vec_id % 2 = 1"), vectors.centroids(v.where("vec_id % 2 = 0"), "label"))


# Walks, passages, facts.


def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    lists = [li.select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("id"), c(x).alias("score")) for x in ("l_discount", "l_tax")]
    return traverse.merge_seeds(*lists, cap=64)


def _named(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix + ":"), _text(key))


def walk_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, src, dst, kind, weight in (
        ("orders", ("o", "o_orderkey"), ("c", "o_custkey"), "part_of", F.lit(1.0)),
        ("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "part_of", F.lit(1.0)),
        ("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "part_of", F.lit(1.0)),
        ("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "part_of", F.lit(1.0)),
        ("lineitem", ("o", "l_orderkey"), ("p", "l_partkey"), "mentions", 1.0 - c("l_discount")),
        ("lineitem", ("o", "l_orderkey"), ("s", "l_suppkey"), "asserts", 1.0 - c("l_tax")),
    ):
        parts.append(table(spark, d, name).select(_named(*src).alias("src"), _named(*dst).alias("dst"), F.lit(kind).alias("type"), weight.alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _walked(spark: SparkSession, d: str, frontier: int) -> DataFrame:
    """Every order as a query of its own."""
    start = table(spark, d, "orders").select(c("o_orderkey").alias("query_id"), _named("o", "o_orderkey").alias("id"), F.lit(1.0).alias("score"))
    return traverse.expand(start, walk_edges(spark, d), recall.EDGE_WEIGHTS["single_fact"], 3, frontier)


def bfs_expand(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d, 256).withColumn("score", F.round("score", 6))


def bfs_uncapped(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d, 0).withColumn("score", F.round("score", 6))


def _granules(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, prefix, key, text: table(spark, d, name).select(_named(prefix, key).alias("id"), F.lit(name).alias("label"), c(text).alias("text"))
    return of("customer", "c", "c_custkey", "c_name").unionByName(of("supplier", "s", "s_suppkey", "s_name")).unionByName(of("part", "p", "p_partkey", "p_name"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    scores = _walked(spark, d, 256).withColumn("score", F.round("score", 6))
    return recall.top_passages(scores, _granules(spark, d), 16, ["customer", "supplier", "part"])


def passage_topk(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


def passages_assembled(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "nation").select(_named("n", "n_nationkey").alias("id"), c("n_name").alias("text"))
    best = written(_passages(spark, d))
    edges = walk_edges(spark, d).where("type = 'part_of'")
    t = best.join(_granules(spark, d).select("id", "text"), "id", "left").join(recall.supports(best, edges, labels, ("part_of",)), "id", "left")
    return t.select("query_id", "rank", "id", "label", "text", "score", F.coalesce(F.array_join("supporting_edges", ";"), F.lit("")).alias("supporting_edges"))


def facts_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    seen = _observed(spark, d)
    index = derived.reinforcement(seen, "node", "event_type", "at")
    edges = seen.select(_named("u", "user_id").alias("src"), c("node").alias("dst"), F.lit("asserts").alias("type")).distinct()
    users = seen.where("user_id IS NOT NULL").select(c("user_id").alias("query_id"), _named("u", "user_id").alias("id")).distinct()
    claims = seen.select(c("node").alias("node_id"), _text("user_id").alias("subject"), F.lit("did").alias("predicate"), c("event_type").alias("object")).distinct()
    return recall.reinforcement_facts(users, edges, index, claims)


def facts_co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a query that names itself."""
    part = table(spark, d, "part")
    named = part.select(c("p_partkey").alias("query_id"), c("p_partkey").alias("id"))
    return recall.co_occurrence_facts(named, pairs(spark, d), part.select(c("p_partkey").alias("id"), c("p_name").alias("text")))


# Diagnostics.


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    cust = table(spark, d, "customer").select(_named("c", "c_custkey").alias("id"), F.array(F.lit("customer"), "c_mktsegment").alias("labels"), none.alias("layers"))
    supp = table(spark, d, "supplier").select(_named("s", "s_suppkey").alias("id"), F.array(F.lit("supplier")).alias("labels"), F.array(F.lit("supply")).alias("layers"))
    return diagnostics.coverage(cust.unionByName(supp), walk_edges(spark, d))


def needle_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = diagnostics.needle_overlap(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    return t.select("item_id", "doc_id", F.array_join("found", " ").alias("found"), F.array_join("missed", " ").alias("missed"), F.round("recall", 6).alias("recall"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Each turn is what was expected, the turn before it was found, the turn after it is the fact."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, d, "conversations")
    return t.select(F.concat_ws("-", _text("conv_id"), _text("turn")).alias("question_id"), c("text").alias("gold"), F.array(F.coalesce(F.lag("text").over(w), F.lit(""))).alias("passages"), F.array(F.coalesce(F.lead("text").over(w), F.lit(""))).alias("facts"), (c("role") == "system").alias("judged_correct"), c("role").alias("bucket"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    t = diagnostics.classify_failures(_cases(spark, d))
    return t.select("question_id", "kind", F.round("passage_recall", 6).alias("passage_recall"), F.round("fact_recall", 6).alias("fact_recall"), "bucket")


def bucket_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.bucket_breakdown(diagnostics.classify_failures(_cases(spark, d)))


def graph_gap(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's parts: does no order hold two of them?"""
    hits = table(spark, d, "lineitem").select(c("l_suppkey").alias("case_id"), c("l_partkey").alias("id"))
    met = derived.meetings(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return diagnostics.graph_gaps(hits, met.select(c("entity_a").alias("src"), c("entity_b").alias("dst")))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The customers against a copy with a drift under the tolerance, one over it in a segment, and another name in a nation."""
    a = table(spark, d, "customer")
    b = a.withColumn("c_acctbal", c("c_acctbal") + F.when(c("c_mktsegment") == "BUILDING", 0.01).otherwise(1e-7)).withColumn("c_name", F.when(c("c_nationkey") == 3, F.lower("c_name")).otherwise(c("c_name")))
    return diagnostics.snapshot_diff(a, b, ["c_custkey"], ["c_name", "c_mktsegment"], ["c_acctbal"])


def config_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, Config(), Config(max_depth=2, min_tokens=1))


def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.profile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


# Entities.


def _mentions(spark: SparkSession, d: str, surface: str) -> DataFrame:
    return table(spark, d, "part").select(c(surface).alias("surface"), c("p_brand").alias("kind"), c("p_partkey").alias("seq"))


def entity_canonical_exact(spark: SparkSession, d: str) -> DataFrame:
    m = canonical.canonicalize(_mentions(spark, d, "p_type"))
    return m.select("seq", ids.entity_id(c("canonical"), c("kind")).alias("entity_id"), "canonical", "kind")


def entity_canonical_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalize(_mentions(spark, d, "p_type"), 0.6).select("seq", "kind", "form", "canonical")


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The conversations read as a stream; the numbered memories that it wrote."""
    from granary.streaming.ingest import append_memories

    path = scratch(spark, "stream")
    schema = table(spark, d, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    append_memories(stream, f"{path}/out", f"{path}/checkpoint", "conv_id div 1024", ["conv_id", "turn", "role", "text"]).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", "memory_index", "memory_id", "turn_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        memory_append, granule_part_of, token_ngrams, graph_nodes, graph_edges, graph_coverage, graph_derived, graph_passages, graph_facts, failure_classes_graph, ingest_coverage, ingest_derived, recall_passages, recall_facts, mention_edges, node_upsert, entity_aliases, co_occurrence, reinforcement, current_preference, change_events,
        time_anchor_chain, temporal_at_fanin, knn_topk, knn_per_granularity, centroid_classify, discrimination_margin, seed_merge, bfs_expand, bfs_uncapped, passage_topk, passages_assembled, facts_reinforcement, facts_co_occurrence,
        coverage_report, needle_overlap, failure_classes, bucket_breakdown, graph_gap, snapshot_diff, config_audit, profile_stats, entity_canonical_exact, entity_canonical_fuzzy, ingest_stream,
    )
}

# SQL.


def _id(json: str) -> str:
    return f"substr(sha256({json}), 1, 16)"


_MEM = f"""m AS (
  SELECT *, {_id("'{\"memory_index\":' || memory_index || ',\"type\":\"memory\"}'")} AS memory_id
  FROM (SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS memory_index FROM conversations)
), mt AS (SELECT *, {_id("'{\"memory_id\":\"' || memory_id || '\",\"type\":\"turn\"}'")} AS turn_id FROM m)"""
_SEG = _MEM + f""", s AS (
  SELECT turn_id, list_filter(list_transform(regexp_extract_all(text, '([^.!?]+[.!?]*)', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM mt
), s2 AS (SELECT turn_id, unnest(p) AS text, (unnest(range(len(p))))::INT AS segment_index FROM s),
seg AS (SELECT {_id("'{\"segment_index\":' || segment_index || ',\"turn_id\":\"' || turn_id || '\",\"type\":\"utterance_segment\"}'")} AS segment_id, turn_id, segment_index, text FROM s2)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_PAIRS = """d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
pr AS (SELECT a.l_partkey AS entity_a, b.l_partkey AS entity_b, count(*) AS count FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"""
_OBS = """ob AS (SELECT event_id, user_id, event_type, user_id || ':' || event_type AS node, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen, 'literal:' || coalesce(json_extract_string(props, '$.k'), '') AS target FROM events)"""
_ANCHOR = "an AS (SELECT iso, " + _id("'{\"iso_timestamp\":\"' || iso || '\",\"type\":\"time_anchor\"}'") + " AS anchor FROM (SELECT strftime(ts, '%Y-%m-%dT%H:00:00Z') AS iso FROM events WHERE ts IS NOT NULL))"
_COS = """ks AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)"""
_CENT = """ce AS (
  SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL) GROUP BY label
), sc AS (SELECT e.vec_id, e.label AS own, ce.label AS class, round(list_cosine_similarity(e.embedding::DOUBLE[], ce.centroid), 6) AS score FROM embeddings e CROSS JOIN ce)"""
_W = recall.EDGE_WEIGHTS["single_fact"]
_WALK = f"""e AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'part_of' AS type, 1.0::DOUBLE AS weight FROM orders UNION ALL
  SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'part_of', 1.0 FROM customer UNION ALL
  SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'part_of', 1.0 FROM supplier UNION ALL
  SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of', 1.0 FROM nation UNION ALL
  SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'mentions', 1.0::DOUBLE - l_discount FROM lineitem UNION ALL
  SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'asserts', 1.0::DOUBLE - l_tax FROM lineitem
), ew AS (SELECT src, dst, weight, (CASE type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _W.items())} END)::DOUBLE AS t FROM e)"""


def _layers(cap: int) -> str:
    out = _WALK + ", w0 AS (SELECT o_orderkey AS query_id, 'o:' || o_orderkey AS id, 1.0::DOUBLE AS score FROM orders)"
    for i in (1, 2, 3):
        keep = f"WHERE r <= {cap}" if cap else ""
        out += f""", w{i} AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
  SELECT query_id, dst AS id, max(score * weight * t) AS score FROM w{i - 1} JOIN ew ON src = id WHERE score * weight * t > 0 GROUP BY ALL)) {keep})"""
    return out + ", bfs AS (SELECT query_id, id, round(max(score), 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(4)) + ") GROUP BY ALL)"


_GRAN = """gr AS (SELECT 'c:' || c_custkey AS id, 'customer' AS label, c_name AS text FROM customer UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'part', p_name FROM part)"""
_PASS = _layers(256) + ", " + _GRAN + """, pa AS (SELECT * FROM (SELECT query_id, id, label, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bfs JOIN gr USING (id) WHERE score > 0) WHERE rank <= 16)"""
_FOLD = "replace(lower({}), 'ß', 'ss')"
_TERMS = "list_sort(list_filter(list_distinct(regexp_extract_all(" + _FOLD + ", '([a-z0-9]{{3,}})', 1)), lambda x: NOT list_contains(" + _STOP + ", x)))"
_CASES = f"""ca AS (
  SELECT conv_id || '-' || turn AS question_id, {_TERMS.format("text")} AS t, role AS bucket, role = 'system' AS ok,
    {_FOLD.format("coalesce(lag(text) OVER w, '')")} AS passage, {_FOLD.format("coalesce(lead(text) OVER w, '')")} AS fact
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), cr AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(passage, x)))::DOUBLE / len(t) ELSE 0 END AS pr, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(fact, x)))::DOUBLE / len(t) ELSE 0 END AS fr FROM ca),
fc AS (SELECT question_id, CASE WHEN ok THEN 'correct' WHEN pr = 0 THEN 'retrieval_miss' WHEN pr < 0.5 THEN 'partial_retrieval' WHEN fr = 0 THEN 'output_miss' ELSE 'agent_miss' END AS kind, round(pr, 6) AS passage_recall, round(fr, 6) AS fact_recall, bucket FROM cr)"""

_LIT = _SEG + f""", p AS (
  SELECT *, '2026-01-01T' || lpad((turn % 24)::VARCHAR, 2, '0') || ':00:00Z' AS seen_at, lower(trim(coalesce(nullif(role, ''), '__anonymous__'))) AS speaker,
    regexp_extract_all(text, '([A-Z][a-z]{{2,}})', 1) AS n, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS first FROM mt
), pp AS (SELECT *, {_id("'{\"canonical_form\":\"' || speaker || '\",\"entity_type\":\"SPEAKER\",\"type\":\"entity\"}'")} AS speaker_id, {_id("'{\"iso_timestamp\":\"' || seen_at || '\",\"type\":\"time_anchor\"}'")} AS anchor FROM p),
mm AS (SELECT memory_index, memory_id, turn_id, seen_at, anchor, surface, place, lower(surface) AS form, {_id("'{\"canonical_form\":\"' || lower(surface) || '\",\"entity_type\":\"NAME\",\"type\":\"entity\"}'")} AS entity
  FROM (SELECT *, unnest(n) AS surface, unnest(range(len(n))) AS place FROM pp)),
gg AS (SELECT segment_id, turn_id, w[1] || ' ' || w[2] AS text FROM (SELECT *, regexp_extract_all(lower(text), '([a-z]+)', 1) AS w FROM seg) WHERE len(w) > 1),
gr2 AS (SELECT *, {_id("'{\"ngram_kind\":\"noun_chunk\",\"normalized_text\":\"' || text || '\",\"segment_id\":\"' || segment_id || '\",\"type\":\"ngram\"}'")} AS id FROM gg),
cl AS (
  SELECT pp.memory_index, pp.memory_id, pp.turn_id, pp.seen_at, anchor, speaker_id, a.entity AS own, b.entity AS object_id, NULL AS literal, a.form AS subject, b.form AS object, 'near' AS predicate,
    {_id("'{\"object_id\":\"' || b.entity || '\",\"object_literal\":null,\"predicate\":\"near\",\"subject_id\":\"' || a.entity || '\",\"type\":\"claim\"}'")} AS id
  FROM pp JOIN (SELECT memory_index, entity, form FROM mm WHERE place = 0) a USING (memory_index) JOIN (SELECT memory_index, entity, form FROM mm WHERE place = 1) b USING (memory_index)
  UNION ALL SELECT memory_index, memory_id, turn_id, seen_at, anchor, speaker_id, speaker_id, NULL, first, speaker, first, 'like',
    {_id("'{\"object_id\":null,\"object_literal\":\"' || first || '\",\"predicate\":\"like\",\"subject_id\":\"' || speaker_id || '\",\"type\":\"claim\"}'")} FROM pp WHERE first <> ''
), pf AS (SELECT memory_index, memory_id, turn_id, seen_at, anchor, speaker_id, literal, subject, {_id("'{\"holder_id\":\"' || speaker_id || '\",\"polarity\":\"likes\",\"target_id\":null,\"target_literal\":\"' || literal || '\",\"type\":\"preference\"}'")} AS id FROM cl WHERE predicate = 'like'),
gn AS (
  SELECT memory_id AS id, 'memory' AS label, '' AS layer, text AS value FROM pp UNION ALL SELECT turn_id, 'turn', '', text FROM pp UNION ALL SELECT segment_id, 'utterance_segment', '', text FROM seg
  UNION SELECT id, 'ngram', '', text FROM gr2 UNION SELECT speaker_id, 'entity', 'entity', speaker FROM pp UNION SELECT entity, 'entity', 'entity', form FROM mm
  UNION SELECT id, 'claim', 'relationship', predicate FROM cl UNION SELECT id, 'preference', 'relationship', literal FROM pf UNION SELECT anchor, 'time_anchor', 'temporal', seen_at FROM pp
), eo AS (
  SELECT turn_id AS src, memory_id AS dst, 'part_of' AS type, NULL AS surface_form, memory_id, memory_index, seen_at AS asserted_at FROM pp
  UNION ALL SELECT segment_id, turn_id, 'part_of', NULL, memory_id, memory_index, NULL FROM seg JOIN pp USING (turn_id)
  UNION ALL SELECT id, segment_id, 'part_of', NULL, memory_id, memory_index, NULL FROM gr2 JOIN pp USING (turn_id)
  UNION ALL SELECT turn_id, entity, 'mentions', surface, memory_id, memory_index, seen_at FROM mm
  UNION ALL SELECT turn_id, id, 'asserts', NULL, memory_id, memory_index, seen_at FROM cl
  UNION ALL SELECT id, own, 'about', NULL, memory_id, memory_index, seen_at FROM cl UNION ALL SELECT id, object_id, 'about', NULL, memory_id, memory_index, seen_at FROM cl WHERE object_id IS NOT NULL
  UNION ALL SELECT speaker_id, id, 'holds_preference', NULL, memory_id, memory_index, seen_at FROM pf
  UNION ALL SELECT turn_id, anchor, 'temporal_at', NULL, memory_id, memory_index, seen_at FROM pp UNION ALL SELECT segment_id, anchor, 'temporal_at', NULL, memory_id, memory_index, seen_at FROM seg JOIN pp USING (turn_id)
  UNION ALL SELECT id, anchor, 'temporal_at', NULL, memory_id, memory_index, seen_at FROM gr2 JOIN pp USING (turn_id) UNION ALL SELECT id, anchor, 'temporal_at', NULL, memory_id, memory_index, seen_at FROM cl UNION ALL SELECT id, anchor, 'temporal_at', NULL, memory_id, memory_index, seen_at FROM pf
), ge AS (SELECT src, dst, type, 1.0::DOUBLE AS weight, arg_max(surface_form, memory_index) AS surface_form, arg_max(memory_id, memory_index) AS source_memory_id, arg_max_null(asserted_at, memory_index) AS asserted_at FROM eo GROUP BY ALL)"""
_DER = """me AS (SELECT DISTINCT source_memory_id AS m, dst FROM ge WHERE type = 'mentions'),
co AS (SELECT a.dst AS entity_a, b.dst AS entity_b, count(*) AS count FROM me a JOIN me b ON a.m = b.m AND a.dst < b.dst GROUP BY ALL),
re AS (SELECT dst AS node_id, CASE type WHEN 'asserts' THEN 'claim' ELSE 'preference' END AS kind, count(*) AS count, min(asserted_at) AS earliest, max(asserted_at) AS latest FROM ge WHERE type IN ('asserts', 'holds_preference') GROUP BY ALL),
cp AS (SELECT holder, 'literal:' || literal AS target_key, id, asserted_at FROM (SELECT DISTINCT speaker_id AS holder, literal, id FROM pf) JOIN (SELECT dst AS id, asserted_at FROM ge WHERE type = 'holds_preference') USING (id))"""


def _case(table: dict[str, dict[str, float]], first: str, second: str) -> str:
    return "(CASE " + " ".join(f"WHEN {first} = '{i}' AND {second} = '{k}' THEN {w}" for i, ws in table.items() for k, w in ws.items()) + " END)::DOUBLE"


def _recall_sql(depth: int = LITERAL.max_depth) -> str:
    """Queries, seeds, walk, passages (ps) of the literal graph."""
    vec = lambda t: f"[(length({t}) % 7)::DOUBLE, (length({t}) % 11)::DOUBLE, 1.0::DOUBLE]"
    out = f"""{_LIT}, {_DER}, qs AS (SELECT turn_id AS query_id, {vec("text")} AS v, {recall.INTENTS}[(memory_index % {len(recall.INTENTS)} + 1)::INT] AS intent FROM pp),
gv AS (SELECT turn_id AS id, 'turn' AS g, {vec("text")} AS v FROM pp UNION ALL SELECT segment_id, 'sentence', {vec("text")} FROM seg UNION ALL SELECT id, 'ngram', {vec("text")} FROM gr2),
nn AS (SELECT query_id, intent, id, g, s, row_number() OVER (PARTITION BY query_id, g ORDER BY s DESC, id) AS r FROM (SELECT query_id, intent, id, g, round(list_cosine_similarity(qs.v, gv.v), 6) AS s FROM qs CROSS JOIN gv)),
se AS (SELECT query_id, id, s * w AS score FROM (SELECT *, {_case(recall.SEED_WEIGHTS, "intent", "g")} AS w FROM nn WHERE r <= {LITERAL.top_n}) WHERE r <= greatest(1, round_even({LITERAL.top_n} * w, 0))),
nd AS (SELECT DISTINCT turn_id AS query_id, entity AS id FROM mm),
es AS (SELECT query_id, id, {recall.ENTITY_SCORE}::DOUBLE AS score FROM nd UNION ALL SELECT DISTINCT nd.query_id, src, {recall.MENTION_SCORE}::DOUBLE FROM nd JOIN ge ON ge.dst = nd.id AND type = 'mentions'),
sm AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM se UNION ALL SELECT * FROM es) GROUP BY ALL)) WHERE r <= {LITERAL.max_seeds}),
y0 AS (SELECT query_id, intent, id, score FROM sm JOIN qs USING (query_id) WHERE score > 0)"""
    for i in range(1, depth + 1):
        out += f""", y{i} AS (SELECT query_id, intent, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
  SELECT query_id, intent, dst AS id, max(score * weight * {_case(recall.EDGE_WEIGHTS, "intent", "type")}) AS score FROM y{i - 1} JOIN ge ON src = id GROUP BY ALL) WHERE score > 0) WHERE r <= {LITERAL.max_frontier})"""
    return out + ", ys AS (SELECT query_id, id, max(score) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM y{i}" for i in range(depth + 1)) + f""") GROUP BY ALL),
gc AS (SELECT turn_id AS id, turn_id, 'turn' AS granularity FROM pp UNION ALL SELECT segment_id, turn_id, 'sentence' FROM seg UNION ALL SELECT id, turn_id, 'ngram' FROM gr2),
ps AS (SELECT * FROM (SELECT query_id, id, turn_id, granularity, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ys JOIN gc USING (id)) WHERE rank <= {LITERAL.max_passages})"""


_FACTS = """bk AS (SELECT dst AS id, array_to_string(list_sort(list(DISTINCT source_memory_id)), ',') AS memories FROM ge WHERE type IN ('asserts', 'holds_preference') GROUP BY dst),
hc AS (SELECT DISTINCT query_id, dst AS node_id FROM ps JOIN ge ON src = ps.id AND type = 'asserts'),
rl AS (SELECT DISTINCT id, subject, predicate, object FROM cl),
nf AS (SELECT query_id, entity_a, entity_b, count, q AS own, o AS other FROM (
    SELECT nd.query_id, entity_a, entity_b, count, entity_a AS q, entity_b AS o FROM co JOIN nd ON nd.id = entity_a
    UNION ALL SELECT nd.query_id, entity_a, entity_b, count, entity_b, entity_a FROM co JOIN nd ON nd.id = entity_b WHERE NOT EXISTS (FROM nd x WHERE x.query_id = nd.query_id AND x.id = entity_a))
  QUALIFY row_number() OVER (PARTITION BY query_id, q ORDER BY count DESC, entity_a, entity_b) <= 5),
fm AS (SELECT DISTINCT entity AS id, form FROM mm),
fa AS (
  SELECT query_id, 'reinforcement' AS kind, subject, predicate, object, CASE WHEN earliest = latest THEN count || ' observations at ' || latest ELSE count || ' observations between ' || earliest || ' and ' || latest END AS value, latest AS timestamp, memories
  FROM hc JOIN re USING (node_id) JOIN rl ON rl.id = node_id JOIN bk ON bk.id = node_id JOIN qs USING (query_id) WHERE count >= 2 AND intent <> 'entity_resolution'
  UNION ALL SELECT query_id, 'co_occurrence', a.form, 'co_occurs_with', b.form, count || ' shared memories', NULL, '' FROM nf JOIN fm a ON a.id = own JOIN fm b ON b.id = other JOIN qs USING (query_id) WHERE intent = 'aggregation'
)"""

ORACLES: dict[str, str] = {
    "graph_nodes": f"WITH {_LIT} SELECT * FROM gn",
    "graph_edges": f"WITH {_LIT} SELECT * FROM ge",
    "graph_coverage": f"""WITH {_LIT} SELECT 'label' AS part, label AS name, count(*) AS count FROM gn GROUP BY label UNION ALL SELECT 'layer', CASE WHEN layer = '' THEN '(unlayered)' ELSE layer END, count(*) FROM gn GROUP BY ALL UNION ALL SELECT 'total', 'nodes', count(*) FROM gn
UNION ALL SELECT 'ngram_kind', 'noun_chunk', count(*) FROM gn WHERE label = 'ngram' UNION ALL SELECT 'edge_type', type, count(*) FROM ge GROUP BY type UNION ALL SELECT 'total', 'edges', count(*) FROM ge""",
    "graph_derived": f"""WITH {_LIT}, {_DER} SELECT 'aliases' AS "index", dst AS a, '' AS b, array_to_string(list_sort(list(DISTINCT surface_form)), '|') AS value FROM ge WHERE type = 'mentions' GROUP BY dst
UNION ALL SELECT 'co_occurrence', entity_a, entity_b, count::VARCHAR FROM co UNION ALL SELECT 'reinforcement', node_id, kind, count || '|' || earliest || '|' || latest FROM re
UNION ALL SELECT 'current_preference', holder, target_key, 'likes|' || id || '|' || asserted_at FROM cp
UNION ALL SELECT 'time_anchor_chain', anchor, seen_at, coalesce(lag(anchor) OVER w, '') || '|' || coalesce(lead(anchor) OVER w, '') FROM (SELECT DISTINCT anchor, seen_at FROM pp) WINDOW w AS (ORDER BY seen_at, anchor)""",
    "graph_passages": f"""WITH {_recall_sql()}, su AS (SELECT turn_id AS id, array_to_string(list_sort(list(subject || ' ' || predicate || '(' || object || ')')), ';') AS s FROM (SELECT DISTINCT turn_id, id, subject, predicate, object FROM cl) GROUP BY turn_id)
SELECT query_id, rank, ps.id, granularity, round(score, 6) AS score, memory_id AS source_memory_id, memory_index AS source_memory_index, seen_at AS timestamp, role AS speaker, coalesce(s, '') AS supporting_edges FROM ps JOIN pp USING (turn_id) LEFT JOIN su ON su.id = ps.id""",
    "graph_facts": f"WITH {_recall_sql()}, {_FACTS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, subject, predicate, object, value)::INT AS rank FROM fa",
    "failure_classes_graph": f"""WITH {_LIT}, {_DER}, t AS (SELECT item_id::VARCHAR AS question_id, {_TERMS.format("text")} AS t FROM benchmark WHERE item_id IS NOT NULL),
en AS (SELECT id, value FROM gn WHERE label = 'entity'), h AS (SELECT question_id, id, list_filter(t, lambda x: contains(value, x)) AS f FROM t CROSS JOIN en WHERE len(list_filter(t, lambda x: contains(value, x))) > 0),
nh AS (SELECT question_id, count(*) AS n, len(list_distinct(flatten(list(f)))) AS k FROM h GROUP BY question_id), i AS (SELECT DISTINCT a.question_id FROM h a JOIN co ON a.id = entity_a JOIN h b ON b.id = entity_b AND a.question_id = b.question_id)
SELECT question_id, CASE WHEN coalesce(k, 0) = 0 THEN 'extraction_miss' WHEN n >= 2 AND question_id NOT IN (FROM i) THEN 'graph_gap' ELSE 'retrieval_miss' END AS kind, round(CASE WHEN len(t) > 0 THEN coalesce(k, 0) / len(t) ELSE 0 END, 6) AS node_recall FROM t LEFT JOIN nh USING (question_id)""",
    "memory_append": f"WITH {_MEM} SELECT conv_id, turn, memory_index, memory_id, turn_id FROM mt",
    "ingest_stream": f"WITH {_MEM} SELECT conv_id, turn, memory_index, memory_id, turn_id FROM mt",
    "granule_part_of": f"WITH {_SEG} SELECT * FROM seg",
    "token_ngrams": f"""WITH {_SEG}, w AS (SELECT segment_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: NOT list_contains({_STOP}, x)) AS w FROM seg)
SELECT segment_id, text, count(*) AS n FROM (SELECT segment_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS text FROM w) GROUP BY ALL""",
    "mention_edges": """SELECT src, dst, 'mentions' AS type, weight, surface_form FROM (SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, l_quantity AS weight, l_suppkey::VARCHAR AS surface_form,
  row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""",
    "node_upsert": """WITH o AS (SELECT 'n:' || c_nationkey AS id, c_mktsegment AS label, NULL AS layer, c_name AS name, c_custkey AS seq FROM customer UNION ALL SELECT 'n:' || s_nationkey, 'SUPPLIER', 'supply', NULL, s_suppkey + 1000000000 FROM supplier)
SELECT id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, coalesce(array_to_string(list_sort(list(DISTINCT layer) FILTER (layer IS NOT NULL)), ','), '') AS layers, arg_max(name, seq) FILTER (name IS NOT NULL) AS name FROM o GROUP BY id""",
    "entity_aliases": "SELECT p_brand AS entity_id, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS aliases FROM part WHERE p_type <> '' GROUP BY p_brand",
    "co_occurrence": f"WITH {_PAIRS} SELECT entity_a, entity_b, count, round(count / max(count) OVER (), 6) AS weight FROM pr",
    "reinforcement": f"WITH {_OBS} SELECT node AS node_id, event_type AS kind, count(*) AS count, min(seen) AS earliest, max(seen) AS latest FROM ob GROUP BY ALL",
    "current_preference": f"WITH {_OBS} SELECT user_id AS holder_id, target AS target_key, event_type AS polarity, event_id AS preference_id, seen AS asserted_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY coalesce(seen, '') DESC, event_id DESC) AS r FROM ob) WHERE r = 1",
    "change_events": f"WITH {_OBS} SELECT user_id AS holder_id, target AS target_key, before, event_type AS after, seen AS changed_at FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id, target ORDER BY coalesce(seen, ''), event_id) AS before FROM ob) WHERE before <> event_type",
    "time_anchor_chain": f"WITH {_ANCHOR} SELECT anchor AS time_anchor_id, iso AS iso_timestamp, lag(anchor) OVER (ORDER BY iso, anchor) AS prev_id, lead(anchor) OVER (ORDER BY iso, anchor) AS next_id FROM (SELECT DISTINCT anchor, iso FROM an)",
    "temporal_at_fanin": f"WITH {_ANCHOR} SELECT anchor, iso, count(*) AS n FROM an GROUP BY ALL",
    "knn_topk": f"WITH {_COS} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ks) WHERE rank <= 12",
    "knn_per_granularity": f"WITH {_COS} SELECT query_id, id, label::VARCHAR AS granularity, round(score * ((10 - label) / 10), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS r FROM ks) WHERE r <= greatest(1, round(12 * ((10 - label) / 10))) AND label < 10",
    "centroid_classify": f"""WITH {_CENT}, t AS (SELECT vec_id, list(score ORDER BY score DESC, class::VARCHAR) AS s, list(class::VARCHAR ORDER BY score DESC, class::VARCHAR) AS k FROM sc GROUP BY vec_id)
SELECT vec_id, CASE WHEN round(s[1] - s[2], 6) >= 0.05 THEN k[1] ELSE 'single_fact' END AS class, s[1] AS top, s[2] AS second, round(s[1] - s[2], 6) AS margin, least(greatest(s[1], 0), 1) AS confidence FROM t""",
    "discrimination_margin": f"WITH {_CENT.replace('label IS NOT NULL)', 'label IS NOT NULL AND vec_id % 2 = 0)').replace('FROM embeddings e CROSS', 'FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 1) e CROSS')}, m AS (SELECT vec_id, own, max(score) FILTER (class = own) AS a, max(score) FILTER (class <> own) AS b FROM sc GROUP BY ALL) SELECT own AS class, round(median(a - b), 6) AS margin FROM m GROUP BY own",
    "seed_merge": "SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT query_id, id, max(score) AS score FROM (SELECT l_suppkey AS query_id, l_partkey AS id, l_discount AS score FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, l_tax FROM lineitem) GROUP BY ALL)) WHERE r <= 64",
    "bfs_expand": f"WITH {_layers(256)} SELECT * FROM bfs",
    "bfs_uncapped": f"WITH {_layers(0)} SELECT * FROM bfs",
    "passage_topk": f"WITH {_PASS} SELECT query_id, id, label, score, rank FROM pa",
    "passages_assembled": f"""WITH {_PASS}, su AS (SELECT src AS id, array_to_string(list_sort(list(n_name)), ';') AS s FROM e JOIN nation ON dst = 'n:' || n_nationkey WHERE type = 'part_of' GROUP BY src)
SELECT query_id, rank, pa.id, label, text, score, coalesce(s, '') AS supporting_edges FROM pa LEFT JOIN su ON pa.id = su.id""",
    "facts_reinforcement": f"""WITH {_OBS}, x AS (SELECT user_id, event_type, count(*) AS n, min(seen) AS a, max(seen) AS b FROM ob WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT user_id AS query_id, 'reinforcement' AS kind, user_id::VARCHAR AS subject, 'did' AS predicate, event_type AS object, CASE WHEN a = b THEN n || ' observations at ' || a ELSE n || ' observations between ' || a || ' and ' || b END AS value, b AS timestamp FROM x WHERE n >= 2""",
    "facts_co_occurrence": f"""WITH {_PAIRS}
SELECT q AS query_id, 'co_occurrence' AS kind, coalesce(x.p_name, '') AS subject, 'co_occurs_with' AS predicate, coalesce(y.p_name, '') AS object, count || ' shared memories' AS value, NULL::VARCHAR AS timestamp
FROM (SELECT entity_a, entity_b, count, entity_a AS q, entity_b AS o FROM pr UNION ALL SELECT entity_a, entity_b, count, entity_b, entity_a FROM pr) z LEFT JOIN part x ON q = x.p_partkey LEFT JOIN part y ON o = y.p_partkey WHERE q IN (SELECT p_partkey FROM part)
QUALIFY row_number() OVER (PARTITION BY q ORDER BY count DESC, entity_a, entity_b) <= 5""",
    "coverage_report": f"""WITH {_WALK}, n AS (SELECT ['customer', c_mktsegment] AS labels, '(unlayered)' AS layer FROM customer UNION ALL SELECT ['supplier'], 'supply' FROM supplier)
SELECT 'label' AS part, name, count(*) AS count FROM (SELECT unnest(labels) AS name FROM n) GROUP BY name UNION ALL SELECT 'layer', layer, count(*) FROM n GROUP BY layer UNION ALL SELECT 'total', 'nodes', count(*) FROM n
UNION ALL SELECT 'edge_type', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'total', 'edges', count(*) FROM e""",
    "needle_overlap": f"""WITH g AS (SELECT item_id, {_TERMS.format("text")} AS t FROM benchmark), h AS (SELECT doc_id, {_FOLD.format("text")} AS x FROM documents),
p AS (SELECT item_id, doc_id, t, list_filter(t, lambda y: contains(x, y)) AS f FROM g CROSS JOIN h)
SELECT item_id, doc_id, array_to_string(f, ' ') AS found, array_to_string(list_filter(t, lambda y: NOT list_contains(f, y)), ' ') AS missed, round(len(f)::DOUBLE / len(t), 6) AS recall FROM p WHERE len(f) > 0""",
    "failure_classes": f"WITH {_CASES} SELECT * FROM fc",
    "bucket_breakdown": f"""WITH {_CASES}, b AS (SELECT CASE WHEN bucket <> '' THEN bucket ELSE '(none)' END AS b, kind AS k FROM fc)
SELECT CASE WHEN grouping(b) = 1 THEN '(all)' ELSE b END AS bucket, CASE WHEN grouping(k) = 1 THEN '(all)' ELSE k END AS kind, count(*) AS count FROM b GROUP BY GROUPING SETS ((b, k), (k), ())""",
    "graph_gap": f"""WITH {_PAIRS}, h AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS id FROM lineitem), i AS (SELECT DISTINCT a.case_id FROM h a JOIN pr ON a.id = entity_a JOIN h b ON b.id = entity_b AND a.case_id = b.case_id)
SELECT case_id, count(*) AS nodes, count(*) >= 2 AND case_id NOT IN (SELECT case_id FROM i) AS gap FROM h GROUP BY case_id""",
    "snapshot_diff": """SELECT c_custkey, 'changed: ' || CASE WHEN n AND s THEN 'c_name,c_acctbal' WHEN n THEN 'c_name' ELSE 'c_acctbal' END AS difference FROM (SELECT c_custkey, c_nationkey = 3 AND lower(c_name) <> c_name AS n, c_mktsegment = 'BUILDING' AS s FROM customer) WHERE n OR s""",
    "profile_stats": """WITH o AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT l_returnflag, n, round(avg(v), 6) AS mean, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = least(n - 1, (n * 95) // 100)) AS p95, max(v) AS max FROM o GROUP BY ALL""",
    "entity_canonical_exact": "SELECT p_partkey AS seq, " + _id("'{\"canonical_form\":\"' || trim(lower(p_type)) || '\",\"entity_type\":\"' || p_brand || '\",\"type\":\"entity\"}'") + " AS entity_id, trim(lower(p_type)) AS canonical, p_brand AS kind FROM part WHERE trim(p_type) <> ''",
}
