"""A memory: tables of observations go in, tables of queries are answered; the graph lies in a folder of snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import parse
from granary.functions.text import normalize
from granary.operators import derived, graph, ingest, recall, trace, vectors
from granary.sources import store
from granary.sources.tables import written


class FrozenError(RuntimeError):
    """The memory was frozen; it can be read, not written."""


class Memory:
    """One memory under a folder that all executors share.

    ``parser`` and ``embedder`` go from a text to a parse and to a vector; by default the rule parser and the hash embedder.
    ``classify`` has preferences decided by the nearest polarity centroid (those classes whose held-out examples it tells apart); by
    default it is on where an embedder other than the fallback is given, and the predicate decides otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), parser: Callable | None = None, embedder: Callable | None = None, classify: bool | None = None):
        self.spark, self.path, self.config = spark, path, config
        self.parser = parser or parse.RuleParser()
        self.embedder = embedder or parse.HashEmbedder(config.dimension)
        self.frozen = False
        self.timing: dict[str, float] = {}
        self._classify = embedder is not None if classify is None else classify
        self._state: dict | None = None
        self._cents: DataFrame | None = None

    # State.

    def state(self) -> dict:
        """The last snapshot's tables (nodes, edges, vectors, derived, manifest), or empty ones. Another ingest configuration raises."""
        if self._state is None:
            self._state = store.load(self.spark, self.path, self.config) if store.exists(self.spark, self.path) else None
        return self._state or self._empty()

    def _empty(self) -> dict:
        payloads = ", ".join(f"{n} {kind}" for n, kind in ingest.PAYLOADS.items())
        make = lambda schema: self.spark.createDataFrame([], schema)
        nodes = make(f"id string, labels array<string>, layers array<string>, {payloads}")
        edges = make(store.EDGES)
        return {"nodes": nodes, "edges": edges, "vectors": make("node_id string, granularity string, vec array<float>"), "derived": {}, "manifest": {"snapshot": None, "memories": 0, "batch": None}}

    def reset(self) -> None:
        """Forget everything: the next snapshot starts from nothing. Earlier ones stay on disk and are no longer read."""
        self._writable()
        store.clear(self.spark, self.path)
        self._state = None

    def freeze(self) -> None:
        self.frozen = True

    def _writable(self) -> None:
        if self.frozen:
            raise FrozenError("the memory is frozen")

    # Writing.

    def ingest(self, memories: DataFrame, order: list, bucket: Column | None = None, batch: int | None = None) -> None:
        """Add a batch of memories (content, timestamp, speaker, source, metadata), numbered after those before in the order (bucket, order).

        ``bucket`` is a column that grows with the order and cuts it into parts of a size that one task can sort; without it the batch is one part.
        A numbered ``batch`` that the memory has already, or an earlier one, is left out: a stream may repeat its last one.
        """
        self._writable()
        began, old = time.perf_counter(), self.state()
        last = old["manifest"]["batch"]
        if batch is not None and last is not None and batch <= last:
            return
        numbered = ingest.number_memories(memories, F.lit(0) if bucket is None else bucket, order, old["manifest"]["memories"])
        numbered = numbered.select("memory_index", "memory_id", "turn_id", "content", "timestamp", "speaker", "source", "metadata")
        parsed = ingest.parse_memories(numbered, self.config, self.parser)
        nodes, edges = ingest.ingest(parsed, self.config, store.known_forms(old["nodes"]), self._polarity() if self._classify else None)
        nodes, edges = graph.upsert_nodes(nodes, list(ingest.PAYLOADS)), graph.upsert_edges(edges)
        added = written(nodes)
        merged = written(graph.merge_nodes(old["nodes"], added, list(ingest.PAYLOADS)))
        edges = written(graph.merge_edges(old["edges"], edges))
        fresh = added.join(old["vectors"].select(F.col("node_id").alias("id")), "id", "left_anti")
        vecs = old["vectors"].unionByName(ingest.embed_granules(fresh, self.embedder, self.config.dimension))
        last_index = merged.where("memory IS NOT NULL").agg(F.max("memory.memory_index")).first()[0] or 0
        store.save(self.path, merged, edges, self.config, vecs, memories=last_index, batch=last if batch is None else batch)
        self._state = None
        self.timing["ingest_ms"] = _ms(began)

    def _polarity(self) -> Callable[[DataFrame], DataFrame]:
        """A preference is what the nearest centroid of the example sentences says, of the classes that it tells apart on held-out ones."""
        from granary.sources import seeds

        def embedded(heldout: bool) -> DataFrame:
            rows = [(r["class"], r["text"], self.embedder(r["text"]).tolist()) for r in seeds.sentences(self.spark, seeds.POLARITIES, heldout).collect()]
            return self.spark.createDataFrame(rows, "label string, vec_id string, vec array<float>")

        cents = written(vectors.centroids(embedded(False), "label"))
        enabled = [r["class"] for r in vectors.enabled_classes(vectors.median_margins(embedded(True), cents), self.config.polarity_margin).collect()]

        def classified(said: DataFrame) -> DataFrame:
            text = F.expr("filter(segments, s -> s.index = c.segment)[0].text")
            keyed = written(said.withColumn("claim_text", text).withColumn("claim_row", F.concat_ws(":", "memory_index", "place")))
            vecs = ingest.embed_texts(keyed.select("claim_row", "claim_text"), self.embedder, self.config.dimension)
            got = vectors.classify(vecs.withColumnRenamed("claim_row", "vec_id"), cents, self.config.polarity_margin, enabled=enabled)
            return keyed.join(got.select(F.col("vec_id").alias("claim_row"), F.col("class").alias("polarity"), "confidence"), "claim_row", "left")

        return classified

    # Derived indexes.

    def derived(self) -> dict[str, DataFrame]:
        """The five indexes; made again, and saved, where those of the last snapshot don't belong to its graph and settings."""
        s = self.state()
        if not s["derived"] and s["manifest"]["snapshot"] is not None:
            store.save_derived(self.path, s["manifest"], derived.rebuild(s["nodes"], s["edges"]), self.config)
            self._state = None
            s = self.state()
        return s["derived"] or derived.rebuild(s["nodes"], s["edges"])

    # Reading.

    def queries(self, texts: DataFrame, hint: str | None = None, max_passages: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(queries, mentions) of texts (query_id, text): their vectors, and the names in them as the parser sees them."""
        t = texts.select("query_id", "text", F.lit(hint).cast("string").alias("hint"), F.lit(max_passages).cast("int").alias("max_passages"))
        vecs = ingest.embed_texts(t.select("query_id", "text"), self.embedder, self.config.dimension).drop("text")
        numbered = t.select(F.monotonically_increasing_id().alias("memory_index"), "query_id", F.col("text").alias("content"))
        parsed = ingest.parse_memories(written(numbered), self.config, self.parser)
        said = parsed.select("query_id", F.explode("mentions").alias("m")).select("query_id", "m.surface", "m.kind")
        return written(t.join(vecs, "query_id")), written(said)

    def recall(self, texts: DataFrame, hint: str | None = None, max_passages: int | None = None, now: str | None = None, timezone: str | None = None, stages: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(results, passages, facts) of texts (query_id, text); results has a row a query: intent, confidence and a fingerprint of query, settings and arguments.

        ``now`` and ``timezone`` only enter the fingerprint. An unknown hint raises. An empty memory gives no passages and no facts.
        """
        if hint is not None and hint not in recall.INTENTS:
            raise ValueError(f"hint {hint} is none of {recall.INTENTS}")
        began, s = time.perf_counter(), self.state()
        if self._cents is None:
            self._cents = written(recall.intent_centroids(self.spark, self.embedder, self.config.dimension))
        queries, mentions = self.queries(texts, hint, max_passages)
        stages = {} if stages is None else stages
        stages["queries"] = queries
        passages, facts = recall.recall(queries, s["nodes"], s["edges"], s["vectors"], self.derived(), mentions, self.config, self._cents, stages)
        config = self.config
        prints = F.udf(lambda q: config.result_fingerprint(q, now, timezone, max_passages, hint), useArrow=True)
        results = stages["intents"].join(queries.select("query_id", "text"), "query_id").select("query_id", "intent", "confidence", prints("text").alias("recall_fingerprint"))
        self.timing["recall_ms"] = _ms(began)
        return results, passages, facts

    def trace(self, texts: DataFrame, **arguments) -> DataFrame:
        """One row a query with what every stage did; see ``trace.to_json``, ``to_text`` and ``to_html`` for a row."""
        stages: dict = {}
        _, _, facts = self.recall(texts, stages=stages, **arguments)
        s = self.state()
        return trace.trace_table(stages["queries"], s["nodes"], s["edges"], facts, stages, self.config, self._cents)

    def ask(self, text: str, **arguments) -> tuple[Row, list[Row], list[Row]]:
        """One query: (result, passages by rank, facts by rank)."""
        texts = self.spark.createDataFrame([(uuid4().hex, text)], "query_id string, text string")
        results, passages, facts = self.recall(texts, **arguments)
        return results.first(), passages.orderBy("rank").collect(), facts.orderBy("rank").collect()

    def known_entities(self) -> DataFrame:
        """(id, kind, form) of the entities."""
        return self.state()["nodes"].where("entity IS NOT NULL").select("id", F.col("entity.entity_type").alias("kind"), F.col("entity.canonical_form").alias("form"))

    def find(self, surface: str) -> DataFrame:
        """The entities that have the normal form of ``surface``."""
        return self.known_entities().where(F.col("form") == normalize(F.lit(surface)))


def _ms(began: float) -> float:
    return round(1000 * (time.perf_counter() - began), 6)
