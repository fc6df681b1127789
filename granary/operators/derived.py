"""The indexes that are derived from the edges: aliases, co-occurrence, reinforcement, current preference, time chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import link_neighbours


def aliases(mentions: DataFrame, entity: str = "dst", surface: str = "surface_form") -> DataFrame:
    """(entity_id, aliases): the sorted distinct surface forms of every entity that has one; null and '' are none."""
    return mentions.where(F.col(surface) != "").groupBy(F.col(entity).alias("entity_id")).agg(F.array_sort(F.collect_set(surface)).alias("aliases"))


def meetings(members: DataFrame, group: str = "source_memory_id", entity: str = "dst") -> DataFrame:
    """(entity_a, entity_b): a row for each group in which two entities meet, entity_a the lower.

    Each group's distinct entities are gathered once and paired inside its row, so the table isn't joined with itself.
    """
    groups = members.where(F.col(group).isNotNull() & F.col(entity).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(entity)).alias("e"))
    first = groups.where("size(e) > 1").select("e", F.posexplode("e").alias("i", "entity_a"))
    return first.select("entity_a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("entity_b"))


def co_occurrence(members: DataFrame, group: str = "source_memory_id", entity: str = "dst") -> DataFrame:
    """(entity_a, entity_b, count, weight): in how many groups two entities meet, and that over the highest such count."""
    counts = meetings(members, group, entity).groupBy("entity_a", "entity_b").agg(F.count("*").alias("count"))
    top = counts.agg(F.max("count").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("entity_a", "entity_b", "count", (F.col("count") / F.col("top")).alias("weight"))  # top is one row


def reinforcement(asserted: DataFrame, node: str = "dst", kind: str = "kind", at: str = "asserted_at") -> DataFrame:
    """(node_id, kind, count, earliest, latest): all observations count; null and '' times don't bound."""
    when = F.when(F.col(at).cast("string") != "", F.col(at))
    return asserted.groupBy(F.col(node).alias("node_id"), F.col(kind).alias("kind")).agg(F.count("*").alias("count"), F.min(when).alias("earliest"), F.max(when).alias("latest"))


def target_key(target_id: Column, literal: Column) -> Column:
    return F.when(target_id.isNotNull(), F.concat(F.lit("entity:"), target_id)).otherwise(F.concat(F.lit("literal:"), F.coalesce(literal, F.lit(""))))


def current_preference(held: DataFrame, holder: str = "holder_id", target: str = "target_key", polarity: str = "polarity", key: str = "preference_id", at: str = "asserted_at") -> DataFrame:
    """(holder_id, target_key, polarity, preference_id, asserted_at): the last held preference; a null time is the earliest, ties go to the higher id."""
    last = F.max_by(F.struct(F.col(polarity).alias("polarity"), F.col(key).alias("preference_id"), F.col(at).alias("asserted_at")), F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")), key))
    return held.groupBy(F.col(holder).alias("holder_id"), F.col(target).alias("target_key")).agg(last.alias("l")).select("holder_id", "target_key", "l.*")


def change_events(held: DataFrame, holder: str = "holder_id", target: str = "target_key", polarity: str = "polarity", key: str = "preference_id", at: str = "asserted_at") -> DataFrame:
    """(holder_id, target_key, before, after, changed_at): where a holder's next preference for a target differs from the last."""
    w = Window.partitionBy(holder, target).orderBy(F.coalesce(F.col(at).cast("string"), F.lit("")), key)
    t = held.withColumn("_before", F.lag(polarity).over(w)).where(F.col("_before") != F.col(polarity))
    return t.select(F.col(holder).alias("holder_id"), F.col(target).alias("target_key"), F.col("_before").alias("before"), F.col(polarity).alias("after"), F.col(at).alias("changed_at"))


def time_anchor_chain(anchors: DataFrame, key: str = "time_anchor_id", iso: str = "iso_timestamp") -> DataFrame:
    """(time_anchor_id, iso_timestamp, prev_id, next_id): distinct anchors in the order of text, then id; only one row a day crosses days."""
    t = anchors.where(F.col(key).isNotNull()).select(F.col(key).alias("time_anchor_id"), F.col(iso).alias("iso_timestamp")).distinct()
    return link_neighbours(t, F.substring("iso_timestamp", 1, 10), ["iso_timestamp", "time_anchor_id"], "time_anchor_id").select("time_anchor_id", "iso_timestamp", "prev_id", "next_id")


def rebuild(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All five indexes of a graph as ``ingest`` makes it."""
    mentions = edges.where("type = 'mentions'")
    asserted = edges.where("type IN ('asserts', 'holds_preference')").withColumn("kind", F.when(F.col("type") == "asserts", "claim").otherwise("preference"))
    prefs = nodes.where("preference IS NOT NULL").select(F.col("id").alias("preference_id"), "preference.holder_id", "preference.polarity", target_key(F.col("preference.target_id"), F.col("preference.target_literal")).alias("target_key"))
    times = edges.where("type = 'holds_preference'").select(F.col("dst").alias("preference_id"), "asserted_at")
    anchors = nodes.where("time_anchor IS NOT NULL").select(F.col("id").alias("time_anchor_id"), "time_anchor.iso_timestamp")
    return {
        "aliases": aliases(mentions),
        "co_occurrence": co_occurrence(mentions),
        "reinforcement": reinforcement(asserted),
        "current_preference": current_preference(prefs.join(times, "preference_id")),
        "time_anchor_chain": time_anchor_chain(anchors),
    }
