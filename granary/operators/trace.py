"""What every stage of a recall did, one row a query, and that row as JSON, text or HTML."""

from __future__ import annotations

import html
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from granary.config import Config

from . import recall, traverse, vectors

#: Characters of a preview; seeds of each source and dropped nodes that a trace keeps. Counts are of all.
PREVIEW, TOP_SEEDS, TOP_DROPPED = 160, 20, 25


def preview(text: Column | str) -> Column:
    """The first PREVIEW characters of a text, and an ellipsis where there are more."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > PREVIEW, F.concat(F.substring(t, 1, PREVIEW), F.lit("…"))).otherwise(t)


def node_text(nodes: DataFrame) -> DataFrame:
    """(id, text): what a node shows: its text, form, claim, preference, time or memory."""
    r = recall.relationships(nodes).select("id", F.col("text").alias("_r"))
    text = F.coalesce("turn.text", "utterance_segment.text", "ngram.surface_form", "entity.canonical_form", "_r", "time_anchor.iso_timestamp", "memory.content")
    return nodes.join(r, "id", "left").select("id", text.alias("text"))


def _top(df: DataFrame, names: list[str], most: int, out: str) -> DataFrame:
    """(query_id, out): a query's ``most`` best rows of (query_id, id, score, ...), in order, as an array."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    t = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_r", *names))), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return t.groupBy("query_id").agg(rows.alias(out))


def trace_table(queries: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, stages: dict, config: Config, cents: DataFrame | None = None) -> DataFrame:
    """One row a query: query_id, query and the structs intent, seed, expand, score, assemble; ``stages`` as ``recall.recall`` fills it.

    Arrays are bounded by the settings, TOP_SEEDS and TOP_DROPPED; all counts are of everything.
    """
    c = F.col
    text = node_text(nodes).select("id", preview("text").alias("preview"))
    q = queries.select("query_id", c("text").alias("query"), "hint").join(stages["intents"], "query_id")
    if cents is None:
        q = q.withColumn("scores", F.create_map().cast("map<string,double>"))
    else:
        scored = vectors.scored(queries.select("query_id", c("vec").alias("_v")), cents, "_v")
        q = q.join(scored.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(c("class").cast("string"), "score"))).alias("scores")), "query_id", "left")
    used = c("hint").isNotNull()
    out = q.select("query_id", "query", F.struct(used.alias("used_hint"), "hint", "scores", c("intent").alias("chosen"), c("confidence").alias("margin"), F.lit(config.intent_margin).alias("threshold"), (~used & (c("confidence") < config.intent_margin)).alias("fell_back")).alias("intent"))

    s, e, m = stages["semantic"], stages["entity"], stages["merged"]
    source = m.join(s.select("query_id", "id").distinct().withColumn("_s", F.lit(True)), ["query_id", "id"], "left").join(e.select("query_id", "id").distinct().withColumn("_e", F.lit(True)), ["query_id", "id"], "left")
    source = source.withColumn("source", F.when(c("_s") & c("_e"), "both").when(c("_s"), "semantic").otherwise("entity")).join(text, "id", "left")
    kinds = e.withColumn("source", F.when(c("score") >= recall.ENTITY_SCORE, "entity").otherwise("entity_granule")).join(text, "id", "left")
    parts = [
        s.groupBy("query_id").agg(F.count("*").alias("semantic_count")), e.groupBy("query_id").agg(F.count("*").alias("entity_count")), m.groupBy("query_id").agg(F.count("*").alias("merged_count")),
        stages["named"].groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("entity_ids")),
        _top(s.join(text, "id", "left"), ["id", "score", "granularity", "preview"], TOP_SEEDS, "semantic"), _top(kinds, ["id", "score", "source", "preview"], TOP_SEEDS, "entity"), _top(source, ["id", "score", "source", "preview"], max(config.max_seeds, 1), "merged"),
    ]
    out = _with(out, parts, ["semantic_count", "entity_count", "merged_count"])
    capped = (c("semantic_count") + c("entity_count")) > c("merged_count")
    out = _packed(out, "seed", {n: c(n) for n in ("semantic_count", "entity_count", "merged_count", "entity_ids", "semantic", "entity", "merged")} | {"was_capped": capped})

    steps = traverse.trace_steps(stages["layers"], edges, recall.intent_weights(), config.max_frontier, recall.INTENT_KEY)
    names = ["step", "frontier_in", "considered", "traversed", "by_type", "before_cap", "after_cap", "was_capped", "newly_reached"]
    if steps is not None:
        steps = steps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("steps"), F.sum("traversed").alias("total_traversed")).select("query_id.query_id", "steps", "total_traversed")
    else:
        steps = out.select("query_id").where("false").selectExpr("query_id", "array() AS steps", "0L AS total_traversed")
    out = _with(out, [steps, stages["scores"].groupBy("query_id").agg(F.count("*").alias("nodes_reached"))], ["total_traversed", "nodes_reached"])
    out = _packed(out, "expand", {"steps": c("steps"), "total_traversed": c("total_traversed"), "nodes_reached": c("nodes_reached"), "max_depth": F.lit(config.max_depth), "max_frontier": F.lit(config.max_frontier)})

    seen = stages["scores"].where("score > 0").join(nodes.select("id", F.array_min("labels").alias("label"), F.arrays_overlap("labels", F.array(*[F.lit(x) for x in recall.GRANULES])).alias("granule")), "id")
    counts = seen.groupBy("query_id").agg(F.count_if("granule").alias("granules_considered"))
    dropped = _top(seen.where("NOT granule"), ["id", "label", "score"], TOP_DROPPED, "dropped")
    chosen = _top(stages["passages"].join(text, "id", "left"), ["id", "label", "score", "preview"], 2**31 - 1, "selected")
    out = _packed(_with(out, [counts, dropped, chosen], ["granules_considered"]), "score", {n: c(n) for n in ("granules_considered", "selected", "dropped")} | {"max_passages": F.lit(config.max_passages)})

    kinds = facts.groupBy("query_id", "kind").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("facts_by_kind"), F.sum("n").alias("facts"))
    passages = stages["passages"].groupBy("query_id").agg(F.count("*").alias("passages"))
    return _packed(_with(out, [kinds, passages], ["facts", "passages"]), "assemble", {n: c(n) for n in ("passages", "facts", "facts_by_kind")})


def _with(t: DataFrame, parts: list[DataFrame], counts: list[str]) -> DataFrame:
    for part in parts:
        t = t.join(part, "query_id", "left")
    return t.fillna(0, counts)


def _packed(t: DataFrame, name: str, fields: dict[str, Column]) -> DataFrame:
    keep = [n for n in t.columns if n not in fields and n != name]
    return t.select(*keep, F.struct(*[x.alias(n) for n, x in fields.items()]).alias(name))


def to_dict(value: Any) -> Any:
    """A trace row (or any part) as plain JSON values; numbers that JSON has no form for become null."""
    if isinstance(value, Row):
        return {k: to_dict(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): to_dict(v) for k, v in sorted(value.items())}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_dict(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def to_json(row: Row) -> str:
    return json.dumps(to_dict(row), indent=2, sort_keys=True, ensure_ascii=False)


def _sections(t: dict) -> list[tuple[str, list[str]]]:
    i, s, e, sc, a = (t[k] for k in ("intent", "seed", "expand", "score", "assemble"))
    first = [f"hint: {i['chosen']}"] if i["used_hint"] else [f"{v:+.4f} {k}" + (" (chosen)" if k == i["chosen"] else "") for k, v in sorted((i["scores"] or {}).items(), key=lambda kv: (-kv[1], kv[0]))]
    first.append(f"margin {i['margin']:.4f}, threshold {i['threshold']:.4f}" + (f"; too close, so {i['chosen']}" if i["fell_back"] else ""))
    seeds = [f"{s['semantic_count']} semantic, {s['entity_count']} by entity, {s['merged_count']} merged" + (", capped" if s["was_capped"] else ""), f"entities named: {len(s['entity_ids'] or [])}"]
    seeds += [f"{x['score']:+.3f} {x['source']}: {x['preview']}" for x in s["merged"] or []]
    steps = [f"{e['nodes_reached']} nodes reached, {e['total_traversed']} edges followed"]
    for x in e["steps"] or []:
        by = ", ".join(f"{k['type']} {k['n']}" for k in x["by_type"] or [])
        steps.append(f"step {x['step']}: {x['frontier_in']} in, {x['traversed']} of {x['considered']} edges ({by}), {x['before_cap']} out" + (f", capped to {x['after_cap']}" if x["was_capped"] else "") + f", {x['newly_reached']} new")
    score = [f"{sc['granules_considered']} granules, {len(sc['selected'] or [])} selected"]
    score += [f"{n}. {x['score']:+.3f} {x['label']}: {x['preview']}" for n, x in enumerate(sc["selected"] or [], 1)]
    score += [f"not a granule: {x['score']:+.3f} {x['label']} {x['id']}" for x in sc["dropped"] or []]
    last = [f"{a['passages']} passages, {a['facts']} facts"] + [f"{k}: {n}" for k, n in (a["facts_by_kind"] or {}).items()]
    return [("Intent", first), ("Seeds", seeds), ("Walk", steps), ("Passages", score), ("Assembly", last)]


def to_text(row: Row) -> str:
    """The trace to read, a heading for each stage."""
    t = to_dict(row)
    return "\n".join([f"query {t['query_id']}: {t['query']}", *(line for name, lines in _sections(t) for line in (f"[{name}]", *("  " + x for x in lines)))])


def to_html(row: Row) -> str:
    """The trace as a page of its own."""
    t = to_dict(row)
    body = "".join(f"<section><h2>{html.escape(name)}</h2><ol>" + "".join(f"<li>{html.escape(x)}</li>" for x in lines) + "</ol></section>" for name, lines in _sections(t))
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>Recall of {html.escape(str(t['query_id']))}</title><style>body{{font:14px/1.5 sans-serif;max-width:60em;margin:2em auto}}</style><h1>{html.escape(str(t['query']))}</h1>{body}</html>"
