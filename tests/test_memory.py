"""The facade: batches, answers, traces, snapshots, streams."""

import json

import pytest
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import parse
from granary.memory import FrozenError, Memory
from granary.operators import diagnostics, graph, ingest, recall, trace, vectors
from granary.sources import seeds, store

MEMORIES = "seq int, content string, timestamp string, speaker string, source string, metadata array<struct<k:string,v:string>>"
ROWS = [(0, "Alice likes green tea. Alice met Bob.", "2026-01-01T10:20:30Z", "alice"), (1, "I visited Paris.", "2026-01-01T11:00:00Z", "bob"), (2, "Alice likes green tea.", "2026-01-02T10:00:00Z", "bob"), (3, None, "", ""), (4, "I like rain. Alice met Bob.", "2026-01-03T00:00:00Z", "bob")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", [("k", "v")]) for r in rows], MEMORIES)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("memory")), Config(anchor_resolution="hour"))
    m.ingest(table(spark, ROWS[:2]), ["seq"])
    m.ingest(table(spark, ROWS[2:]), ["seq"])
    return m


def test_batches_give_the_graph_of_one(spark, filled, tmp_path):
    whole = Memory(spark, str(tmp_path / "m"), filled.config)
    whole.ingest(table(spark), ["seq"])
    a, b = whole.state(), filled.state()
    for name in ("nodes", "edges"):
        assert a[name].exceptAll(b[name]).count() == b[name].exceptAll(a[name]).count() == 0
    assert {(r.node_id, r.granularity) for r in a["vectors"].collect()} == {(r.node_id, r.granularity) for r in b["vectors"].collect()}
    assert b["manifest"]["memories"] == 5


def test_answers_have_context_support_and_facts(filled):
    result, passages, facts = filled.ask("Alice likes green tea", hint="single_fact")
    assert result.intent == "single_fact" and result.confidence == 1.0 and len(result.recall_fingerprint) == 16
    top = passages[0]
    assert top.granularity in ("turn", "sentence", "ngram") and top["rank"] == 1
    turn = next(p for p in passages if p.granularity == "turn" and p.source_memory_index == 1)
    # The time of the anchor, not of the memory; subjects by name.
    assert (turn.timestamp, turn.speaker) == ("2026-01-01T10:00:00Z", "alice")
    assert turn.supporting_edges == ["alice like(green tea)", "alice meet(bob)"]
    told = {(f.kind, f.subject, f.predicate, f.object): f for f in facts}
    tea = told["reinforcement", "alice", "like", "green tea"]
    ids = {r.memory_index: r.id for r in filled.state()["nodes"].where("memory IS NOT NULL").select("id", "memory.memory_index").collect()}
    assert tea.value == "2 observations between 2026-01-01T10:20:30Z and 2026-01-02T10:00:00Z" and tea.supporting_memory_ids == sorted([ids[1], ids[3]])
    assert [f["rank"] for f in facts] == list(range(1, len(facts) + 1))


def test_pairs_are_told_from_the_side_that_was_asked_for(filled):
    _, _, facts = filled.ask("How often did Bob come up", hint="aggregation")
    (fact,) = [f for f in facts if f.kind == "co_occurrence"]
    assert (fact.subject, fact.predicate, fact.object, fact.value) == ("bob", "co_occurs_with", "alice", "2 shared memories")


def test_arguments_bound_and_identify_an_answer(filled):
    one, passages, _ = filled.ask("green tea", max_passages=1)
    assert len(passages) == 1
    assert filled.ask("green tea", max_passages=0)[1] == []
    assert one.recall_fingerprint != filled.ask("green tea", max_passages=1, now="2026-02-02T00:00:00Z")[0].recall_fingerprint
    assert one.recall_fingerprint == filled.ask("green tea", max_passages=1)[0].recall_fingerprint
    with pytest.raises(ValueError, match="hint"):
        filled.ask("x", hint="nonsense")


def test_an_empty_memory_answers_nothing(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    result, passages, facts = m.ask("anything")
    assert result.intent in recall.INTENTS and passages == [] and facts == []
    assert m.trace(spark.createDataFrame([("q", "anything")], "query_id string, text string")).count() == 1


def test_freeze_and_reset(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.ingest(table(spark), ["seq"])
    m.freeze()
    with pytest.raises(FrozenError):
        m.ingest(table(spark), ["seq"])
    with pytest.raises(FrozenError):
        m.reset()
    assert m.ask("green tea")[1]
    again = Memory(spark, m.path)
    again.reset()
    assert again.state()["nodes"].count() == 0
    again.ingest(table(spark, ROWS[:1]), ["seq"])
    assert again.state()["manifest"]["memories"] == 1


def test_traces_count_and_render(spark, filled):
    row = filled.trace(spark.createDataFrame([("q", "Did Alice <b> like green tea")], "query_id string, text string"), hint="preference").first()
    t = json.loads(trace.to_json(row))
    assert t["intent"]["used_hint"] and t["intent"]["chosen"] == "preference" and set(t["intent"]["scores"]) == set(recall.INTENTS)
    assert t["seed"]["merged_count"] == len(t["seed"]["merged"]) and len(t["seed"]["entity_ids"]) == 1
    assert {s["source"] for s in t["seed"]["entity"]} == {"entity", "entity_granule"} and {s["source"] for s in t["seed"]["merged"]} <= {"semantic", "entity", "both"}
    steps = t["expand"]["steps"]
    assert [s["step"] for s in steps] == list(range(1, len(steps) + 1)) and steps[0]["frontier_in"] == t["seed"]["merged_count"]
    assert all(s["traversed"] == sum(k["n"] for k in s["by_type"]) <= s["considered"] and s["after_cap"] <= s["before_cap"] for s in steps)
    assert t["expand"]["total_traversed"] == sum(s["traversed"] for s in steps) and t["expand"]["nodes_reached"] == t["seed"]["merged_count"] + sum(s["newly_reached"] for s in steps)
    assert len(t["score"]["selected"]) == t["assemble"]["passages"] and all(d["label"] not in recall.GRANULES for d in t["score"]["dropped"])
    assert t["assemble"]["facts"] == sum((t["assemble"]["facts_by_kind"] or {}).values())
    text, page = trace.to_text(row), trace.to_html(row)
    assert all(f"[{n}]" in text and f"<h2>{n}</h2>" in page for n in ("Intent", "Seeds", "Walk", "Passages", "Assembly"))
    assert "<b>" in text and "<b>" not in page
    assert trace.to_dict({"x": float("nan"), "y": (1, {2})}) == {"x": None, "y": [1, [2]]}


def test_previews(spark):
    rows = [("x" * 160,), ("x" * 161,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(trace.preview("t")).collect()]
    assert got == ["x" * 160, "x" * 160 + "…", None]


def test_derived_tables_follow_the_graph(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.ingest(table(spark, ROWS[:1]), ["seq"])
    assert m.state()["derived"] == {} and set(m.derived()) == set(store.DERIVED)
    first = m.state()["manifest"]["derived_fingerprint"]
    assert Memory(spark, m.path).state()["derived"]
    m.ingest(table(spark, ROWS[2:3]), ["seq"])
    assert m.state()["derived"] == {}
    counts = {r["count"] for r in m.derived()["reinforcement"].where("kind = 'claim'").collect()}
    assert 2 in counts and m.state()["manifest"]["derived_fingerprint"] != first


def test_a_crash_leaves_the_snapshot_before(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.ingest(table(spark, ROWS[:1]), ["seq"])
    name = m.state()["manifest"]["snapshot"]
    (tmp_path / "m" / "manifests" / "000000000099").mkdir()
    assert Memory(spark, m.path).state()["manifest"]["snapshot"] == name


def test_bad_snapshots_raise(spark, tmp_path):
    config = Config(dimension=2)
    empty = Memory(spark, str(tmp_path / "none"), config).state()
    nodes = spark.createDataFrame([("a", ["turn"], [])], "id string, labels array<string>, layers array<string>").join(empty["nodes"].drop("labels", "layers"), "id", "left").select(empty["nodes"].columns)
    edge = spark.createDataFrame([("a", "b", "t", 1.0, None, None, None, None)], empty["edges"].schema)
    with pytest.raises(ValueError, match="no node"):
        store.save(str(tmp_path / "a"), nodes, edge, config)
    for rows, fault in (([("a", "turn", [1.0])], "dimension"), ([("a", "word", [1.0, 0.0])], "granularity"), ([("a", "turn", [1.0, 0.0])] * 2, "repeated")):
        with pytest.raises(ValueError, match=fault):
            store.save(str(tmp_path / "b"), nodes, empty["edges"], config, spark.createDataFrame(rows, "node_id string, granularity string, vec array<float>"))
    with pytest.raises(store.StoreError, match="no manifest"):
        store.load(spark, str(tmp_path / "a"))
    store.save(str(tmp_path / "c"), nodes, empty["edges"], config)
    with pytest.raises(store.StoreError, match="another ingest"):
        store.load(spark, str(tmp_path / "c"), Config(dimension=3))
    (manifest,) = (tmp_path / "c" / "manifests" / "000000000001").glob("part-*")
    text = manifest.read_text()
    for new, fault in ((text.replace('"memories"', '"others"'), "fields"), ("{", "JSON"), (text.replace("1:0", "9:9"), "sizes"), (text.replace('"graph": 4', '"graph": 1'), "versions")):
        for f in manifest.parent.glob(".*.crc"):
            f.unlink()
        manifest.write_text(new)
        with pytest.raises(store.StoreError, match=fault):
            store.load(spark, str(tmp_path / "c"), config)


def test_a_stream_builds_the_graph(spark, filled, tmp_path):
    from granary.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    for k, part in enumerate((ROWS[:2], ROWS[2:])):
        table(spark, part).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (f,) = (tmp_path / f"part{k}").glob("part-*")
        f.rename(tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(MEMORIES).parquet(str(tmp_path / "in"))
        m = Memory(spark, str(tmp_path / "m"), filled.config)
        ingest_stream(stream, m, str(tmp_path / "checkpoint"), ["seq"]).awaitTermination()
    a, b = m.state(), filled.state()
    assert a["nodes"].exceptAll(b["nodes"]).count() == b["nodes"].exceptAll(a["nodes"]).count() == 0
    m.ingest(table(spark), ["seq"], batch=1)
    assert m.state()["manifest"]["memories"] == 5


def test_polarities_by_classifier(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), classify=True)
    rows = [(0, "I want green tea. I like green tea very much.", "2026-01-01T00:00:00Z", "ada")]
    m.ingest(table(spark, rows), ["seq"])
    embed = parse.HashEmbedder()
    cents = {}
    for name, template in seeds.POLARITIES.items():
        v = sum(embed(template.format(x)).astype(float) for x in seeds._THINGS)
        cents[name] = v / (v @ v) ** 0.5
    want = set()
    for text in ("I want green tea.", "I like green tea very much."):
        v = embed(text).astype(float)
        best, second = sorted((-round(float(v @ c / (v @ v) ** 0.5), 6), n) for n, c in cents.items())[:2]
        if round(second[0] - best[0], 6) >= m.config.polarity_margin:
            want.add(best[1])
    got = {r.polarity for r in m.state()["nodes"].where("preference IS NOT NULL").select("preference.polarity").collect()}
    assert got == want and want


def test_failures_against_a_graph(spark, filled):
    queries = spark.createDataFrame([("q1", "green tea"), ("q2", "zebra")], "query_id string, text string")
    _, passages, facts = filled.recall(queries, hint="single_fact")
    gold = [("q1", "green tea", False), ("q2", "xylophone", False), ("q3", "turn", False), ("q4", "green tea", True)]
    cases = spark.createDataFrame([(*g, "b") for g in gold], "question_id string, gold string, judged_correct boolean, bucket string")
    s = filled.state()
    got = {r.question_id: (r.kind, r.place) for r in diagnostics.classify_recall(cases, passages, facts, s["nodes"], s["edges"]).collect()}
    # 'turn' is in the graph only as a label, of nodes that no edge joins.
    assert {k: v[0] for k, v in got.items()} == {"q1": "agent_miss", "q2": "extraction_miss", "q3": "graph_gap", "q4": "correct"}
    assert [got[q][1] for q in ("q1", "q2", "q3", "q4")] == [1, 2, 3, 4]


def test_graph_reads(spark, filled):
    s = filled.state()
    hay = {r.id: r.text for r in graph.haystack(s["nodes"]).collect()}
    memory = s["nodes"].where("memory.memory_index = 1").first().id
    assert "green tea" in hay[memory] and "memory" in hay[memory] and "k\nv" in hay[memory]
    ends = s["edges"].select("src", "dst", "type").limit(1).unionByName(spark.createDataFrame([("x", "y", "t")], "src string, dst string, type string"))
    assert sorted(r.there for r in graph.has_edge(s["edges"], ends).collect()) == [False, True]
    one = spark.createDataFrame([(memory,)], "id string")
    assert [tuple(r.labels) for r in graph.labels_of(s["nodes"], one).collect()] == [("memory",)]
    turn = graph.adjacent(s["edges"], one, "dst", ["part_of"]).select(F.col("src").alias("id"))
    (vec,) = vectors.points(s["vectors"], turn).collect()
    assert vec.granularity == "turn" and len(vec.vec) == filled.config.dimension
    assert {r.kind for r in filled.find(" ALICE ").collect()} == {"NAME", "SPEAKER"}
    assert store.fixture_hash(seeds.POLARITIES) != store.fixture_hash(seeds.POLARITIES, seeds.INTENTS)


def test_embedders_get_batches(spark):
    class Batched(parse.HashEmbedder):
        def __call__(self, text):
            raise AssertionError

    df = spark.createDataFrame([("a", "green tea"), ("b", None), ("c", "")], "id string, text string")
    got = {r.id: r.vec for r in ingest.embed_texts(df, Batched(8), 8).collect()}
    assert got["b"] == got["c"] == [0.0] * 8 and sum(x * x for x in got["a"]) == pytest.approx(1)
    with pytest.raises(Exception, match="embedder gave"):
        ingest.embed_texts(df, Batched(8), 9).collect()
