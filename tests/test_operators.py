import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.config import INGEST_FIELDS, Config, audit
from granary.functions import ids, parse, text
from granary.operators import canonical, derived, diagnostics, graph, ingest, recall, traverse, vectors
from granary.sources import seeds, store
from granary.sources.tables import written


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids_are_those_of_hashlib(spark):
    for value in ["a", "é\"/\\  ", "\\u001F", "\x1f\x0b\x07\n", "\\\\\x1e", None]:
        want = hashlib.sha256(json.dumps({"canonical_form": value, "entity_type": "T", "type": "entity"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]
        assert one(spark, ids.entity_id(F.lit(value).cast("string"), F.lit("T"))) == want, repr(value)
    assert one(spark, ids.memory_id(F.lit(1))) == "4dfa91536e966ddf"


def test_normal_forms(spark):
    for a, b in [("ﬁle", "file"), ("ALICE", "alice"), ("  Bob  ", "bob"), ("STRAẞE", "strasse"), (" É ", "é")]:
        assert one(spark, text.normalize(F.lit(a))) == b
    assert one(spark, text.normalize_spaces(F.lit(" a \t b "))) == "a b"


def test_round_iso(spark):
    for given, to, want in [("2026-01-01T10:30:45.123456Z", "second", "2026-01-01T10:30:45Z"), ("2026-01-01T10:30:45Z", "minute", "2026-01-01T10:30:00Z"), ("2026-01-01T10:30:45Z", "day", "2026-01-01T00:00:00Z"), ("2026-01-01T10:30:45.999+05:30", "minute", "2026-01-01T10:30:00+05:30")]:
        assert one(spark, text.round_iso(F.lit(given), to)) == want
    with pytest.raises(ValueError):
        text.round_iso(F.lit("x"), "millisecond")
    with pytest.raises(Exception, match="no ISO time"):
        one(spark, text.round_iso(F.lit("yesterday")))


def test_key_terms_and_overlap(spark):
    assert one(spark, text.key_terms(F.lit("Paris PARIS paris"))) == ["paris"]
    assert one(spark, text.key_terms(F.lit(""))) == []
    terms = text.key_terms(F.lit("the eiffel tower in Paris"))
    assert one(spark, terms) == ["eiffel", "paris", "tower"]
    found = text.found_terms(terms, F.lit("a towering view"))
    assert one(spark, text.overlap_recall(terms, found)) == pytest.approx(1 / 3)


def test_token_set_ratio():
    assert text.token_set_ratio("dr alice smith", "alice smith") == 100
    assert text.token_set_ratio("", "a") == 0
    assert text.token_set_ratio("alice", "bob") < 50
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(1, 9))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert text._indel(a, b) == pytest.approx(200 * table[-1][-1] / (len(a) + len(b)))


def test_rule_parser_and_extractors():
    doc = parse.RuleParser()("Alice likes green tea. I would not visit Paris!  ")
    assert [s["text"] for s in parse.segments(doc)] == ["Alice likes green tea.", "I would not visit Paris!"]
    assert [m["surface"] for m in parse.mentions(doc)] == ["Alice", "Paris"]
    a, b = parse.claims(doc)
    assert (a["predicate"], a["modality"], a["subject"], a["literal"]) == ("like", "asserted", 0, "green tea")
    assert (b["speaker"], b["modality"], b["object"]) == (True, "negated", 1)
    assert {g["kind"] for g in parse.ngrams(doc)} == {"noun_chunk", "svo"}


def test_canonical_equals_reading_in_order(spark):
    r = random.Random(3)
    words = ["ada", "lane", "kim", "lee", "dr"]
    rows = [(" ".join(r.choices(words, k=r.randrange(1, 4))), r.choice("PQ"), i) for i in range(80)]
    for threshold in (0.6, 0.85):
        listed, want = {"P": [], "Q": []}, {}
        for surface, kind, i in rows:
            m = canonical.best_match(surface, listed[kind], threshold)
            if m is None:
                listed[kind].append(m := surface)
            want[i] = m
        got = canonical.canonicalize(spark.createDataFrame(rows, "surface string, kind string, seq bigint"), threshold)
        assert {x.seq: x.canonical for x in got.collect()} == want


def test_walk_against_plain_code(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.choice(["a", "b", "z"]), r.choice([0.5, 1.0, 0.25, -1.0, 0.0])) for _ in range(60)]
    weights = {"a": 0.5, "b": 1.0, "z": 0.0}
    start = [(q, f"n{q}", 1.0) for q in range(6)] + [(0, "n0", 0.5), (1, "n9", 0.0)]
    for cap in (2, 0):
        want = {}
        for q in range(6):
            best = {"n%d" % q: 1.0}
            at = dict(best)
            for _ in range(3):
                step = {}
                for s, d, t, w in edges:
                    if s in at and weights[t] > 0 and at[s] * w * weights[t] > 0:
                        step[d] = max(step.get(d, 0), at[s] * w * weights[t])
                at = dict(sorted(step.items(), key=lambda x: (-x[1], x[0]))[: cap or None])
                for k, v in at.items():
                    best[k] = max(best.get(k, 0), v)
            want |= {(q, k): v for k, v in best.items()}
        got = traverse.expand(spark.createDataFrame(start, "query_id int, id string, score double"), spark.createDataFrame(edges, "src string, dst string, type string, weight double"), weights, 3, cap)
        assert {(x.query_id, x.id): x.score for x in got.collect()} == want
    with pytest.raises(ValueError):
        traverse.layers(None, None, {}, -1)


def test_knn_blocks_nulls_and_zeros(spark, monkeypatch):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 5))
    v[7] = v[3]
    v[9] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 5), (99, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 16)
    got = {}
    for x in vectors.knn(df, df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.id, x.score))
    n = np.linalg.norm(v, axis=1)
    for q in range(60):
        if q == 9:
            assert q not in got
            continue
        s = sorted((-round(float(v[q] @ v[i] / n[q] / n[i]), 6), i) for i in range(60) if i not in (q, 9))[:4]
        assert [i for i, _ in got[q]] == [i for _, i in s]
    assert vectors.knn(df, df, 0).count() == 0
    assert one(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]


def test_knn_meets_in_parts_and_compares_equal_vectors_once(spark, monkeypatch):
    r = np.random.default_rng(1)
    some = r.normal(size=(9, 3))
    v = [some[i % 9] if i % 3 else r.normal(size=3) for i in range(120)]
    rows = [(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)] + [(5, v[8].tolist(), "a"), (5, v[5].tolist(), "b"), (7, [float("nan")] * 3, "a"), (8, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<float>, label string")
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "PART", 3 * 16)

    def want(query, group, k, own):
        x = np.array(query[1]) / np.linalg.norm(query[1])
        s = [(-round(float(x @ np.array(y) / np.linalg.norm(y)), 6), i) for i, y, g in rows if not np.isnan(y[0]) and (group is None or g == group) and (own or i != query[0])]
        return sorted(s)[:k]

    once = df.where("vec_id NOT IN (5, 7, 8)")
    asked = [x for x in rows if x[0] not in (5, 7, 8)]
    for own in (False, True):
        got, by = {}, {}
        for x in vectors.knn(df, once, 4, keep_self=own).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((-round(x.score, 6), x.id))
        for x in vectors.knn(df, once.drop("label"), 4, same="label", keep_self=own).orderBy("query_id", "rank").collect():
            by.setdefault((x.query_id, x.label), []).append((-round(x.score, 6), x.id))
        for q in asked:
            assert [i for _, i in got[q[0]]] == [i for _, i in want(q, None, 4, own)]
            for g in "ab":
                assert [i for _, i in by[q[0], g]] == [i for _, i in want(q, g, 4, own)]


def test_hubs_give_a_layer_no_more_than_it_can_keep(spark):
    r = random.Random(3)
    edges = [("hub", f"n{r.randrange(400):03}", r.choice("tu"), r.choice([0.25, 0.5, 0.5, 0.5 + 1e-16, 0.1 + r.random() / 9])) for _ in range(900)] + [(f"n{i:03}", "hub", "t", 0.5) for i in range(0, 400, 7)]
    weights, cap = {"t": 0.9, "u": 0.3}, 12
    e = spark.createDataFrame(edges, "src string, dst string, type string, weight double")
    few, many = traverse._bounded(e.withColumnRenamed("weight", "_w"), cap)
    assert few.where("src = 'hub'").isEmpty() and few.count() == len(range(0, 400, 7))
    assert many.count() < 12 * cap
    for q, at in ((1, {"hub": 1.0}), (2, {"hub": 0.3, "n007": 0.7})):
        start, got = list(at.items()), traverse.layers(spark.createDataFrame([(q, k, v) for k, v in at.items()], "query_id int, id string, score double"), e, weights, 3, cap)
        for layer in got[1:]:
            step = {}
            for src, dst, kind, w in edges:
                if src in at:
                    step[dst] = max(step.get(dst, 0), at[src] * w * weights[kind])
            at = dict(sorted(step.items(), key=lambda x: (-x[1], x[0]))[:cap])
            assert {x.id: x.score for x in layer.collect()} == at, start


def test_seeds_and_pairs_of_entities_that_many_share(spark):
    r = random.Random(4)
    e = spark.createDataFrame([(f"t{i:03}", f"e{j}", "mentions") for i in range(90) for j in r.sample(range(9), 4)], "src string, dst string, type string")
    names = [("q1", "e0"), ("q1", "e1"), ("q2", "e3"), *[("q3", f"e{j}") for j in range(9)]]
    named = spark.createDataFrame(names, "query_id string, id string")
    assert recall.entity_seeds(named, e, 8).where("query_id = 'q2' AND score < 1").count() == 8
    few, all_ = (traverse.merge_seeds(recall.entity_seeds(named, e, n), cap=8).collect() for n in (8, 0))
    assert sorted(few) == sorted(all_)
    pairs = [(a, b, r.randrange(1, 4)) for a in range(60) for b in range(a + 1, 60)]
    own = [(1, 0), (1, 1), (2, 59), *[(3, j) for j in range(20, 60)]]
    mine = {}
    for q, i in own:
        rows = [(-n, a, b) for a, b, n in pairs if a == i or (b == i and (q, a) not in own)]
        mine[q, str(i)] = [str(b if a == i else a) for _, a, b in sorted(rows)[:5]]
    labels = spark.range(60).select(F.col("id").alias("id"), F.col("id").cast("string").alias("text"))
    got = {}
    for x in recall.co_occurrence_facts(spark.createDataFrame(own, "query_id int, id bigint"), spark.createDataFrame(pairs, "entity_a bigint, entity_b bigint, count bigint"), labels).collect():
        got.setdefault((x.query_id, x.subject), []).append(x.object)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in mine.items() if v}


def test_graph_tables(spark):
    n = spark.createDataFrame([("a", ["x"], ["l"], 1, 1), ("a", ["y"], None, None, 2), ("b", ["x"], [], 5, 3)], "id string, labels array<string>, layers array<string>, p int, seq int")
    nodes = graph.upsert_nodes(n, ["p"])
    assert {(x.id, tuple(x.labels), tuple(x.layers), x.p) for x in nodes.collect()} == {("a", ("x", "y"), ("l",), 1), ("b", ("x",), (), 5)}
    e = graph.upsert_edges(spark.createDataFrame([("a", "b", "t", 1.0, 1), ("a", "b", "t", 2.0, 2), ("a", "c", "u", 1.0, 3)], "src string, dst string, type string, weight double, seq int"), ["weight"])
    assert {(x.src, x.dst, x.weight) for x in e.collect()} == {("a", "b", 2.0), ("a", "c", 1.0)}
    assert [x.missing for x in graph.missing_endpoints(e, nodes).collect()] == ["c"]
    assert {x.id for x in graph.nodes_by_label(nodes, "x").collect()} == {"a", "b"}
    assert graph.nodes_by_layer(nodes, "l").count() == 1
    assert graph.adjacent(e, spark.createDataFrame([("a",)], "id string"), types=["u"]).count() == 1
    assert graph.cardinality(nodes, e).first().signature == "2:2"


def test_failures(spark):
    nodes = spark.createDataFrame([("1", "paris tower"), ("2", "eiffel"), ("3", "berlin")], "id string, text string")
    edges = spark.createDataFrame([("1", "3")], "src string, dst string")
    rows = [("ok", "paris", [], [], True), ("none", "zzzz", [], [], False), ("gap", "eiffel tower", [], [], False), ("miss", "berlin paris", [], [], False), ("part", "eiffel paris tower", ["paris"], [], False), ("out", "paris", ["paris"], ["x"], False), ("agent", "paris", ["paris"], ["paris"], False), ("empty", "", None, None, None)]
    cases = spark.createDataFrame([(*r, None) for r in rows], "question_id string, gold string, passages array<string>, facts array<string>, judged_correct boolean, bucket string")
    got = {x.question_id: x.kind for x in diagnostics.classify_failures(cases, nodes, edges).collect()}
    assert got == {"ok": "correct", "none": "extraction_miss", "gap": "graph_gap", "miss": "retrieval_miss", "part": "partial_retrieval", "out": "output_miss", "agent": "agent_miss", "empty": "extraction_miss"}
    assert {x.question_id: x.kind for x in diagnostics.classify_failures(cases).collect()}["none"] == "retrieval_miss"
    totals = {(x.bucket, x.kind): x["count"] for x in diagnostics.bucket_breakdown(diagnostics.classify_failures(cases, nodes, edges)).collect()}
    assert totals["(all)", "(all)"] == 8 and totals["(none)", "correct"] == 1


def test_config(spark):
    a, b = Config(), Config(min_tokens=1)
    assert a.ingest_fingerprint != b.ingest_fingerprint and a.recall_fingerprint != b.recall_fingerprint
    assert Config(max_depth=1).ingest_fingerprint == a.ingest_fingerprint
    assert a.result_fingerprint("q") != a.result_fingerprint("q", now="x")
    assert {x.field for x in audit(spark, a, b).where("NOT same").collect()} == {"min_tokens", "ingest_fingerprint", "recall_fingerprint"}
    assert len(INGEST_FIELDS) == 10


def _graph(spark, df, config, known=None, start=0):
    m = ingest.number_memories(df, F.lit(0), ["seq"], start)
    return tuple(map(written, ingest.ingest(ingest.parse_memories(m, config), config, known)))


def test_ingest_store_and_recall(spark, tmp_path):
    config = Config()
    rows = [(0, "Alice likes green tea. Alice met Bob.", "2026-01-01T10:00:00Z", "alice"), (1, "I visited Paris.", "2026-01-01T11:00:00Z", "bob"), (2, "Alice likes green tea.", None, None), (3, None, "", "")]
    df = spark.createDataFrame([(*r, "s", [("k", "v")]) for r in rows], "seq int, content string, timestamp string, speaker string, source string, metadata array<struct<k:string,v:string>>")
    n, e = _graph(spark, df, config)
    nodes, edges = written(graph.upsert_nodes(n, list(ingest.PAYLOADS))), written(graph.upsert_edges(e))
    assert graph.missing_endpoints(edges, nodes).count() == 0
    counts = {(x.part, x.name): x["count"] for x in diagnostics.coverage(nodes, edges).collect()}
    assert counts["label", "memory"] == counts["label", "turn"] == 4 and counts["label", "time_anchor"] == 2
    assert counts["label", "entity"] == 6  # Alice, Bob, Paris; speakers alice, bob and the anonymous one
    # Two batches give the graph of one.
    first, second = df.where("seq < 2"), df.where("seq >= 2")
    n1, e1 = _graph(spark, first, config)
    old = written(graph.upsert_nodes(n1, list(ingest.PAYLOADS)))
    n2, e2 = _graph(spark, second, config, store.known_forms(old), 2)
    both = graph.upsert_nodes(n1.unionByName(n2), list(ingest.PAYLOADS))
    assert both.exceptAll(nodes).count() == nodes.exceptAll(both).count() == 0
    both = graph.upsert_edges(e1.unionByName(e2))
    assert both.exceptAll(edges).count() == edges.exceptAll(both).count() == 0
    index = {k: written(v) for k, v in derived.rebuild(nodes, edges).items()}
    assert {x["count"] for x in index["reinforcement"].where("kind = 'claim'").collect()} == {1, 2}
    store.save(str(tmp_path / "g"), nodes, edges, config, ingest.embed_granules(nodes), index)
    got = store.load(spark, str(tmp_path / "g"), config)
    assert got["nodes"].count() == nodes.count() and set(got["derived"]) == set(store.DERIVED)
    with pytest.raises(ValueError, match="another ingest"):
        store.load(spark, str(tmp_path / "g"), Config(seed=1))
    queries = spark.createDataFrame([("q", parse.HashEmbedder()("green tea").tolist(), "single_fact"), ("z", [0.0] * 64, None)], "query_id string, vec array<float>, hint string")
    said = spark.createDataFrame([("q", "ALICE", "NAME")], "query_id string, surface string, kind string")
    passages, facts = recall.recall(queries, got["nodes"], got["edges"], got["vectors"], got["derived"], said, config)
    passages = passages.orderBy("rank").collect()
    assert passages and all(p.query_id == "q" and p.source_memory_id for p in passages) and "green tea" in passages[0].text
    assert [f.value for f in facts.collect()] == ["2 observations at 2026-01-01T10:00:00Z"]
    with pytest.raises(Exception, match="unknown intent"):
        recall.resolve_intents(queries.withColumn("hint", F.lit("x")), None, config).collect()


def test_seeds_and_margins(spark):
    embed = F.udf(lambda s: parse.HashEmbedder()(s).tolist(), "array<float>")
    for classes in (seeds.POLARITIES, seeds.INTENTS):
        cents = vectors.centroids(seeds.sentences(spark, classes).withColumn("vec", embed("text")))
        held = seeds.sentences(spark, classes, heldout=True).withColumn("vec", embed("text")).withColumn("vec_id", F.monotonically_increasing_id())
        margins = vectors.median_margins(held, cents, label="class")
        assert vectors.enabled_classes(margins, 0.05).count() == len(classes)
    assert seeds.synthetic_memories(spark, 10).where("content LIKE '%{}%'").count() == 0


def test_traces_and_preference_facts(spark):
    edges = spark.createDataFrame([("a", "b", "t", 0.5), ("b", "c", "t", 0.5), ("a", "c", "u", 0.0)], "src string, dst string, type string, weight double")
    start = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, score double")
    steps = traverse.trace_steps(traverse.layers(start, edges, {"t": 1.0}, 2), edges, {"t": 1.0}).orderBy("step").collect()
    assert [(x.step, x.frontier_in, x.considered, x.traversed, [(y.type, y.n) for y in x.by_type], x.before_cap, x.after_cap, x.was_capped, x.newly_reached) for x in steps] == [(1, 1, 2, 1, [("t", 1)], 1, 1, False, 1), (2, 1, 1, 1, [("t", 1)], 1, 1, False, 1)]
    scores = traverse.expand(start, edges, {"t": 1.0}, 2)
    labels = spark.createDataFrame([("a", "entity"), ("b", "turn"), ("c", "turn")], "id string, label string")
    best = recall.top_passages(scores, labels, 1)
    held = spark.createDataFrame([("s", "p", "holds_preference", "b")], "src string, dst string, type string, source_turn_id string")
    index = spark.createDataFrame([("h", "literal:tea", "likes", "p", "2026")], "holder_id string, target_key string, polarity string, preference_id string, asserted_at string")
    prefs = spark.createDataFrame([("p", "mara", "tea")], "preference_id string, subject string, object string")
    assert recall.current_preference_facts(best, held, index, prefs).count() == 0
    (fact,) = recall.current_preference_facts(best, held, index, prefs, by_turn=True).collect()
    assert (fact.subject, fact.predicate, fact.object, fact.value) == ("mara", "likes", "tea", "likes tea as of 2026")


def test_similar_forms_are_found_without_comparing_all():
    r = random.Random(9)
    forms = list({" ".join("".join(r.choices("abcdeß", k=r.randrange(1, 9))) for _ in range(r.randrange(1, 4))) for _ in range(300)}) + ["x" * 300, "x" * 299 + "y", "ab " * 200]
    for threshold in (0.5, 0.85, 1.0):
        listed = canonical.Listed(threshold)
        for i, f in enumerate(forms):
            want = {(x, j) for j, x in enumerate(forms[:i]) if text.token_set_ratio(f, x) >= 100 * threshold}
            assert {(x, j) for _, x, j in listed.similar(f)} == want
            listed.add(f, i)


def test_short_forms_are_looked_up(monkeypatch):
    compared = []
    ratio = text.token_set_ratio
    monkeypatch.setattr(canonical, "token_set_ratio", lambda a, b: compared.append(1) or ratio(a, b))
    listed, forms = canonical.Listed(0.85), ["".join(x) for x in itertools.permutations("abcdefg")][::5]
    for i, f in enumerate(forms):
        listed.similar(f)
        listed.add(f, i)
    assert len(compared) < 25 * len(forms)


def test_gaps_are_settled_by_few_nodes_or_by_all(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "FEW", 1)
    r = random.Random(2)
    hits = [(case, r.randrange(30)) for case in range(40) for _ in range(r.randrange(1, 9))]
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    got = diagnostics.graph_gaps(spark.createDataFrame(hits, "case_id int, id int"), spark.createDataFrame(edges, "src int, dst int"))
    of = {case: {i for c, i in hits if c == case} for case, _ in hits}
    want = {(case, len(ids_), len(ids_) >= 2 and not any(a in ids_ and b in ids_ for a, b in edges)) for case, ids_ in of.items()}
    assert {tuple(x) for x in got.collect()} == want and len({gap for _, _, gap in want}) == 2


def test_kinds_of_nodes_change_nothing_but_what_is_read(spark):
    edges = [("o:1", "c:1", "t", 0.5), ("o:1", None, "t", 0.5), ("c:1", "n:1", "t", 0.5), ("n:1", "o:1", "t", 0.5), ("s:1", "n:1", "t", 0.5)]
    e = spark.createDataFrame(edges, "src string, dst string, type string, weight double")
    start = spark.createDataFrame([(1, "o:1", 1.0), (2, "x", 1.0)], "query_id int, id string, score double")
    walk = traverse.layers(start, e, {"t": 1.0}, 3, 4)
    assert {tuple(x) for x in traverse.best_of(walk).collect()} == {(1, "o:1", 1.0), (2, "x", 1.0), (1, "c:1", 0.5), (1, None, 0.5), (1, "n:1", 0.25)}
    assert traverse.kinds_of(e, "dst") == {"c:", "n:", "o:", ""}
