"""Keys that repeat, keys and headers of any size, columns of other names, and the pipeline on nulls, empty tables and clashing columns."""

import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import langid, media, mixing, pieces, quality, secrets, sharding, simhash, substrings, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def some(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCS)


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(3, 9))) for _ in range(n))


def test_texts_that_share_a_key_are_cut_each_by_itself(spark):
    a, b = prose(1), prose(2)
    got = [(r.doc_id, r.text) for r in substrings.cut_repeats(some(spark, [(1, a, "s"), (2, "new words: " + a, "s"), (2, b, "s"), (3, b + " end", "s")])).collect()]
    texts = Counter(t for k, t in got if k < 3)
    assert {a, b} <= set(texts) and len(got) == 4
    assert all(len(t) < 200 for k, t in got if t.startswith("new words") or t.endswith(" end"))


def test_cutting_repeats_edges(nasty, nothing):
    got = substrings.cut_repeats(nasty)
    assert got.columns == nasty.columns
    want = Counter((r.doc_id, r.text) for r in nasty.where("doc_id <> 5 AND doc_id <> 6 OR doc_id IS NULL").collect())
    assert Counter((r.doc_id, r.text) for r in got.where("doc_id <> 5 AND doc_id <> 6 OR doc_id IS NULL").collect()) == want
    # The long text repeats itself: it shrinks.
    (row,) = got.where("doc_id = 5").collect()
    assert 0 < len(row.text) < 20_000  # of 690,000; chunks of MOST bytes come round after 23 of them
    assert substrings.cut_repeats(nothing).count() == 0


def test_different_texts_under_one_key_stay(spark):
    a = prose(1)
    got = simhash.drop_near_copies(some(spark, [(1, a, "s"), (2, a, "s"), (2, prose(2), "s"), (2, prose(3), "s"), (None, prose(4), "s"), (None, prose(4), "s")]))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (2, prose(2)), (2, prose(3)), (None, prose(4))])


def test_a_hot_group_of_repeated_rows_keeps_one(spark):
    a = prose(1)
    df = some(spark, [(5, a, "s")]).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(5000)))).unionByName(some(spark, [(7, prose(2), "s")]).withColumn("x", F.lit(0)))
    first = min(range(1, 5001), key=lambda x: f"{x}}}")  # of the JSON
    assert [(r.doc_id, r.x) for r in simhash.drop_near_copies(df).orderBy("doc_id").collect()] == [(5, first), (7, 0)]
    assert simhash.groups(df).count() == 0


@pytest.mark.parametrize("segments", [3, 4, 7])
def test_any_number_of_segments_finds_close_copies(spark, segments):
    texts = [prose(k, 400) for k in range(6)]
    df = some(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(10 + k, t + " more", "s") for k, t in enumerate(texts)])
    assert {(r.doc_id, r.group_id) for r in simhash.groups(df, segments=segments).collect()} == {(k + d, k) for k in range(6) for d in (0, 10)}


@pytest.mark.parametrize("rows,segments", [(60, 6), (5000, 6), (5000, 5)])
def test_signatures_as_far_apart_as_allowed_are_linked(spark, rows, segments):
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (rows, 256), np.uint8)
    for k in range(0, rows, 4):
        # Two that differ in the most bits allowed, those of the first signature spread evenly; one by a bit more in either signature.
        bits[k + 1 : k + 4] = bits[k]
        for row, first, second in ((k + 1, 16, 30), (k + 2, 17, 30), (k + 3, 16, 31)):
            bits[row, (np.arange(first) * 128 // first + k) % 128] ^= 1
            bits[row, 128 + r.permutation(128)[:second]] ^= 1
    s = np.packbits(bits, axis=1).view(np.int64)
    signed = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(s)], "id bigint, a bigint, b bigint, c bigint, d bigint")
    root = list(range(rows))
    for i in range(rows):
        far = np.bitwise_count(s[i + 1 :].view(np.uint64) ^ s[i].view(np.uint64))
        for j in np.flatnonzero((far[:, :2].sum(1) <= 16) & (far[:, 2:].sum(1) <= 30)) + i + 1:
            old, new = sorted((root[i], root[j]), reverse=True)
            root = [new if x == old else x for x in root]
    sizes = Counter(root)
    want = {(i, x) for i, x in enumerate(root) if sizes[x] > 1}
    assert len(want) >= rows // 2
    assert {(x.id, x.root) for x in simhash.components(simhash.near_pairs(signed, segments)).collect()} == want


def test_many_near_copies_give_few_links(spark):
    # 3,000 signatures around one: all are linked, and by stars.
    r = np.random.default_rng(0)
    bits = np.repeat(r.integers(0, 2, (1, 256), np.uint8), 3000, axis=0)
    for row in bits:
        row[r.integers(0, 128, 4)] ^= 1
    s = np.unique(np.packbits(bits, axis=1).view(np.int64), axis=0)
    signed = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(s)], "id bigint, a bigint, b bigint, c bigint, d bigint")
    links = simhash.near_pairs(signed)
    assert links.count() <= simhash.FEW_BLOCKS * len(s)
    assert {x.root for x in simhash.components(links).collect()} == {0}


def test_keys_over_all_64_bits_are_sharded(spark):
    rows = [(-(2**63), "a", "s"), (2**63 - 1, "bb", "s"), (0, "ccc", "s"), (None, "dddd", "s")]
    got = {r.doc_id: r for r in sharding.shards(some(spark, rows), 4).collect()}
    assert sorted(r.before for r in got.values())[0] == 0 and len(got) == 4
    assert {r.shard for r in got.values()} == {r.before // 4 for r in got.values()}


def test_shards_are_written_whole_and_in_order(spark, nasty, nothing, tmp_path):
    sharded = sharding.shards(nasty, 1000)
    sharding.write_shards(sharded, str(tmp_path / "a"), hilbert="hilbert_", most_rows=3)
    got = spark.read.parquet(str(tmp_path / "a"))
    assert got.count() == 10 and Counter(r.before for r in got.collect()) == Counter(r.before for r in sharded.collect())
    import pyarrow.parquet as pq

    for f in (tmp_path / "a").rglob("*.parquet"):
        own = pq.read_table(f)["hilbert_"].to_pylist()
        assert own == sorted(own) and len(own) <= 3
    sharding.write_shards(sharding.shards(nothing), str(tmp_path / "b"), hilbert="hilbert_")
    assert not list((tmp_path / "b").rglob("*.parquet"))


def test_a_bad_header_spoils_no_other_file(spark):
    good = media.write_wav(bytes(range(256)) * 4)
    fast = bytearray(good)
    fast[24:28] = struct.pack("<I", 0xFFFFFFFF)
    files = [good, bytes(fast), good[:20], good[:44], b"", b"RIFF", None, bytes(20)]
    wide = bytearray(good)
    wide[34:36] = struct.pack("<H", 40)
    df = spark.createDataFrame([*enumerate([*files, bytes(wide)])], "doc_id int, wav binary")
    got = {r.doc_id: r for r in media.fingerprint_audio(df, "doc_id", "wav").collect()}
    assert (got[0].rate, got[1].rate) == (8000, 0xFFFFFFFF) and got[0].codes == got[1].codes
    assert len(got) == 9 and all(got[i].rate is None for i in (2, 4, 5, 6, 7)) and got[3].codes in (None, [])


def test_mixing_takes_the_lowest_ranks(spark):
    """Against a plain ranking, with rows that repeat at the end of the sample."""
    rows = [(k, "x" * (k % 50 + 1), f"s{k % 3}") for k in range(600)] + [(7, "same text", "s1")] * 200
    weights = {"s0": 5, "s1": 1, "s2": 3}
    df = some(spark, rows)
    got = Counter((r.doc_id, r.text) for r in mixing.mix(df, weights, total=900).collect())
    import hashlib

    want, taken = Counter(), 0
    for name, n in (("s0", 500), ("s1", 100), ("s2", 300)):
        own = [r for r in rows if r[2] == name]
        size = lambda t: len(bin(len(t))) - 2
        all_size = sum(size(t) for _, t, _ in own)
        ranked, rest = [], 0
        for k, t, _ in own:
            want[k, t] += n * size(t) // all_size
            left = n * size(t) % all_size
            rest += left
            if left:
                u = (int(hashlib.md5(f"{mixing.SEED}:{k}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                p = left / all_size
                ranked.append(((u / (1 - u)) * ((1 - p) / p), k, t))
        for _, k, t in sorted(ranked)[: rest // all_size]:
            want[k, t] += 1
        taken += n
    assert got == +want and sum(got.values()) == taken


def test_findings_with_own_owners(spark):
    df = spark.createDataFrame([(i, 'token = "aB3dE5gH7jK9"', f"o{i % 2}", f"r{i}") for i in range(9)], "doc_id bigint, text string, account string, repo string")
    with pytest.raises(ValueError, match="source"):
        secrets.findings(df)
    rows = secrets.scan_secrets(df, owner=F.col("account"), repository=F.col("repo")).collect()
    assert {(r.owners, r.repositories, r.documents, r.verdict) for r in rows} == {(2, 9, 9, "example")}
    one = secrets.scan_secrets(df.withColumn("account", F.lit("o")), owner=F.col("account"), repository=F.col("repo")).collect()
    assert {(r.owners, r.verdict) for r in one} == {(1, "live")}


def test_prose_and_placeholders_are_not_live(spark):
    df = some(spark, [(0, "secret = documentation of the project", "a"), (1, 'password = "your_password_here"', "a"), (2, 'api_key = "<your key here>"', "a"), (3, "token = ${GITHUB_TOKEN}", "a"), (4, 'token = "f00dfacecafe1234"', "a")])
    got = {r.doc_id: r.verdict for r in secrets.scan_secrets(df).collect()}
    assert 0 not in got and got[4] == "live" and {v for k, v in got.items() if k < 4} == {"example"}
    assert {r.doc_id for r in secrets.redact_secrets(df).where("text LIKE '%[SECRET]%'").collect()} == {4}


def test_decoding_nulls_and_bad_ids(spark):
    df = spark.createDataFrame([(1, [500, 501]), (2, None), (3, [500, None]), (4, []), (5, [500] * 300_000)], "k int, token_ids array<int>")
    got = {r.k: r.decoded for r in pieces.decode(df).collect()}
    assert got[2] is None and got[3] is None and got[4] == "" and len(got[5]) > 300_000 and got[1]
    assert pieces.decode(df.where("false")).count() == 0
    with pytest.raises(Exception, match="ids must be"):
        pieces.decode(spark.createDataFrame([(1, [10**6])], "k int, token_ids array<int>")).collect()


def test_fitting_on_nasty_labels(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 0), (6, 1), (5, 0), (7, 1), (99, 1), (None, 0), (2, 1), (3, None), (8, 5)], "doc_id bigint, toxic int")
    assert toxicity.find_toxic(nasty, labels).count() == 10
    assert toxicity.find_toxic(nothing, labels).count() == 0
    kept, weights, bias = toxicity.fit(nasty, labels.where("false"))
    assert len(kept) == len(weights) == 0 and bias == 0
    assert toxicity.find_toxic(nasty, labels.where("toxic = 1")).where("toxicity = 0.5").count() == 7
    languages, _ = langid.fit(nasty)
    assert languages == ["de", "en"]
    got = {r.doc_id: r.language for r in langid.identify(nasty).collect()}
    assert got[2] is None and got[3] is None and got[5] in languages


def test_thresholds_lean_on_wider_groups_by_their_size(spark):
    rows = [("en", "big", "digits", 5, 4000), ("en", "tiny", "digits", 100, 1)]
    got = {r.source: r.threshold for r in quality.thresholds(spark.createDataFrame(rows, "lang string, source string, rule string, bucket int, n bigint")).collect()}
    own = {"big": 10 + 8 * 30, "tiny": 200 + 8 * 30}
    wide = 10 + 8 * 30
    language = (4001 * wide + quality.PRIOR * wide) // (4001 + quality.PRIOR)
    assert got == {s: (n * own[s] + quality.PRIOR * language) // (n + quality.PRIOR) for s, n in (("big", 4000), ("tiny", 1))}


def test_pipeline_edges(spark, nasty, nothing):
    for df in (nasty, nothing):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
            docs = out.cache()
        rows = docs.collect()
        assert all(r.doc_id is not None and r.decoded is not None for r in rows) and (len(rows) > 0) == (df is nasty)
