"""Near-duplicate groups by SimHash, with an exact join of the signatures.

A document's signature has 128 bits: the signs of the sums of its words' random bits, weighted by (times the word
occurs) ^ 0.75. Two documents are near copies where their signatures differ in at most MOST_BITS bits, and their second ones, in
which each distinct word counts once, in at most MOST_SET_BITS. Groups are the connected components of all such pairs.

The signatures are dealt to blocks by hash, and each pair of blocks is joined by itself in numpy. A signature is cut into
SEGMENTS segments, each with a radius; the radii are such that signatures that differ by more than the radius in every segment differ
in more than MOST_BITS bits. So those of one block are looked up in a table of the other's segment values, with each choice
of at most so many bits turned over, and all that meet are verified: none is missed. Where there are more such choices than
signatures, each is compared with all.

Of what a pair of blocks links only a star a group is passed on, and values whose holders are in the group of who
looks them up are skipped, so a thousand copies give a thousand links, not half a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut_lineage, fresh, mix64, need, text_slices, words

SEGMENTS = 6
MOST_BITS, MOST_SET_BITS = 16, 30
POWER = 0.75
#: A block has about so many signatures at most, and where there are few signatures, so many blocks keep the cores busy.
BLOCK, FEW_BLOCKS = 1 << 18, 8
#: A table of segment values has at most 2 ^ TABLE_BITS places; so many pairs are verified at once.
TABLE_BITS, PAIRS = 22, 1 << 18


def _bits(hashes: np.ndarray) -> np.ndarray:
    """128 random signs (1 or -1) of each word hash."""
    with np.errstate(over="ignore"):
        pair = np.stack([hashes, mix64(hashes ^ U64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(np.ascontiguousarray(pair).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted signatures, set signatures, number of words) of the texts; a signature is two 64-bit integers."""
    out = np.zeros((len(texts), 2, 128), bool)
    counts = np.zeros(len(texts), np.int64)
    for lo, part in text_slices(texts):
        h, offsets = words(part)
        counts[lo : lo + len(part)] = np.diff(offsets)
        for i in range(len(part)):
            own, n = np.unique(h[offsets[i] : offsets[i + 1]], return_counts=True)
            total = np.zeros((2, 128))
            for k in range(0, len(own), 4096):
                # Whole-number weights: their sums are exact, in any order.
                w = np.stack([np.floor(16 * n[k : k + 4096] ** POWER + 0.5), np.ones(len(n[k : k + 4096]))]).astype(np.float32)
                total += w @ _bits(own[k : k + 4096])
            out[lo + i] = total > 0
    packed = np.packbits(out, axis=2).view(np.int64)
    return packed[:, 0], packed[:, 1], counts


def sign(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, a, b, c, d): a hash of the text, its weighted signature (a, b) and its set signature (c, d), of every row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weighted, plain, n = signatures(batch.column(2))
            keep = pa.array(n > 0)
            columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(s[:, i])) for s in (weighted, plain) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["id", "h", "a", "b", "c", "d"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.xxhash64(text).alias("h"), F.col(text)).mapInArrow(run, f"id {kind}, h bigint, a bigint, b bigint, c bigint, d bigint")


def cuts(segments: int = SEGMENTS) -> list[int]:
    """Where ``segments`` segments of like size begin and end in the 128 bits."""
    if not 3 <= segments <= 16:
        raise ValueError("there must be 3 to 16 segments")
    return [0, *np.cumsum([128 // segments + (i < 128 % segments) for i in range(segments)]).tolist()]


def radii(segments: int = SEGMENTS) -> list[int]:
    """In how many bits values of each segment may differ to meet; the numbers beyond them sum to more than MOST_BITS."""
    total = MOST_BITS - segments + 1
    return [total // segments + (i < total % segments) for i in range(segments)]


def _values(s: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo to hi (without it) of the 128 bits of (a, b), the first two rows of ``s``, the highest of a being bit 0."""
    mask = U64((1 << (hi - lo)) - 1)
    if hi <= 64 or lo >= 64:
        return (s[0 if hi <= 64 else 1] >> U64(-hi % 64)) & mask
    return ((s[0] << U64(hi - 64)) | (s[1] >> U64(128 - hi))) & mask


def _near(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of columns of ``s`` that are near copies."""
    for rows, most in (((0, 1), MOST_BITS), ((2, 3), MOST_SET_BITS)):
        keep = np.flatnonzero(sum(np.bitwise_count(s[r][i] ^ s[r][j]) for r in rows) <= most)
        i, j = i[keep], j[keep]
    return i, j


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the groups of each pair (i, j) one label: the lowest place in the group."""
    while True:
        p, q = label[i], label[j]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def link(s: np.ndarray, n: int, segments: int = SEGMENTS) -> np.ndarray:
    """For each column of ``s`` (rows a, b, c, d) the lowest one that it is linked to by near copies among the first ``n`` and the others, or, where there are no others, among all."""
    whole = s.shape[1]
    label, first = np.arange(whole), 0 if n == whole else n
    at, most = cuts(segments), radii(segments)
    if sum(comb(hi - lo, k) for lo, hi, r in zip(at, at[1:], most) for k in range(r + 1)) >= whole - first:
        other = np.arange(first, whole)
        for i in range(n):
            _merge(label, *_near(s, np.full(len(other), i), other))
        return label
    for lo, hi, radius in zip(at, at[1:], most):
        bits = min(hi - lo, TABLE_BITS, (whole - first).bit_length() + 6)
        fold = lambda v: (v ^ (v >> U64(bits)) ^ (v >> U64(2 * bits)) ^ (v >> U64(3 * bits))) & U64((1 << bits) - 1)  # noqa: E731 B023
        v = fold(_values(s, lo, hi)).astype(np.int64)
        # All of a value are held against one of them first.
        order = np.argsort(v, kind="stable")
        new = np.flatnonzero(np.diff(v[order], prepend=-1))
        _merge(label, *_near(s, np.repeat(order[new], np.diff(new, append=whole)), order))
        # The table: place of each value of the others, and from where to where in ``order`` its holders are.
        order = first + np.argsort(v[first:], kind="stable")
        start = np.flatnonzero(np.diff(v[order], prepend=-1))
        size = np.diff(start, append=len(order))
        place = np.full(1 << bits, -1, np.int32)
        place[v[order[start]]] = np.arange(len(start))
        groups = _one_group(label, order, start)
        mine, held, pending = v[:n], [], 0
        for turned in (c for k in range(radius + 1) for c in combinations(range(hi - lo), k)):
            p = place[mine ^ int(fold(U64(sum(1 << b for b in turned))))]
            i = np.flatnonzero(p >= 0)
            p = p[i]
            keep = np.flatnonzero(groups[p] != label[i])
            i, p = i[keep], p[keep]
            held.append((i, p))
            pending += int(size[p].sum())
            if pending >= PAIRS:
                _verify(s, label, held, order, start, size)
                groups, held, pending = _one_group(label, order, start), [], 0
        _verify(s, label, held, order, start, size)
    return label


def _one_group(label: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The label of all holders of each value, or -1 where they have several."""
    low, high = (f.reduceat(label[order], start) for f in (np.minimum, np.maximum))
    return np.where(low == high, low, -1)


def _verify(s: np.ndarray, label: np.ndarray, held: list, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Merge the groups of those columns i and holders of the values p that are near copies, for all (i, p) in ``held``."""
    if not held:
        return
    i, p = (np.concatenate(x) for x in zip(*held))
    ends = np.cumsum(size[p])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
        n = size[p[lo:hi]]
        j = order[np.repeat(start[p[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        k = np.repeat(i[lo:hi], n)
        keep = np.flatnonzero(label[k] != label[j])
        _merge(label, *_near(s, k[keep], j[keep]))
        lo = hi


def near_pairs(signed: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(x, y): links (id) that connect the near-duplicate groups among rows (id, a, b, c, d) with distinct signatures: all that near copies connect, and no more.

    ``segments`` says how near copies are looked for, not which are found.
    """
    cuts(segments)
    rows = signed.count()
    blocks = max(1, -(-rows // BLOCK), min(FEW_BLOCKS, -(-rows // (BLOCK >> 6))))
    mine, other = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = signed.select("id", "a", "b", "c", "d", mine.cast("int").alias("mine"), other.alias("other"))
    task = (F.least("mine", "other") * blocks + F.greatest("mine", "other")).alias("task")
    placed = placed.select(task, (F.col("mine") > F.col("other")).alias("second"), "id", "a", "b", "c", "d").repartition(blocks * (blocks + 1) // 2, "task")

    def run(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        order = np.argsort(second, kind="stable")
        s = np.stack([table[x].to_numpy().view(np.uint64)[order] for x in "abcd"])
        # Where one of two blocks is empty, there is nothing to link.
        n, pair = int(len(second) - second.sum()), int(table["task"][0].as_py())
        label = link(s, n, segments) if n and (n < len(second) or pair // blocks == pair % blocks) else np.arange(len(second))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"x": table["id"].take(pa.array(order[linked])), "y": table["id"].take(pa.array(order[label[linked]]))})

    kind = signed.schema["id"].dataType.simpleString()
    out = placed.groupBy("task").applyInArrow(run, f"x {kind}, y {kind}")
    return out.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id of ``edges`` (x < y) with the lowest id that it is connected to.

    Each round links all neighbours of a node to the lowest of them, first those above the node, then those below; the
    number of rounds grows with the logarithm of the longest path. Rounds end when the edges no longer change.
    """
    edges = cut_lineage(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = Window.partitionBy("x")
        # Large star: every neighbour above x goes to the lowest of x and its neighbours.
        large = both.withColumn("to", F.least("x", F.min("y").over(low))).where("y > x").select(F.col("to").alias("x"), "y").where("x < y").distinct()
        # Small star: every neighbour below y, and y itself, goes to the lowest of them.
        small = large.withColumn("to", F.min("x").over(Window.partitionBy("y")))
        edges = small.select(F.col("to").alias("l"), F.explode(F.array("x", "y")).alias("h")).where("l < h").select(F.col("l").alias("x"), F.col("h").alias("y")).distinct()
        edges = cut_lineage(edges)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges.groupBy(F.col("y").alias("id")).agg(F.min("x").alias("root")).unionByName(edges.select(F.col("x").alias("id"), F.col("x").alias("root")).distinct())
        seen = state


def _signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, a, b, c, d, rows): the distinct documents, each a key and a text, and how many rows each has."""
    return cut_lineage(sign(df, key, text).groupBy("id", "h", "a", "b", "c", "d").agg(F.count("*").alias("rows")))


def _grouped(signed: DataFrame, segments: int) -> DataFrame:
    """(id, h, rows, root): the documents that have a near or exact copy; root is one for all of a group."""
    at = ["a", "b", "c", "d"]
    # The nodes are the distinct signatures; their numbers are written with them.
    name = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    same = signed.groupBy(*at).agg(F.min(name).alias("name"), F.count("*").alias("documents"))
    same = cut_lineage(same.withColumn("node", F.monotonically_increasing_id()))
    near = components(near_pairs(same.select(F.col("node").alias("id"), *at), segments)).select(F.col("id").alias("node"), "root")
    same = same.join(near, "node", "left").where("root IS NOT NULL OR documents > 1").withColumn("root", F.coalesce("root", "node"))
    # The root of a group is its lowest document.
    lowest = same.groupBy("root").agg(F.min("name").alias("lowest"))
    same = same.join(lowest, "root").select(*at, F.col("lowest").alias("root"))
    return signed.join(same, at).select("id", "h", "rows", "root")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, group_id): every document that has a near or exact copy, with the lowest key of its group.

    Texts are compared whole. A document is a key and its text: repeated rows are one; a key that has several texts is in the
    group of each, and has a row for each of these groups. Null, empty and wordless texts are in no group, and rows with null keys
    have no row. Texts of equal signature are copies without further ado; a tie of sums gives bit 0. An empty table
    gives no rows; other columns are ignored.
    """
    need(df, key, text)
    found = _grouped(_signed(df.where(F.col(key).isNotNull()), key, text), segments)
    return found.select(F.col("id").alias("doc_id"), F.col("root.id").alias("group_id")).distinct()


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``df`` without near and exact copies: of each group one row stays, that of the lowest key. The columns are those of ``df``.

    A document is a key and its text, so different texts that share a key stay. Of repeated rows (equal key and text) the one whose
    other columns sort first as JSON stays; rows with null keys are dropped as copies of others, or stay for their group where
    it has no key. Of texts under one lowest key in one group that of the lower hash stays. Rows in no group stay, and all
    with null, empty or wordless texts. Very long texts are compared whole. An empty table gives an empty one.
    """
    need(df, key, text)
    signed = _signed(df, key, text)
    mine = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    gone = _grouped(signed, segments).where(mine != F.col("root")).select(F.col("id").alias("_g_key"), F.col("h").alias("_g_text"), F.lit(True).alias("_g_gone"))
    more = signed.where("rows > 1").select(F.col("id").alias("_g_key"), F.col("h").alias("_g_text"), F.lit(False).alias("_g_gone"))
    marks = gone.unionByName(more).groupBy("_g_key", "_g_text").agg(F.max("_g_gone").alias("_g_gone")).select(F.col("_g_key").alias("k"), F.col("_g_text").alias("h"), F.col("_g_gone").alias("gone"))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("text"))
    t = packed.join(marks, F.col("key").eqNullSafe(F.col("k")) & (F.col("text") == F.col("h")), "left")
    single = t.where("gone IS NULL").select("row")
    rest = [F.col("row")[c] for c in df.columns if c not in (key, text)]
    order = F.to_json(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(rest)])) if rest else F.lit("")
    once = t.where("NOT gone").groupBy("key", "text").agg(F.min_by("row", order).alias("row")).select("row")
    return single.unionByName(once).select("row.*")
