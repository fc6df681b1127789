"""Helpers that the operators share: byte views of Arrow text, hashes, bounded samples, lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import shared_folder

U64 = np.uint64
#: Text is handled in slices of about this many bytes, so that temporary arrays stay small however large a batch is.
SLICE_BYTES = 1 << 19


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *columns: str) -> None:
    """Raise ValueError where ``df`` lacks one of ``columns``."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: A table of at most so many rows may be broadcast.
SMALL_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, which is written first and counted (unless ``rows`` says how many it has).

    Up to SMALL_ROWS rows it is broadcast, so that ``big`` stays where it is; beyond that both sides are shuffled.
    """
    if rows is None:
        small = cut_lineage(small)
        rows = small.count()
    return big.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def row_slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row is a range of its own."""
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets): row i has bytes offsets[i] to offsets[i + 1]. Nulls count as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of the slices of a text column."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in row_slices(sizes, most):
        yield lo, column.slice(lo, hi - lo)


#: Bytes that belong to a word: letters, digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    if lane in _POWERS and len(_POWERS[lane][0]) >= n:
        up, down = _POWERS[lane]
        return up[:n], down[:n]
    m, both = _LANES[lane], []
    for x in (m, pow(m, -1, 1 << 64)):
        steps = np.full(n + (n >> 3), x, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            both.append(steps.cumprod(dtype=np.uint64))
    if n <= 1 << 21:
        # Those for a single very long text are not kept.
        _POWERS[lane] = (both[0], both[1])
    return both[0][:n], both[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its bytes' keys times powers of an odd number, summed by differences of one running sum, mixed with the length. Lanes 0 and 1 are independent."""
    up, down = _powers(len(data) + 1, lane)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[lane][data] * up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


with np.errstate(over="ignore"):
    _BYTE_KEYS = [mix64(np.arange(1, 257, dtype=np.uint64) * U64(x)) for x in _LANES]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of bytes where ``inside`` holds; a run never spans two rows."""
    wide = np.zeros(len(inside) + 2, bool)
    wide[1:-1] = inside
    edges = np.flatnonzero(wide[1:] != wide[:-1])
    starts, ends = edges[0::2], edges[1::2]
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):
        at = np.searchsorted(starts, cuts, side="left") - 1
        at_ok = at >= 0
        inner = np.unique(cuts[at_ok][(ends[at[at_ok]] > cuts[at_ok])])
        if len(inner):
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets by row) of the texts in lower case; a word is a longest run of WORD bytes."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends = spans(WORD[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def hash_unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 12 hex digits of the MD5 of seed:key; SQL can write the same."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def labelled_sample(keys: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of (key, label) for each label, chosen by hash: the documented bound on training rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return keys.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n")
