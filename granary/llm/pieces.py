"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Spaces are whitespace markers, and a text gets one in front. Of all ways to cut a text into pieces, the one with the
highest sum of log scores is taken. A character that is no piece of its own may also be written as its UTF-8 bytes, at
the least score of the model less 10. Decoding joins the pieces' bytes, turns markers into spaces and drops the first:
it gives back every text exactly, also one that holds the marker character itself, which is written in bytes.

Where the model file is of the BPE kind, its pieces have merge ranks and no log scores. Then the log score of the piece
of rank r is that of Zipf's law: minus the logarithms of r + 2 and of the sum of 1 / (r + 2). The vocabulary is used as it
is; nothing is trained.

Markers stand only at the start of pieces, so a text falls apart, exactly, where a marker follows another character; each
distinct part of a slice of texts is cut once, all parts of like length side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, row_slices, span_hashes, text_bytes, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Score of a character written in bytes, less than the least score.
PENALTY = 10.0
#: Bytes of texts that are cut at a time: the more, the more parts are met again.
SLICE = 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            at += 1
            shift += 7
            if raw[at - 1] < 128:
                return n

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """Pieces as bytes (marker as space), their kinds and log scores, and the double-array trie over the usable ones."""

    pieces: list[bytes]
    kinds: np.ndarray
    scores: np.ndarray
    base: np.ndarray = field(init=False)
    check: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        usable = np.isin(self.kinds, (NORMAL, DEFINED))
        self.low = float(self.scores[usable].min()) - PENALTY if usable.any() else -PENALTY
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[self.pieces[i][0]] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces; byte fallback needs all 256")
        own = {self.pieces[i]: int(i) for i in np.flatnonzero(usable)}
        self.splits = not any(b" " in p.lstrip(b" ") for p in own)
        self._build(own)
        hidden = np.isin(self.kinds, (UNKNOWN, CONTROL, UNUSED))
        shown = [b"" if h else p for p, h in zip(self.pieces, hidden)]
        self.sizes = np.array([len(p) for p in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(shown), np.uint8)

    def _build(self, own: dict[bytes, int]) -> None:
        """Lay the trie out: child of state s by byte c is base[s] + c + 1, and check of that is s."""
        root: dict = {}
        for piece, i in own.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        # Where nodes of so many children were last placed: below it, gaps are seldom wide enough.
        hints: dict[int, int] = {}
        queue = [(0, root)]
        for state, node in queue:
            codes = sorted(c + 1 for c in node if c >= 0)
            value[state] = node.get(-1, -1)
            if not codes:
                continue
            b, window = hints.get(len(codes), 0), 256
            while True:
                while b + window + 257 >= len(check):
                    base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                free = np.ones(window, bool)
                for c in codes:
                    free &= check[b + c : b + c + window] < 0
                if free.any():
                    b += int(free.argmax())
                    break
                b += window
            hints[len(codes)] = b
            base[state] = b
            check[b + np.array(codes)] = state
            queue.extend((b + c, node[c - 1]) for c in codes)
        self.base, self.check, self.value = base, check, value
        self.longest = max(map(len, own), default=1)

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        return self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lists"}


def load(path: str = MODEL) -> Model:
    """Read a SentencePiece model file."""
    pieces, kinds, scores, kind = [], [], [], 1
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            pieces.append(p[1].decode())
            scores.append(float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]))
            kinds.append(p.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
    kinds, scores = np.array(kinds), np.array(scores)
    if kind == 2:
        rank = np.where(kinds == NORMAL, -scores, 0)
        total = (1 / (rank[kinds == NORMAL] + 2)).sum()
        scores = np.where(kinds == NORMAL, -np.log(rank + 2) - np.log(total), 0.0)
    elif kind != 1:
        raise ValueError(f"model kind {kind} is neither unigram nor BPE")
    raw_pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds.tolist())]
    return Model(raw_pieces, kinds, scores)


def _best_one(model: Model, text: bytes) -> tuple[list[int], list[int]]:
    """(starts, ids) of the best cut of one part; id -1 is a character in bytes."""
    base, check, value, scores = model.lists
    n, size = len(text), len(check)
    best, back, ids = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        here = best[s]
        if here == -np.inf:
            continue
        c = text[s]
        char = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        state, single = 0, False
        for e in range(s, n):
            to = base[state] + text[e] + 1
            if to >= size or check[to] != state or to == 0:
                break
            state = to
            if (v := value[state]) >= 0:
                single |= e + 1 - s == char
                if here + scores[v] > best[e + 1]:
                    best[e + 1], back[e + 1], ids[e + 1] = here + scores[v], s, v
        if not single and here + model.low > best[s + char]:
            best[s + char], back[s + char], ids[s + char] = here + model.low, s, -1
    at, starts, out = n, [], []
    while at > 0:
        out.append(ids[at])
        at = back[at]
        starts.append(at)
    return starts[::-1], out[::-1]


def _best_many(model: Model, m: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, id) of the best cuts of parts given as rows of ``m`` (filled up with 0), in no order."""
    n, width = m.shape
    best = np.full((n, width + 4), -np.inf)
    back, ids = np.zeros((n, width + 4), np.int32), np.zeros((n, width + 4), np.int32)
    best[:, 0] = 0
    chars = np.where(m < 0x80, 1, np.where(m < 0xE0, 2, np.where(m < 0xF0, 3, 4)))
    for s in range(width):
        alive = np.flatnonzero((best[:, s] > -np.inf) & (length > s))
        if not len(alive):
            continue
        here, char = best[alive, s], chars[alive, s]
        single = np.zeros(len(alive), bool)
        on, state = np.arange(len(alive)), np.zeros(len(alive), np.int64)
        for e in range(s, min(width, s + model.longest)):
            to = model.base[state] + m[alive[on], e].astype(np.int64) + 1
            to = np.minimum(to, len(model.check) - 1)
            good = (model.check[to] == state) & (length[alive[on]] > e)
            on, state = on[good], to[good]
            if not len(on):
                break
            v = model.value[state]
            ends = v >= 0
            single[on[ends & (char[on] == e + 1 - s)]] = True
            score = here[on] + np.where(ends, model.scores[v], -np.inf)
            row = alive[on]
            better = score > best[row, e + 1]
            row = row[better]
            best[row, e + 1], back[row, e + 1], ids[row, e + 1] = score[better], s, v[better]
        lone = np.flatnonzero(~single)
        row, to = alive[lone], s + char[lone]
        score = here[lone] + model.low
        better = score > best[row, to]
        row, to = row[better], to[better]
        best[row, to], back[row, to], ids[row, to] = score[better], s, -1
    part, at, out = np.arange(n), length.astype(np.int64), []
    while len(part):
        start = back[part, at]
        out.append((part, start, ids[part, at]))
        part, at = part[start > 0], start[start > 0]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def encode_bytes(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, offsets of the rows in them) of texts given as UTF-8 bytes."""
    # Put the marker in front of every text that is not empty.
    filled = np.diff(offsets) > 0
    marked = np.insert(data, offsets[:-1][filled], 32)
    offsets = offsets + np.r_[0, np.cumsum(filled)]
    space = marked == 32
    new = np.zeros(len(marked), bool)
    if model.splits and len(marked):
        new[1:] = space[1:] & ~space[:-1]
    new[offsets[:-1][filled]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(marked))
    keys = np.stack([span_hashes(marked, starts, ends, k) for k in (0, 1)], axis=1)
    keys = np.ascontiguousarray(keys).view("V16").ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    lo, size = starts[first], (ends - starts)[first]
    parts, begins, ids = [], [], []
    floor = 0
    for width in (8, 12, 16, 24, 32, 64):
        own = np.flatnonzero((size > floor) & (size <= width))
        floor = width
        for k in range(0, len(own), 1 << 14):
            some = own[k : k + (1 << 14)]
            at = np.minimum(lo[some][:, None] + np.arange(width), len(marked) - 1)
            m = np.where(np.arange(width) < size[some][:, None], marked[at], 0)
            p, b, i = _best_many(model, m, size[some])
            parts.append(some[p])
            begins.append(b)
            ids.append(i)
    for j in np.flatnonzero(size > floor).tolist():
        b, i = _best_one(model, marked[lo[j] : lo[j] + size[j]].tobytes())
        parts.append(np.full(len(b), j))
        begins.append(np.array(b))
        ids.append(np.array(i))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    parts, begins, ids = (np.concatenate(x).astype(np.int64) for x in (parts, begins, ids))
    order = np.lexsort((begins, parts))
    parts, begins, ids = parts[order], begins[order], ids[order]
    lone = ids < 0
    if lone.any():
        # Spread a character in bytes over its bytes.
        head = marked[(lo[parts] + begins)[lone]]
        times = np.ones(len(ids), np.int64)
        times[lone] = np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(lo[parts] + begins, times) + nth
        lone = np.repeat(lone, times)
        parts, ids = np.repeat(parts, times), np.repeat(ids, times)
        ids[lone] = model.bytes[marked[where[lone]]]
    counts = np.bincount(parts, minlength=len(first))
    begin = np.cumsum(counts) - counts
    n = counts[inverse]
    total = np.cumsum(n)
    flat = ids[np.repeat(begin[inverse] - (total - n), n) + np.arange(total[-1])]
    before = np.r_[0, total]
    return flat.astype(np.int32), before[np.searchsorted(starts, offsets)]


def decode_ids(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of the rows in them) of rows of ids; the first byte of a row is dropped if it is a marker."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model.sizes)):
        raise ValueError(f"ids must be in 0 to {len(model.sizes) - 1}")
    n = model.sizes[ids]
    total = np.r_[0, np.cumsum(n)]
    data = model.flat[np.repeat(model.starts[ids] - total[:-1], n) + np.arange(total[-1])]
    cut = total[offsets]
    head = cut[:-1][np.diff(cut) > 0]
    head = head[data[head] == 32]
    drop = np.zeros(len(data) + 1, np.int64)
    drop[head + 1] = 1
    return np.delete(data, head), cut - np.cumsum(drop)[cut]


def _encoded(model: Model, part: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(lists of ids, numbers of ids, all ids, offsets of the rows in them) of a slice of texts."""
    ids, offsets = encode_bytes(model, *text_bytes(part))
    null = np.asarray(part.is_null())
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
    return lists, pa.array(np.diff(offsets).astype(np.int32), mask=null), ids, offsets


def _decoded(model: Model, ids: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    """The texts of rows of ids, null where ``null`` says so; bytes that are no UTF-8 become replacement characters."""
    data, cut = decode_ids(model, ids, offsets)
    raw = pa.Array.from_buffers(pa.binary(), len(null), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        out = raw.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.as_py().decode("utf-8", "replace") for x in raw])
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out) if null.any() else out


def encode(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of every row of ``df``, and with ``decoded`` the text that the ids decode to.

    A null text gives null ids and count (and text), an empty one no ids. Whole texts are encoded, in one part where they hold no
    space. Null keys and repeated rows are encoded as any others; of cuts of equal score the one found first wins, the
    same on every run. Other columns are not returned. An empty table gives no rows.
    """
    need(df, key, text)
    held = df.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in text_slices(b.column(1), SLICE):
                lists, counts, ids, offsets = _encoded(held.value, part)
                columns = [b.column(0).slice(lo, len(part)), lists, counts]
                if decoded:
                    columns.append(_decoded(held.value, ids, offsets, np.asarray(part.is_null())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "token_ids", "n_tokens", "decoded"][: len(columns)])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens int" + ", decoded string" * decoded)


def decode(df: DataFrame, model: Model | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of the column ``ids`` as a further column ``text``, which must be new.

    Null ids (or a null among them) give null, no ids an empty text. Control pieces and the unknown piece decode to
    nothing; bytes that are no UTF-8 to replacement characters. An id beyond the vocabulary raises. Repeated rows and very
    long lists are decoded as any others. An empty table gives an empty one; other columns pass through.
    """
    need(df, ids)
    if text.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {text} already")
    held = df.sparkSession.sparkContext.broadcast(model or load())
    at = df.columns.index(ids)
    schema = df.select("*", F.lit("").cast("string").alias(text)).schema
    schema[text].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(whole.column(at).value_lengths().fill_null(0)) * 8
            for lo, hi in row_slices(sizes):
                b = whole.slice(lo, hi - lo)
                lists = b.column(at)
                null = np.array([x is not None and lists[i].values.null_count > 0 for i, x in enumerate(lists)]) if lists.flatten().null_count else np.zeros(len(lists), bool)
                null |= np.asarray(lists.is_null())
                n = np.where(null, 0, np.asarray(lists.value_lengths().fill_null(0)))
                flat = lists.filter(pa.array(~null)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, _decoded(held.value, flat, np.r_[0, np.cumsum(n)], null)], [*b.schema.names, text])

    return df.mapInArrow(run, schema)
