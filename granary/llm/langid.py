"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained here in numpy, by backpropagation through time. A text is cut into windows of WINDOW
bytes; in each, one recurrent layer reads forwards and one backwards, and every byte gets a probability for every
language. A document's probabilities are the means over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, need, text_bytes, text_slices

WINDOW, HIDDEN, BATCH = 64, 8, 2048
#: Bounds on training: documents of each language, windows of each language, and updates.
SAMPLE, WINDOWS, UPDATES = 150, 1500, 300


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the windows (WINDOW x n), length of each, row of each); the last window of a row is filled up with 0."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[row] + nth * WINDOW
    length = np.minimum(offsets[row + 1] - start, WINDOW)
    steps = np.arange(WINDOW)[:, None]
    at = np.minimum(start + steps, max(len(data) - 1, 0))
    return np.where(steps < length, data[at] if len(data) else 0, 0).astype(np.uint8), length, row


class Network:
    """Parameters: input (direction, byte, 3 gates x HIDDEN), recurrent (direction, HIDDEN, 3 x HIDDEN), output and bias."""

    def __init__(self, labels: int, seed: int = 0, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        h = self.h = hidden
        self.p = [r.normal(0, 0.3, (2, 256, 3 * h)), r.normal(0, h**-0.5, (2, h, 3 * h)), r.normal(0, 0.1, (2, h, labels)), np.zeros(labels)]
        self.p = [x.astype(np.float32) for x in self.p]

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(logits (WINDOW, n, labels), the steps for backward if ``keep``)."""
        e, u, w, b = self.p
        h2, t, n = 2 * self.h, *x.shape
        state, steps = np.zeros((2, n, self.h), np.float32), []
        states = np.empty((2, t, n, self.h), np.float32)
        for i in range(t):
            g = np.stack([e[0].take(x[i], axis=0), e[1].take(x[t - 1 - i], axis=0)])
            a = state @ u
            rz = g[..., :h2]
            rz += a[..., :h2]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            r, z = rz[..., : self.h], rz[..., self.h :]
            c = r * a[..., h2:]
            c += g[..., h2:]
            np.tanh(c, out=c)
            if keep:
                steps.append((state, r.copy(), z.copy(), c, a[..., h2:].copy()))
            state = c + z * (state - c)
            states[0, i], states[1, t - 1 - i] = state[0], state[1]
        return states[0] @ w[0] + states[1] @ w[1] + b, [steps, states]

    def label_bytes(self, x: np.ndarray) -> np.ndarray:
        """The logits of ``forward``, by steps that reuse their arrays; for windows in batches of one size."""
        e, u, w, b = self.p
        h, h2, t, n = self.h, 2 * self.h, *x.shape
        f = np.float32
        # sigmoid(a) is tanh(a / 2) / 2 + 1 / 2; the inner half is in the tables.
        e_rz, e_c = [np.ascontiguousarray(k[:, :h2]) * f(0.5) for k in e], [np.ascontiguousarray(k[:, h2:]) for k in e]
        u_rz, u_c = [np.ascontiguousarray(k[:, :h2]) * f(0.5) for k in u], [np.ascontiguousarray(k[:, h2:]) for k in u]
        out = np.empty((t, n, w.shape[2]), f)
        out[:] = b
        rz, arz, c, ac = np.empty((n, h2), f), np.empty((n, h2), f), np.empty((n, h), f), np.empty((n, h), f)
        for k in (0, 1):
            state = np.zeros((n, h), f)
            for i in range(t) if k == 0 else range(t - 1, -1, -1):
                e_rz[k].take(x[i], axis=0, out=rz, mode="clip")
                e_c[k].take(x[i], axis=0, out=c, mode="clip")
                np.matmul(state, u_rz[k], out=arz)
                np.matmul(state, u_c[k], out=ac)
                rz += arz
                np.tanh(rz, out=rz)
                rz *= f(0.5)
                rz += f(0.5)
                ac *= rz[:, :h]
                c += ac
                np.tanh(c, out=c)
                state -= c
                state *= rz[:, h:]
                state += c
                out[i] += state @ w[k]
        return out

    def backward(self, x: np.ndarray, kept: list, d: np.ndarray) -> list[np.ndarray]:
        """Gradients of all parameters from ``d``, that of the logits, by backpropagation through time."""
        e, u, w, b = self.p
        steps, states = kept
        h, h2, t = self.h, 2 * self.h, len(x)
        flat = d.reshape(-1, d.shape[-1])
        ge, gu = np.zeros_like(e), np.zeros_like(u)
        gw = np.stack([states[k].reshape(-1, h).T @ flat for k in (0, 1)])
        ds = np.stack([d @ w[0].T, (d @ w[1].T)[::-1]])
        carry = np.zeros_like(steps[0][0])
        for i in range(t - 1, -1, -1):
            state, r, z, c, a = steps[i]
            dh = ds[:, i] + carry
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (state - c) * z * (1 - z)
            dr = dc * a * r * (1 - r)
            gate = np.concatenate([dr, dz, dc], axis=-1)
            own = np.concatenate([dr, dz, dc * r], axis=-1)
            gu += state.transpose(0, 2, 1) @ own
            np.add.at(ge[0], x[i], gate[0])
            np.add.at(ge[1], x[t - 1 - i], gate[1])
            carry = dh * z + own @ u.transpose(0, 2, 1)
        return [ge, gu, gw, flat.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    x /= x.sum(-1, keepdims=True)
    return x


def train(x: np.ndarray, length: np.ndarray, y: np.ndarray, labels: int, updates: int = UPDATES, seed: int = 0, batch: int = 192) -> Network:
    """Fit a network to windows (WINDOW x n) of known length and label, by Adam on the mean loss of all their bytes."""
    net, r = Network(labels, seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, updates + 1):
        pick = r.integers(0, x.shape[1], batch)
        part = x[:, pick]
        logits, kept = net.forward(part, keep=True)
        d = softmax(logits)
        d[:, np.arange(batch), y[pick]] -= 1
        d *= (np.arange(WINDOW)[:, None] < length[pick])[..., None] / np.float32(length[pick].sum())
        rate = 0.02 * min(1.0, 2 * (1 - step / (updates + 1)))
        for k, g in enumerate(net.backward(part, kept, d.astype(np.float32))):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean probabilities (rows x labels), bytes labelled as each (rows x labels), bytes) of the texts."""
    labels = len(net.p[3])
    p, n, size = np.zeros((len(texts), labels)), np.zeros((len(texts), labels), np.int64), np.zeros(len(texts), np.int64)
    for lo, part in text_slices(texts):
        data, offsets = text_bytes(part)
        size[lo : lo + len(part)] = np.diff(offsets)
        x, length, row = windows(data, offsets)
        for k in range(0, x.shape[1], BATCH):
            own = slice(k, k + BATCH)
            q = softmax(net.label_bytes(np.ascontiguousarray(x[:, own])))
            inside = np.arange(WINDOW)[:, None] < length[own]
            q *= inside[..., None]
            best = q.argmax(-1)
            sums = q.sum(0, dtype=np.float64)
            counts = np.stack([((best == j) & inside).sum(0) for j in range(labels)], axis=1)
            first = np.flatnonzero(np.r_[True, np.diff(row[own]) > 0])
            rows = lo + row[own][first]
            p[rows] += np.add.reduceat(sums, first)
            n[rows] += np.add.reduceat(counts, first)
    return p / np.maximum(size, 1)[:, None], n, size


def fit(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> tuple[list[str], Network]:
    """(languages, network) from at most ``sample`` documents of each language that ``docs`` names, chosen by a hash of the key."""
    ids = labelled_sample(docs, lang, key, sample)
    # The sample is bounded by its parameter, so its ids may be broadcast.
    rows = docs.select(key, lang, text).where(F.length(text) > 0).join(F.broadcast(ids), [key, lang]).orderBy(F.xxhash64(key), key, text).select(F.col(lang).alias("lang"), F.col(text).alias("text")).toArrow()
    known = rows["lang"].to_pylist()
    languages = sorted(set(known))
    if not languages:
        return [], Network(0)
    x, length, row = windows(*text_bytes(rows["text"].combine_chunks()))
    y = np.array([languages.index(k) for k in known])[row]
    r = np.random.default_rng(1)
    pick = np.concatenate([r.permutation(np.flatnonzero(y == k))[:WINDOWS] for k in range(len(languages))])
    return languages, train(x[:, pick], length[pick], y[pick], len(languages))


def label(docs: DataFrame, model: tuple[list[str], Network], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, confidence, languages) of every row of ``docs``.

    language is the one of highest mean probability over all bytes (of equal ones the first by name), confidence that
    mean, and languages has for each language its name, the number of bytes labelled as it, and its mean. Null and empty
    texts, and all texts where no language was known to train on, get a null language and confidence. Null keys and
    repeated rows are labelled as any others; other columns are not returned. An empty table gives no rows.
    """
    need(docs, key, text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = held.value
        k = len(names)
        for b in batches:
            if k:
                p, n, size = predict(net, b.column(1))
                best = p.argmax(1)
                none = size == 0
                top = [pa.array(np.array(names, object)[best], pa.string(), mask=none), pa.array(p.max(1), mask=none)]
            else:
                p, n = np.zeros((b.num_rows, 0)), np.zeros((b.num_rows, 0), np.int64)
                top = [pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.float64())]
            each = pa.StructArray.from_arrays([pa.array(names * b.num_rows, pa.string()), pa.array(n.ravel()), pa.array(p.ravel())], ["language", "bytes", "probability"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), each)
            yield pa.RecordBatch.from_arrays([b.column(0), *top, lists], ["doc_id", "language", "confidence", "languages"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, language string, confidence double, languages array<struct<language: string, bytes: bigint, probability: double>>")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on a bounded sample of the documents' own labels and label every byte of all. See ``fit`` and ``label``."""
    return label(docs, fit(docs))
