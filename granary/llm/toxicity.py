"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours, and pairs with one word between them, each hashed to BITS bits and
present or not. FTRL gives every coordinate a learning rate of its own and, by its L1 term, weights of exactly zero to
all but a few features: only those are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, labelled_sample, mix64, need, text_slices, words

BITS = 20
#: The bound on labelled training rows, per label.
SAMPLE = 3000
#: L1 is times the square root of the number of training rows, at which the gradients of features without meaning add up.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 1.35, 0.0, 10
THRESHOLD = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram and skip-gram of the texts, with repeats."""
    h, offsets = words(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    rows, ids = [row], [h]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[:-gap][same])
                ids.append((h[:-gap] * U64(salt) + h[gap:])[same])
        return np.concatenate(rows), (mix64(np.concatenate(ids)) >> U64(64 - BITS)).astype(np.int64)


def _documents(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    for _, part in text_slices(texts):
        row, feature = features(part)
        keys = np.unique(row << BITS | feature)
        cut = np.searchsorted(keys, np.arange(len(part) + 1) << BITS)
        for i in range(len(part)):
            yield keys[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)


def train(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with weight, their weights, bias) from labelled texts; each epoch has an order of its own, always the same.

    Both labels weigh the same together, however rare one is. No labels, or only one, give no weights and bias 0.
    """
    if len(set(labels.tolist())) < 2:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    docs = list(_documents(texts))
    l1, each = L1 * len(docs) ** 0.5, len(labels) / 2 / np.array([(labels != 1).sum(), (labels == 1).sum()])
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    r = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in r.permutation(len(docs)).tolist():
            x, y = docs[k], labels[k]
            w = weight(z[x], n[x])
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            g *= each[int(y)]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], -zb / ((BETA + nb**0.5) / ALPHA)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Train on at most ``sample`` labelled documents of each label, chosen and ordered by a hash of their key."""
    ids = labelled_sample(labels.where(F.col(label).isin(0, 1)), label, key, sample)
    # The sample is bounded by its parameter, so its ids may be broadcast.
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(ids), key).orderBy(F.xxhash64(key), key, text).select(F.col(text).alias("text"), F.col(label).alias("label")).toArrow()
    return train(rows["text"].combine_chunks(), rows["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of ``docs``: the chance of the label and whether it reaches ``threshold``.

    Whole texts are read. Null, empty and wordless texts get a null chance and are not toxic. Null keys and repeated
    rows are scored as any others. Other columns of ``docs`` are not returned. An empty table gives no rows.
    """
    need(docs, key, text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, values, bias = held.value
        w = np.zeros(1 << BITS)
        w[kept] = values
        for b in batches:
            total, seen = np.full(b.num_rows, bias), np.zeros(b.num_rows, bool)
            for lo, part in text_slices(b.column(1)):
                row, feature = features(part)
                seen[lo + np.unique(row)] = True
                hit = w[feature] != 0
                at = np.unique(row[hit] << BITS | feature[hit])
                total += np.bincount((at >> BITS) + lo, w[at & ((1 << BITS) - 1)], b.num_rows)
            p = 1 / (1 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, mask=~seen), pa.array(seen & (p >= threshold))], ["doc_id", "toxicity", "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean")


def find_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all. See ``fit`` and ``score``."""
    return score(docs, fit(docs, labels))
