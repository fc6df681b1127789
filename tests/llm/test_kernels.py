"""The numpy kernels against plain code that shares nothing with them."""

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from granary.llm import langid, quality, simhash, substrings, toxicity
from granary.llm.common import text_bytes

M = (1 << 64) - 1
SAMPLES = [*pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40], "", " ", "a", "a a a\n\nA-B_c ß\u00a0ÄÖ é", "- x\n  * y\n>z…\n...\n a... \n\ttab\rcr", "É" * 700, "1 2 3\n1 2 3\n1 2 3", None]


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_hash(raw, m=0x9E3779B97F4A7C15):
    keys = [mix((b + 1) * m & M) for b in range(256)]
    total = sum(keys[b] * pow(m, i, 1 << 64) for i, b in enumerate(raw))
    return mix((total + len(raw) * 0xD6E8FEB86659FD93) & M)


def test_signatures_by_plain_code():
    weighted, plain, n = simhash.signatures(pa.array(SAMPLES))
    for k, text in enumerate(SAMPLES):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())
        assert n[k] == len(words)
        for got, power in ((weighted[k], simhash.POWER), (plain[k], None)):
            sums = [0] * 128
            for w in set(words):
                h = plain_hash(w)
                weight = 1 if power is None else math.floor(16 * words.count(w) ** power + 0.5)
                bits = b"".join(int(x).to_bytes(8, "little") for x in (h, mix(h ^ 0x5851F42D4C957F2D)))
                for j in range(128):
                    sums[j] += weight if bits[j // 8] >> (7 - j % 8) & 1 else -weight
            want = bytes(sum((sums[8 * i + j] > 0) << (7 - j) for j in range(8)) for i in range(16))
            assert got.tobytes() == want


def test_chunk_ends_by_plain_code():
    gear = [(mix((b + 1) * 0x2545F4914F6CDD1D & M) >> 48) for b in range(256)]
    texts = [*SAMPLES, "ab" * 2000, "日本" * 900]
    data, offsets = text_bytes(pa.array(texts))
    ends, counts = substrings.chunk_ends(data, offsets)
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        want, start, h = [], 0, 0
        border = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
        for i in range(1, len(raw) + 1):
            h = (2 * h + gear[raw[i - 1]]) & 0xFFFF
            if i == len(raw) or (h < 1 << 11 and border(i) and i - start >= substrings.LEAST):
                while i - start > substrings.MOST:
                    start += substrings.MOST
                    while not border(start):
                        start -= 1
                    want.append(start)
                if i > start:
                    want.append(i)
                    start = i
        assert (ends[counts[k] : counts[k + 1]] - offsets[k]).tolist() == want


def test_digests_of_equal_chunks_are_equal_and_others_differ():
    from granary.llm.common import span_hashes

    raw = b"".join(t.encode() for t in SAMPLES if t)
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(0, len(raw) - 40, 7)
    for lane, m in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)):
        h = span_hashes(data, starts, starts + 33, lane)
        seen = {}
        for s, x in zip(starts.tolist(), h.tolist()):
            assert seen.setdefault(raw[s : s + 33], x) == x
        assert len(set(h.tolist())) == len(seen)
        assert h[3] == plain_hash(raw[21:54], m)


def test_labels_of_bytes_by_a_plain_network():
    net, r = langid.Network(3, seed=5), np.random.default_rng(5)
    x = r.integers(0, 256, (langid.WINDOW, 7)).astype(np.uint8)
    logits, _ = net.forward(x)
    assert np.abs(net.label_bytes(x) - logits).max() < 1e-4
    e, u, w, b = (p.astype(float) for p in net.p)
    h = net.h
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for column in (0, 6):
        want = np.tile(b, (langid.WINDOW, 1))
        for way in (0, 1):
            state = [0.0] * h
            for t in range(langid.WINDOW) if way == 0 else reversed(range(langid.WINDOW)):
                a = [sum(state[i] * u[way, i, j] for i in range(h)) for j in range(3 * h)]
                g = e[way, x[t, column]]
                reset = [sigmoid(g[j] + a[j]) for j in range(h)]
                keep = [sigmoid(g[h + j] + a[h + j]) for j in range(h)]
                new = [math.tanh(g[2 * h + j] + reset[j] * a[2 * h + j]) for j in range(h)]
                state = [keep[j] * state[j] + (1 - keep[j]) * new[j] for j in range(h)]
                want[t] += [sum(state[j] * w[way, j, k] for j in range(h)) for k in range(3)]
        assert np.abs(logits[:, column] - want).max() < 1e-4


def test_document_probabilities_are_means_over_all_bytes():
    net = langid.Network(4, seed=3)
    texts = ["", None, "abc", "x" * 1000, "é" * 65]
    p, n, size = langid.predict(net, pa.array(texts))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        total, counts = np.zeros(4), np.zeros(4, int)
        for lo in range(0, len(raw), langid.WINDOW):
            part = raw[lo : lo + langid.WINDOW]
            x = np.zeros((langid.WINDOW, 1), np.uint8)
            x[: len(part), 0] = list(part)
            q = langid.softmax(net.forward(x)[0][: len(part), 0])
            total += q.sum(0)
            counts += np.bincount(q.argmax(1), minlength=4)
        assert size[k] == len(raw) == n[k].sum() and np.abs(p[k] - total / max(len(raw), 1)).max() < 1e-5
        assert np.abs(n[k] - counts).sum() <= 2


def test_ftrl_by_plain_code():
    texts = [f"good day friend number {i}" for i in range(12)] + [f"you awful thing {i} go" for i in range(5)]
    y = np.array([0.0] * 12 + [1.0] * 5)
    kept, weights, bias = toxicity.train(pa.array(texts), y)
    docs = [sorted(set(toxicity.features(pa.array([t]))[1].tolist())) for t in texts]
    # Words, neighbours and skips of one.
    assert [len(d) for d in docs[:1]] == [5 + 4 + 3]
    z, n, zb, nb = {}, {}, 0.0, 0.0
    l1 = toxicity.L1 * math.sqrt(len(texts))
    each = {0.0: 17 / 2 / 12, 1.0: 17 / 2 / 5}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    r = np.random.default_rng(0)
    for _ in range(toxicity.EPOCHS):
        for k in r.permutation(len(docs)).tolist():
            w = {i: weight(i) for i in docs[k]}
            wb = -zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA)
            g = (1 / (1 + math.exp(-(sum(w.values()) + wb))) - y[k]) * each[y[k]]
            for i in docs[k]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * wb
            nb += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(kept.tolist(), weights.tolist())) == pytest.approx(want) and want
    assert bias == pytest.approx(-zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA))


def test_quality_measures_by_plain_code():
    got = quality.measure(pa.array(SAMPLES))
    for k, text in enumerate(SAMPLES):
        words = [w for w in re.split(r"[ \t\n\r\f]+", text or "") if w]
        if not words:
            assert all(v[k] == -1 for v in got.values())
            continue
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\f")]
        of = lambda n, d, prior: 1000 * n // (d + prior)
        want = {
            "symbols": of(sum(c in quality.SYMBOLS for c in text), len(text), 100),
            "capitals": of(sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text), len(text), 100),
            "repeats": of(sum(a == b for a, b in zip(words, words[1:])), len(words), 20),
            "digits": of(sum("0" <= c <= "9" for c in text), len(text), 100),
            "word_length": 10 * (sum(map(len, words)) + 100) // (len(words) + 20),
            "line_repeats": of(len(lines) - len(set(lines)), len(lines), 5),
            "bullets": of(sum(x.lstrip(" \t\n\r\f")[0] in quality.BULLETS for x in lines), len(lines), 5),
            "ellipses": of(sum(x.rstrip(" \t\n\r\f").endswith(("...", "…")) for x in lines), len(lines), 5),
        }
        assert {r: int(v[k]) for r, v in got.items()} == want, text
