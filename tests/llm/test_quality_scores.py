"""The classifier's scores of a whole table, from labels on, in plain Python and dense matrices."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from brute import ascii_lower, words

from quarryline.llm import quality, registry

SF = "/root/testdata/sf0.001"


def dense(text, stated):
    """The features of one text: word buckets, then statistics of its shape and stated size."""
    text = text or ""
    raw = text.encode()
    w = words(text)
    out = np.zeros(quality.BUCKETS)
    for word, n in Counter(w).items():
        out[zlib.crc32(word.encode()) % quality.BUCKETS] += n
    out = np.log1p(out)
    out /= np.linalg.norm(out) or 1
    out = out.astype(np.float32).astype(float)
    size, n, lines = max(1, len(raw)), len(w), text.split("\n")
    buckets = Counter(zlib.crc32(x.encode()) % quality.BUCKETS for x in w)
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    plain = sum(1 for b in raw if b >= 128 or chr(b).isalnum() or chr(b) in " \t\n\x0b\x0c\r.,;'")
    share = lambda f: sum(map(f, raw)) / size
    stats = [
        math.log1p(len(raw)),
        math.log1p(n),
        math.log1p(len(lines)),
        sum(len(x.encode()) for x in w) / max(1, n),
        share(lambda b: 65 <= b <= 90),
        share(lambda b: 48 <= b <= 57),
        (len(raw) - plain) / size,
        share(lambda b: b in b" \t\n\x0b\x0c\r"),
        len(buckets) / max(1, min(n, quality.BUCKETS)),
        max(buckets.values(), default=0) / max(1, n),
        sum(a == b for a, b in zip(w, w[1:])) / max(1, n),
        1 - len(set(lines)) / len(lines),
        sum(p[-1] in "!#$%&*|" for p in parts) / max(1, len(parts)),
        share(lambda b: b >= 128),
        math.log1p(len(text) if stated is None else max(0, stated)),
        0.0 if stated is None else abs(stated - len(text)) / max(1, len(text), stated),
    ]
    return out, stats


def learn(x, y, epochs=12, batch=64, rate=0.02, decay=1e-4, seed=7):
    """Adam on the logistic loss of a factorisation machine, all features of all rows at once."""
    rng, size = np.random.default_rng(seed), x.shape[1]
    v, w = rng.normal(0, 0.02, (size, quality.RANK)), np.zeros((size, 1))
    p = min(max(y.mean(), 0.01), 0.99)
    params, bias = [w, v, np.array(math.log(p / (1 - p)))], None
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            a, t = x[order[at : at + batch]], y[order[at : at + batch]]
            w, v, bias = params
            error = (1 / (1 + np.exp(-(bias + (a @ w)[:, 0] + pairs(a, v)))) - t) / len(t)
            grads = [a.T @ error[:, None] + decay * w, a.T @ (error[:, None] * (a @ v)) - (np.square(a).T @ error)[:, None] * v + decay * v, error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m, s = moments[k]
                m, s = m + 0.1 * (g - m), s + 0.001 * (g * g - s)
                moments[k] = m, s
                params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return params


def pairs(a, v):
    return 0.5 * (np.square(a @ v) - np.square(a) @ np.square(v)).sum(1)


def test_scores_of_a_table_equal_plain_python(spark):
    docs = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs}
    made = {d: dense(*x) for d, x in docs.items()}
    taught = sorted(d for d in docs if d in labels and not held[d])
    stats = np.array([made[d][1] for d in taught])
    mean, spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    row = lambda d: np.concatenate([made[d][0], np.clip((np.array(made[d][1]) - mean) / spread, -5, 5)])
    w, v, bias = learn(np.array([row(d) for d in taught]), np.array([labels[d] for d in taught], float))
    x = np.array([row(d) for d in docs])
    want = dict(zip(docs, 1 / (1 + np.exp(-(bias + (x @ w)[:, 0] + pairs(x, v)))), strict=True))
    got = registry.op5_quality(spark, SF).collect()
    assert len(got) == len(docs) and len(taught) > 40
    assert all(abs(r.score - want[r.doc_id]) < 1e-4 and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.3) for r in got)


def test_plain_words_are_lower_cased():
    assert words("Ab, é1_B") == ["ab", "é1", "b"] and ascii_lower("É") == "É"
