"""Importance weights against models counted by hand."""

import math
import re
from collections import Counter

import xxhash
from helpers import documents, invented

from sourcelens.llm import resampling

MASK = (1 << 64) - 1


def grams(text, buckets):
    """Buckets of words, pairs of words, shapes and pairs of shapes, one at a time."""
    words = [m[0] for m in re.finditer(r"[^\W_]+|([^\w\s]|_)\1*", text or "")]
    h = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
    s = []
    for k, w in enumerate(words):
        if w[0].isalnum():
            case = "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "l" if w.isalpha() else "n"
            shape = f"{case}{min(len(w), 12) // 4}"
        else:
            shape = f"{w[0]}{min(len(w), 3)}"
        again = k > 0 and words[k - 1].lower() == w.lower()
        s.append(xxhash.xxh64_intdigest(shape, 2) ^ (0x9E3779B97F4A7C15 if again else 0))
    mul = 0xBF58476D1CE4E5B9
    every = h + [(a * mul + b) & MASK for a, b in zip(h, h[1:])] + s + [(a * mul + b + 1) & MASK for a, b in zip(s, s[1:])]
    return [((((x ^ (x >> 31)) * 0x94D049BB133111EB) & MASK) >> 33) % buckets for x in every]


def test_weights_and_draw_match_models_counted_by_hand(spark):
    rows = [(i, t) for i, t in invented(8) if i is not None] + [(900, "Word word WORD -- ??? 12 a_b"), (901, "!"), (902, None)]
    targets = {i for i, _ in rows if i % 3 == 0}
    buckets, seed, share = 500, 42, 0.6
    raw, target = Counter(), Counter()
    for i, t in rows:
        got = grams(t, buckets)
        raw.update(got)
        if i in targets:
            target.update(got)
    n, m = sum(raw.values()), sum(target.values())
    ratio = [math.log((target[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets)) for b in range(buckets)]
    want = []
    for i, t in rows:
        u = (xxhash.xxh64_intdigest(str(i), seed) + 0.5) / 2.0**64
        weight = sum(ratio[b] for b in grams(t, buckets))
        want.append((weight - math.log(-math.log(u)), i, weight))
    k = math.floor(share * len(rows) + 0.5)
    got = resampling.resample(documents(spark, rows), spark.createDataFrame([(i,) for i in targets], "doc_id long"), share=share, buckets=buckets, seed=seed).collect()
    weights = {}
    for key, i, w in want:
        weights.setdefault(i, []).append((w, key))
    kept = Counter(i for _, i, _ in sorted(want, key=lambda x: (-x[0], x[1]))[:k])
    assert Counter(r.doc_id for r in got) == kept
    for r in got:
        assert any(abs(r.log_weight - w) < 1e-6 and abs(r.key - x) < 1e-6 for w, x in weights[r.doc_id])
