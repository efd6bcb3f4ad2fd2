"""What operators once left out."""

import random
from collections import Counter

from helpers import documents

import corpus_pipeline


def shingle_jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_pipeline_removes_near_copies_of_similarity_four_fifths(spark):
    r = random.Random(3)
    rows, copies = [], []
    for i in range(120):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([100, 400]))]
        text, want = " ".join(words), r.uniform(0.8, 0.93)
        while True:
            changed = words.copy()
            changed[r.randrange(len(words))] = "changed"
            if shingle_jaccard(text, " ".join(changed)) < want:
                break
            words = changed
        copy = " ".join(words)
        rows += [(i, text)] + [(1000 + i, copy)] * (copy != text)
        copies += [1000 + i] * (copy != text)
    apart = " ".join(f"v{k}" for k in range(40))
    rows += [(5000, apart), (5001, " ".join(apart.split()[:20] + [f"u{k}" for k in range(20)])), (5002, None), (5003, ""), (None, "no id"), (None, "no id"), (None, "other")]
    docs = documents(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert out.dtypes == docs.dtypes and len(copies) > 80
    assert sum(i in copies for i, _ in got) <= 0.02 * len(copies)
    assert Counter(i for i, _ in got if i not in copies) == Counter([*range(120), 5000, 5001, 5002, None, None])
