"""The pruned top k against all scores."""

import random

import pytest

from sourcelens.operators import pruned, retrieval


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5), (3, 40)])
def test_same_rows_as_all_pairs(spark, seed, k):
    r = random.Random(seed)
    common, rare = ["the", "and", "of", "it"], [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(n))
    docs = [(i, text(r.randrange(5, 60))) for i in range(250)] + [(1000, None), (1001, ""), (1002, "the the the"), (1003, "w1"), (1004, "w1")]
    queries = [(1, "the w1 w2 w3"), (2, text(12)), (3, "of it"), (4, "unseen words only"), (5, ""), (6, "w7 w7 w7 the"), (7, "w1 unseen")]
    passages, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    all_scores = retrieval.tfidf_scores(asked, passages)
    want = {(x.query_id, x.doc_id, x.score, x["rank"]) for x in retrieval.top(all_scores, k).collect()}
    best, cost = pruned.top(passages, asked, k)
    assert {(x.query_id, x.doc_id, x.score, x["rank"]) for x in best.collect()} == want
    scored = sum(x.n_scored for x in cost.collect())
    assert scored <= all_scores.count()
    if k == 1:
        assert scored < 0.5 * all_scores.count()  # common words alone make no candidate


def test_no_passages(spark):
    best, _ = pruned.top(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string"), 3)
    assert best.count() == 0
