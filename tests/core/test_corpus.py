"""The index behind TF-IDF: what it keeps, and terms too many to broadcast."""

import pytest

from sourcelens.operators import pruned, retrieval


@pytest.fixture
def tables(spark):
    docs = [(i, f"the w{i % 7} w{i % 5} own{i} pair{i // 2}") for i in range(60)] + [(60, None), (61, "the the w1")]
    return spark.createDataFrame([(1, "the w1 w2"), (2, "own3 pair4 unseen")], "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_a_passage_keeps_asked_terms_only(tables):
    queries, docs = tables
    kept = {t.term for row in pruned.index(docs, queries).corpus.forward.collect() for t in row.terms}
    assert kept == {"the", "w1", "w2", "own3", "pair4"}


def test_rare_terms_by_shuffle(tables, monkeypatch):
    queries, docs = tables
    rows = lambda: {tuple(r) for r in retrieval.tfidf_scores(queries, docs).collect()}
    want = rows()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 3)
    assert rows() == want and len(want) > 50


def test_tasks_follow_what_there_is_to_score(spark, tables, monkeypatch):
    queries, docs = tables
    want = {tuple(r) for r in retrieval.tfidf_scores(queries, docs).collect()}
    many = spark.createDataFrame([(i, "the w1 w2") for i in range(40)], "query_id long, text string")
    monkeypatch.setattr(retrieval, "TASK_MET", 100)
    tasks = lambda asked: retrieval.exploded(retrieval.corpus(asked, docs)).rdd.getNumPartitions()
    assert tasks(queries) == 4 and tasks(many) >= 25
    assert {tuple(r) for r in retrieval.tfidf_scores(queries, docs).collect()} == want


def test_tasks_follow_texts_and_postings(tables, monkeypatch):
    queries, docs = tables
    want = {tuple(r) for r in retrieval.tfidf_scores(queries, docs).collect()}
    dealt, seen = retrieval._dealt, []
    monkeypatch.setattr(retrieval, "_dealt", lambda *a, **k: (seen.append(dealt(*a, **k)), seen[-1])[1])
    for name, most in (("TASK_BYTES", 100), ("TASK_POSTINGS", 20), ("BROADCAST_TERMS", 3)):
        monkeypatch.setattr(retrieval, name, most)
    assert {tuple(r) for r in retrieval.tfidf_scores(queries, docs).collect()} == want
    assert [rows.rdd.getNumPartitions() > 8 for rows in seen] == [True, True, True, False]  # texts, rare terms, asked terms, scores
