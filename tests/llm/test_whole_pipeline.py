"""The pipeline's rows against stages done one document at a time, and what its stages make of odd tables."""

import math
import random

import pytest
from helpers import components, documents, invented
from test_scores import segments, toxic_tables

import corpus_pipeline
from sourcelens.llm import lines, toxicity

ORDER = lambda r: (-1 if r[0] is None else r[0], r[1] or "")


def evidence(model, text):
    """A document's evidence by the definition of maximal segments."""
    words = toxicity.tokens(text)
    values, least = [model.of(w) for w in words], math.log(max(1, len(words)))
    own = [model.rate * sum(values[a:b]) - least for a, b in segments(values)]
    return sum(x for x in own if x > 0) or max(own, default=-least)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def word_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def without_lines(rows):
    rows = sorted(rows, key=ORDER)
    places = [(p, k, x) for p, (_, t) in enumerate(rows) for k, x in enumerate(lines.split_lines(t)) if x]
    texts = sorted({x for _, _, x in places})
    sets = {x: {x[k : k + 5] for k in range(len(x) - 4)} for x in texts}
    want = components(texts, [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8])
    first = {}
    for p, k, x in places:
        first.setdefault(want[x], (p, k))
    out = []
    for p, (i, t) in enumerate(rows):
        gone = {k for d, k, x in places if d == p and first[want[x]] != (p, k)}
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        if not gone or left.strip():
            out.append((i, left if gone else t))
    return out


def one_of_each(rows):
    texts = sorted({t for _, t in rows}, key=lambda t: t or "")
    sets = [word_set(t) for t in texts]
    want = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    best = {}
    for i, t in sorted(rows, key=ORDER):
        best.setdefault(want[texts.index(t)], (i, t))
    return list(best.values())


def contaminated(text, items):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    for item in items:
        own = item.lower().split()
        n = min(5, len(own))
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        here = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        if len(wanted & here) >= math.ceil(0.8 * len(wanted)):
            return True
    return False


def test_pipeline_against_documents_one_at_a_time(spark, tmp_path):
    r = random.Random(14)
    _, labels = toxic_tables(spark, 300)
    tables = toxic_tables(spark, 300)[0].select("doc_id", "text").collect()
    item = " ".join(f"item{j}" for j in range(30))
    long = " ".join(f"u{k}" for k in range(120))
    changed = long.split()
    changed[60] = "changed"
    rows = [(x.doc_id, x.text) for x in tables if x.doc_id is None or x.doc_id < 302] + [(5000 + k, t) for k, t in enumerate(t for _, t in invented(4, 30))]
    rows += [(7000, long), (7001, " ".join(changed)), (7002, f"before {item} after"), (7003, " ".join(item.split()[:20])), (7002, "a repeated id with words of its own"), (None, "no id and its own words"), (None, "no id and its own words"), (7004, None), (7005, "")]
    rows = [(i, t) for i, t in rows if t is None or "\x00" not in t]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.train(docs, labels)
    some = {x.doc_id: x.score for x in toxicity.score(docs, model).where("doc_id % 7 = 0").collect()}
    short = [(i, t) for i, t in rows if i in some and len((t or "").split()) < 120]
    assert len(short) > 30 and all(abs(some[i] - model.chance(evidence(model, t))) < 1e-9 for i, t in short)
    left = [(i, t) for i, t in rows if model.chance(model.evidence(toxicity.tokens(t))) < toxicity.THRESHOLD]
    left = [(i, t) for i, t in one_of_each(without_lines(left)) if not contaminated(t, [item])]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
    got = [(x.doc_id, x.text) for x in now.collect()]
    assert sorted(got, key=ORDER) == sorted(left, key=ORDER)
    assert (7002, "a repeated id with words of its own") in got and not any("item29" in (t or "") for _, t in got)
    assert {7000, 7003} <= {i for i, _ in got} and 7001 not in {i for i, _ in got}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in packed if x.piece == 0) == sorted(str(i) for i, _ in left)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (1, ""), (None, None), (None, "")]])
def test_stages_of_empty_and_odd_tables(spark, tmp_path, rows):
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes
    assert now.count() == min(1, len(rows))


def test_columns_of_any_name_come_through_every_stage(spark, tmp_path):
    _, labels = toxic_tables(spark, 60)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*invented(seed=21, n=25), (2, "a row\nof a repeated id"), (2, "a row\nof a repeated id"), (500, "so one two three four five six seven it ends")]
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        for r in out.collect():
            assert (r["_row"], r["_many"], r["_N"], r["_h"], r["_least"], r["_found"], r["_a"], r["_sure"]) == (f"row {r.doc_id}", "many", 0.5, "h", "least", "found", 7, "sure")
