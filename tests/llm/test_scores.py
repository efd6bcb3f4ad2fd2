"""Classifiers, scans and the pipeline."""

import random
import re

import numpy as np
from helpers import documents, invented

import corpus_pipeline
from sourcelens.llm import license_rules, licenses, resampling, toxicity


def segments(values):
    """All maximal scoring subsequences, by the definition: take the best, then look left and right of it."""
    best = max(((sum(values[a:b]), -(b - a), -a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return segments(values[:a]) + [(a, b)] + [(x + b, y + b) for x, y in segments(values[b:])]


def test_segments_are_maximal():
    r = random.Random(4)
    model = toxicity.Model({b"=bad": 2.25, b"=worse": 4.75})
    for _ in range(200):
        words = r.choices([b"fine", b"bad", b"worse"], [6, 2, 1], k=r.randrange(0, 14))
        got = model.segments(words)
        values = [model.of(w) for w in words]
        assert [(a, b) for a, b, _ in got] == segments(values)
        assert all(abs(s - sum(values[a:b])) < 1e-9 for a, b, s in got)


def toxic_tables(spark, n=600):
    r = random.Random(8)
    words = ["".join(r.choice("aeioutrsnl") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text, toxic = r.choices(words, k=r.randrange(5, 80)), int(i % 5 == 0)
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["blockhead", "nitwit", "vermin"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return documents(spark, rows + [(n, None), (n + 1, ""), (n + 2, "nitwit " * 20000)]), spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, with_passages=True)
    known = got.join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert len(known) > 100 and sum(r.predicted == r.toxic for r in known) / len(known) > 0.98
    rest = {r.doc_id: r for r in got.where("doc_id >= 600").collect()}
    assert 0 <= rest[600].score < 0.5 and rest[601].score == rest[600].score and rest[602].predicted == 1 and rest[602].passages
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("predicted = 0").collect()}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 30)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), toxicity.train(docs, labels)).count() == 0


def test_licence_base_places(spark):
    rows = invented(9) + [(200, "Under the MIT License. And again: mit  LICENSE, mit_license; Apache license"), (201, "GNU Lesser General Public License v2.1"), (202, "SPDX-License-Identifier: MPL-2.0"), (203, "permit license"), (204, "İ mit license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows), with_detections=True).collect()}
    for i, t in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) | {""} and 0 <= got[i].score <= 1
    assert got[200].base_labels == "apache,mit" and got[201].labels == "gpl,lgpl" and got[202].labels == "mpl" and got[203].n_base == 0


def test_contained_detections_are_suppressed():
    found = licenses.Scanner().detections("released under the gnu lesser general public license version 3")
    assert [r.label for _, _, r in found] == ["lgpl"] and found[0][2].name.startswith("grant-lgpl")
    assert len(license_rules.rules()) > 240
    assert not licenses.Scanner().detections("copyright 2020 the authors")


def test_detections_against_brute_force():
    """All rules on all texts without keywords, and suppression pair by pair."""
    r, scanner = random.Random(3), licenses.Scanner()
    parts = ["released under the mit license", "gnu lesser general public license, version 2.1 or later", "apache license, version 2.0", "spdx-license-identifier: gpl-2.0-or-later", "license: bsd-3-clause", "https://www.apache.org/licenses/license-2.0", "creative commons attribution-sharealike 4.0", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation", "expat", "mit", "license", "general public license", "some words", "cc by-nc-sa 4.0", "permitted"]
    most = 0
    for _ in range(150):
        text = " ".join(r.choices(parts, k=r.randrange(1, 9)))
        found = [(m.start(), m.end(), rule) for rule in license_rules.rules() for m in rule.pattern.finditer(text)]
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name))
        kept = []
        for a, b, rule in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, rule))
        got = scanner.detections(text)
        assert got == sorted(kept, key=lambda d: (d[0], d[1]))
        most = max(most, len(found) - len(kept))
    assert most > 5


def test_scan_of_no_documents(spark):
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_resampling_prefers_the_target(spark):
    docs, labels = toxic_tables(spark, 400)
    junk = spark.createDataFrame([(1000 + k, "@@@ ### " * 20) for k in range(100)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(junk)
    got = resampling.resample(every, labels.where("quality = 1"), share=0.75).collect()
    assert len(got) == round(0.75 * every.count()) and sum(r.doc_id >= 1000 for r in got) < 5


def test_largest_is_exact_with_ties(spark):
    r = random.Random(5)
    rows = [(i, r.choice([r.gauss(0, 100), 0.0, -0.5, 7.25])) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, key double").mapInArrow(resampling._rank_bits, "doc_id long, key double, bits long")
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (1, 37, 250, 499, 500):
        assert {x.doc_id for x in resampling.largest(table, k).collect()} == {i for i, _ in want[:k]}


def test_largest_keeps_repeated_ids_whole_and_no_more(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.5), (3, 0.5), (4, 9.0)], "doc_id long, key double").mapInArrow(resampling._rank_bits, "doc_id long, key double, bits long")
    got = {k: sorted(x.doc_id for x in resampling.largest(rows, k).collect()) for k in (1, 2, 3, 4, 5)}
    assert got == {1: [4], 2: [1, 1, 4], 3: [1, 1, 4], 4: [1, 1, 2, 4], 5: [1, 1, 2, 3, 4]}


def test_resampling_of_nothing(spark):
    docs, labels = toxic_tables(spark, 5)
    assert resampling.resample(docs.limit(0), labels).count() == 0
    assert resampling.resample(docs, labels.limit(0)).count() == round(0.8 * docs.count())


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs, labels = toxic_tables(spark, 300)
    clean = ["a clean document about number %d with its own words %s" % (k, " ".join(f"u{k}x{j}" for j in range(40))) for k in range(20)]
    planted = [(2000 + k, t) for k, t in enumerate(clean)] + [(3000, clean[0]), (3001, clean[1] + " bench " + " ".join(f"item{j}" for j in range(30)))]
    docs = docs.union(documents(spark, planted))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{j}" for j in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes, name
    left = {r.doc_id for r in now.collect()}
    assert set(range(2000, 2020)) <= left and 3000 not in left and 3001 not in left and not {5, 10, 15, 100} & left
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert np.all(np.array([r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]) <= 1024)
