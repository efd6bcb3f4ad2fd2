"""The evidence of a document does not grow with its length."""

import random

from helpers import documents
from test_scores import toxic_tables

from sourcelens.llm import toxicity


def test_long_clean_document_with_scattered_hits(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    model.score |= {b"=hit": 0.6}  # a weak word at the rate of the background
    r = random.Random(2)
    words = r.choices(["plain", "words"], k=20_000)
    for i in range(0, 20_000, 600):
        words[i] = "hit"
    own = [(1, " ".join(words)), (2, " ".join([*words[:10_000], *["nitwit", "vermin", "blockhead"] * 4, *words[10_000:]]))]
    model.rate = 4.3
    got = {x.doc_id: x.predicted for x in toxicity.score(documents(spark, own), model).collect()}
    assert got == {1: 0, 2: 1}
    clean = [b"hit" if k % 600 == 0 else b"plain" for k in range(20_000)]
    assert model.evidence(clean) <= model.evidence(clean[:2_000])
