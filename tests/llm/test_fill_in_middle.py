"""Operator 11 against a version by lists of units, and its index against all cuts."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import documents, invented

from sourcelens.llm import fill_in_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text))


ROWS = [
    *invented(seed=5, n=50), (900, "a <P> b"), (901, "x<S"), (902, "<M>"), (903, " \t\n"), (904, " lead and trail \r\n"), (905, "é" * 40 + " ü\x0b日 本\x85x y"), (906, "one"),
    (907, "no_space" * 5000), (908, "a " * 30_000), (None, None), (None, "some words without an id"), (909, "< P > <"), (910, "\x00 \x1c \x1f"),
]


def test_rows_equal_those_of_lists(spark):
    got = [tuple(r) for r in fim.fill_in_middle(documents(spark, ROWS)).drop("output").collect()]
    assert sorted(got, key=repr) == sorted((plainly(*r) for r in ROWS), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


def test_output_holds_the_text_and_marks_of_ones_own(spark):
    out = fim.fill_in_middle(documents(spark, ROWS), seed=7, fim_percent=100, spm_percent=0, marks=("[pre]", "[suf]", "[mid]")).collect()
    texts = {sha(t or "") for _, t in ROWS}
    assert {r.form for r in out} == {"psm", "plain"} and all(r.restored_sha256 in texts and sha(r.output) == r.output_sha256 for r in out)
    assert all(r.output.startswith("[pre]") for r in out if r.form == "psm")
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>"), ("x<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(documents(spark, []), marks=bad)


@pytest.mark.parametrize("every,window", [(1, 1), (3, 5), (4, 7), (64, 1 << 20)])
def test_every_cut_of_the_index(every, window):
    r = random.Random(9)
    for text in ["", " ", "a", " a", "a ", *("".join(r.choice(" \t\nab日é\x1c") for _ in range(r.randrange(60))) for _ in range(120))]:
        index = fim.CheckpointIndex(np.frombuffer(text.encode(), np.uint8), every, window)
        units = UNITS.findall(text)
        assert index.n == len(units)
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.cut(u) == (len(before.encode()), len(before))
        assert len(index.units) <= len(units) // every + 1  # sparse


def test_sql(spark):
    docs = documents(spark, ROWS).select("doc_id", "text").where("text is null or not contains(text, chr(0))")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cur = con.execute(fim.OP11_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert want == sorted((tuple(r) for r in fim.fill_in_middle(docs).select(*names).collect()), key=repr)
