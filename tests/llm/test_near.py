"""Near-duplicate operators against brute force."""

import numpy as np
import pytest
import xxhash
from helpers import components, documents, invented

from sourcelens.llm import benchmark, common, lines, simhash, vectors


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("cell", [3, 4096])
def test_simhash_components(spark, cell, monkeypatch):
    rows = invented(5)
    monkeypatch.setattr(simhash.near_components, "__defaults__", (simhash.RADIUS, cell))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = {i: fingerprint(t) for i, t in rows}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in got) and len(got) == len(rows)
    key = lambda i: -1 if i is None else i
    near = [(key(a), key(b)) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components([key(i) for i in prints], near)
    assert all(want[key(r.doc_id)] == key(r.component_id) for r in got)


def test_covering_masks_hide_any_four_bits():
    masks = [m & (2**64 - 1) for m in simhash.masks()]
    r = np.random.default_rng(1)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(not m & bits for m in masks)
    assert len(masks) == 31


def test_chains_of_fingerprints_join(spark):
    chain, x = [], 0
    for k in range(40):
        x ^= 0b1111 << (k % 16 * 4)
        chain.append((100 - k, x - (1 << 64) if x >> 63 else x))
    got = simhash.near_components(spark.createDataFrame(chain, "doc_id long, fp long"), cell=5).collect()
    fp = {i: f & (2**64 - 1) for i, f in chain}
    want = components(list(fp), [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [4, 4096])
def test_vector_links(spark, cell):
    r = np.random.default_rng(2)
    centers = r.standard_normal((12, 16))
    rows = [(int(i), (centers[r.integers(12)] + r.standard_normal(16) * 0.12).astype(np.float32).tolist(), int(r.integers(3))) for i in range(220)]
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], None), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1), (305, [float("inf")] + [1.0] * 15, 1), (306, [None] + [1.0] * 15, 1), (307, [1.0, 0.0], 1), (308, [2.0, 0.0], 1), (309, [x * 1e-30 for x in rows[1][1]], rows[1][2]), (310, [], 1)]
    table = spark.createDataFrame([(i, v, k, 5) for i, v, k in rows], "vec_id long, embedding array<float>, label int, node long")
    got = {x.vec_id: x for x in vectors.near_vectors(table, cell=cell).collect()}
    clean = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, np.float32))]
    links = [(i, j) for i, v, k in clean for j, w, m in clean if i != j and k == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93]
    assert len(links) > 100
    want = components([i for i, _, _ in rows], links)
    for i, _, _ in rows:
        assert got[i].n_links == sum(1 for a, _ in links if a == i), i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)


def test_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def jaccard(a, b):
    a, b = ({x[k : k + 5] for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("cell", [2, 2000])
def test_line_components(spark, cell):
    rows = invented(6) + [(500 + k, "The quick brown fox jumps over the lazy dog and runs away number %d." % k) for k in range(8)]
    rows += [(3, "only in the second row of three\n" + rows[0][1]), (None, rows[4][1]), (None, None)]
    got = [(r.doc_id, r.n_lines, r.removed) for r in lines.dedup_lines(documents(spark, rows), cell=cell).collect()]
    rows = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))  # rows that share an id are told apart by their text
    places = [(p, k, x) for p, (_, t) in enumerate(rows) for k, x in enumerate(lines.split_lines(t)) if len(x) >= lines.MIN_CHARS]
    texts = sorted({x for _, _, x in places})
    want = components(texts, [(a, b) for a in texts for b in texts if a < b and jaccard(a, b) >= 0.8])
    first = {}
    for p, k, x in places:
        first.setdefault(want[x], (p, k))
    made = [(i, len(lines.split_lines(t)), [k for d, k, x in places if d == p and first[want[x]] != (p, k)]) for p, (i, t) in enumerate(rows)]
    assert sorted(map(str, got)) == sorted(map(str, made))


def test_texts_without_their_repeated_lines(spark):
    one, two = "a line that is long enough to count", "another line, also of good length"
    docs = documents(spark, [(1, f"{one}\n\nshort\n{two}"), (2, f"{two}\n{one}"), (3, f"x\n{one}"), (4, None), (5, ""), (None, "nothing of this was seen before")])
    got = lines.without_repeated_lines(docs)
    assert got.schema.names == docs.schema.names
    assert sorted((str(r.doc_id), r.text, r.n_chars, r.gone) for r in got.collect()) == sorted([("1", f"{one}\n\nshort\n{two}", 76, "x"), ("3", "x", 1, "x"), ("4", None, None, "x"), ("5", "", 0, "x"), ("None", "nothing of this was seen before", 31, "x")])


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_similar_lines_share_a_band():
    r = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    found = n = 0
    for _ in range(300):
        a = "".join(r.choice(letters, 200))
        k = int(r.integers(0, 190))
        b = a[:k] + "#" * 6 + a[k + 6 :]
        n += 1
        found += bool((lines.band_keys(lines.signatures([a, b]))[0] == lines.band_keys(lines.signatures([a, b]))[1]).any())
    assert found / n > 0.99


def test_contained_items(spark):
    text = " ".join(f"word{k}" for k in range(40))
    items = [(1, text), (2, "Only three words"), (3, None), (4, ""), (5, "one two three four five six seven"), (6, "?!")]
    docs = [(10, f"before it, {text.upper()}; and after"), (11, " ".join(text.split()[:36])), (12, " ".join(text.split()[:20])), (13, "so only, three... WORDS here"), (14, None), (15, ""), (16, "one two three four five six 7 " * 50), (None, text)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h long")
    got = benchmark.contained_items(documents(spark, docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 1), (11, 1), (13, 2), (None, 1)}
    assert {r.doc_id for r in benchmark.clean_of(documents(spark, docs), table).collect()} == {12, 14, 15, 16}
    assert benchmark.contained_items(documents(spark, []), table).count() == 0
    assert benchmark.contained_items(documents(spark, docs), table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_containment_against_brute_force(spark, most, monkeypatch):
    """Joined by broadcast and by shuffle; candidates come from sketches alone and miss no pair."""
    monkeypatch.setattr(benchmark, "BROADCAST_HASHES", most)
    r = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(words, int(n)))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 30, 80, 200])] + [(3, "again w1 w2"), (11, None)]
    docs = []
    for i in range(80):
        text = " ".join(r.choice(words, 40))
        for _ in range(int(r.integers(0, 3))):
            own = items[int(r.integers(0, 10))][1].split()
            if r.random() < 0.6:
                own[int(r.integers(0, len(own)))] = "changed"
            text += " ... " + " ".join(own).upper() + " " + " ".join(r.choice(words, 20))
        docs.append((i % 70, text))

    def sets(rows):
        out = {}
        for i, t in rows:
            out.setdefault(i, []).append((t or "").lower().replace(".", " ").split())
        return out

    def runs(ws, k):
        return {tuple(w[a : a + k]) for w in ws for a in range(len(w) - k + 1)}

    want = set()
    for item, ws in sets(items).items():
        own = set().union(*(runs([w], min(5, len(w))) for w in ws if w))
        for doc, dw in sets(docs).items():
            n = sum(x in runs(dw, len(x)) for x in own)
            if own and n >= np.ceil(len(own) * 0.8):
                want.add((doc, item, n, len(own)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_shared, x.n_shingles) for x in benchmark.contained_items(documents(spark, docs), table).collect()}
    assert got == want and len(want) > 40


def test_no_python_in_the_native_plan(spark):
    table = spark.createDataFrame([(1, "a b c d e f", 1)], "item_id long, text string, h long")
    docs = documents(spark, [(1, "a b c d e f")])
    for df in (benchmark.contained_items(docs, table), benchmark.candidates(common.keyed(docs), benchmark.item_index(table))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_union_find_on_random_graphs(spark):
    r = np.random.default_rng(7)
    for n, m in ((50, 30), (400, 380), (300, 900)):
        edges = [(int(a), int(b)) for a, b in r.integers(0, n, (m, 2))]
        got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = components(range(n), edges)
        assert all(got.get(k, k) == want[k] for k in range(n))
