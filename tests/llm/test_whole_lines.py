"""Lines of any length take part, and those of each row are its own."""

from helpers import documents

from sourcelens.llm import lines


def test_copies_of_short_lines_go(spark):
    rows = [(1, "Les.\nAnd ornd.\n\nx"), (2, "Les.\nAnd ornd.\n \nLess."), (3, "x\nseven c")]
    got = {r.doc_id: r.removed for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [0]}
    kept = {r.doc_id: r.text for r in lines.without_repeated_lines(documents(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: " \nLess.", 3: "seven c"}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    one, two, three = "first line of some length here", "another line, of other words", "and nothing like the others 42"
    rows = [(1, one), (2, f"{one}\n{two}"), (2, f"{three}\nunique to this row, surely"), (None, two), (None, "rows without any id, number one"), (None, "rows without any id, number one")]
    got = sorted((str(r.doc_id), r.text) for r in lines.without_repeated_lines(documents(spark, rows)).collect())
    # null ids come first, so theirs is the copy of two that stays; of the equal rows one stays
    assert got == sorted([("1", one), ("2", rows[2][1]), ("None", two), ("None", rows[4][1])])
    made = sorted((str(r.doc_id), r.n_lines, r.removed) for r in lines.dedup_lines(documents(spark, rows)).collect())
    assert made == sorted([("1", 1, []), ("2", 2, [0, 1]), ("2", 2, []), ("None", 1, []), ("None", 1, []), ("None", 1, [0])])


def test_lines_of_one_first_hash_are_told_apart(spark, monkeypatch):
    """With first hashes that collide no line goes for another's sake but by the similarity of the texts compared."""
    texts = [f"{w} stands alone in this line of text {k * 7919}" for k, w in enumerate(["alpha", "beta", "gamma", "delta", "omega", "sigma"])]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, t) for k, t in enumerate(texts)]
    real = lines._occurrences
    monkeypatch.setattr(lines, "_occurrences", lambda least: _collided(real(least)))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert all(got[k] == 0 for k in range(6)) and all(got[10 + k] == 1 for k in range(6))


def _collided(run):
    def collide(batches):
        import numpy as np
        import pyarrow as pa

        for b in run(batches):
            h = b.column("h")
            made = pa.array(np.where(np.asarray(h.is_null()), 0, np.asarray(h.fill_null(0)) % 3), mask=np.asarray(h.is_null()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], made, b.columns[4]], b.schema.names)

    return collide
