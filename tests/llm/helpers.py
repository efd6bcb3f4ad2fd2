"""Tables with what operators must withstand, and brute-force versions of the operators."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, h long, block int, gone string, _row string, _many string, _N double, _h string, _least string, _found string, _a long, _sure string"


def documents(spark, rows):
    """rows of (doc_id, text); the other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, 2, 3, "x", f"row {i}", "many", 0.5, "h", "least", "found", 7, "sure") for i, t in rows], SCHEMA)


def invented(seed=1, n=60):
    """Documents of invented words with copies, near copies, ties, repeated rows, nulls, empty and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioutrsnl") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(4, 25))).capitalize() + "."
    shared = [line() for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [line() for _ in range(r.randrange(1, 6))]
        if r.random() < 0.4:
            lines.insert(0, r.choice(shared))
        rows.append((i, "\n".join(lines)))
    rows += [(n + k, rows[k][1]) for k in range(5)]  # exact copies
    for k in range(5, 12):  # near copies: one word of the text changes
        text = rows[k][1].split(" ")
        text[len(text) // 2] = "changed"
        rows.append((n + k, " ".join(text)))
    rows += [(n + 20, None), (n + 21, ""), (n + 22, "   \n\n "), (n + 23, "word"), (n + 24, "é" * 300), (n + 25, "same same " * 900), (None, line()), (3, rows[3][1]), (n + 26, "naïve café 日本語 \x00 <|endoftext|> don't")]
    return rows


def removed_bytes(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by document, by a dictionary of all strings."""
    low = {}
    key = lambda i: -1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            low[s] = min(low.get(s, 1 << 60), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if low[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def components(nodes, pairs):
    """Least node reachable, by node."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
