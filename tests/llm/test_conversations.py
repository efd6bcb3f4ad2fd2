"""Operator 13 against a relaxation over all nodes of the lattice, and its blocks against the whole."""

import hashlib
import random
import re
import zlib

import pytest

from sourcelens.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, fault string, copies int, _first string"
STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def after_damage(rows):
    """Rows by conversation, in order, after damage."""
    by = {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, said(r[2]).encode(), said(r[3]).encode())):
        own = by.setdefault(conv, [])
        role, text = said(role), said(text)
        n = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        own += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return by


def plainly(rows):
    out = []
    for conv, own in after_damage(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        layer = {0: (0, "", ())}  # state: cost, audit, repaired
        for k in range(len(own) + 1):
            for _ in range(6):  # insertions until nothing is cheaper
                for s, (cost, audit, done) in list(layer.items()):
                    (role, to), *_ = [(r, t) for r, t in (("user", STATES[s].get("u")), ("assistant", STATES[s].get("a"))) if t]
                    new = (cost + 3, audit + "I", (*done, f"{role}:"))
                    layer[to] = min(layer.get(to, new), new, key=lambda w: w[:2])
            if k == len(own):
                break
            (_, role, text), fault, nxt = own[k], faults[k], {}
            for s, (cost, audit, done) in layer.items():
                ways = [(s, (cost + 4, audit + "D", done))]
                if fault in ("", "truncated"):
                    more = 3 * (fault == "truncated")
                    if role[:1] in STATES[s]:
                        ways.append((STATES[s][role[:1]], (cost + more, audit + "K", (*done, f"{role}:{text}"))))
                    ways += [(STATES[s][r[0]], (cost + 3 + more, audit + "R", (*done, f"{r}:{text}"))) for r in ("user", "assistant") if r[0] in STATES[s]]
                for to, new in ways:
                    nxt[to] = min(nxt.get(to, new), new, key=lambda w: w[:2])
            layer = nxt
        cost, audit, done = min((layer[s] for s in (0, 3) if s in layer), key=lambda w: w[:2])
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, n, most=9):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", ("user", "assistant")[turn % 2], ("user", "assistant")[turn % 2], "system", None, "", "tool"])
            rows.append((conv, r.choice([turn, turn, turn + 1, None]), role, r.choice(["Yes.", "No!", "so", "", " \t", None, f"It is {turn}?", f"words {r.random()}. ", "\x1c", "end.\x0b", "a.\nb"])))
    rows += [(None, 1, "user", "Who?"), (None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (n, None, None, None), (n + 1, 5, "assistant", "Same.")]
    rows += [(n + 1, 5, "assistant", "Same.")] * 9
    gone = next(k for k in range(n + 2, n + 900) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "All of it goes.")] * 2
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def got(out):
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_rows_equal_a_relaxation(spark):
    rows = invented(1, 250)
    out = cv.repair(frame(spark, rows))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(out) == plainly(rows)
    assert any(o[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for o in plainly(rows))  # nothing left after damage
    assert cv.repair(frame(spark, [])).count() == 0


def test_conversations_over_many_blocks_and_parts(spark, monkeypatch):
    r = random.Random(4)
    long = [(7, t if r.random() < 0.97 else None, r.choice(["user", "assistant", ("user", "assistant")[t % 2], "system"]), r.choice(["Yes.", "No!", "so", "", f"It is {t % 50}?", f"It is {t}."])) for t in range(1500)]
    rows = invented(6, 60) + long + [(8, 0, "user", "Hot.")] * 1200 + [(9, k, "user", "Same again.") for k in range(700)]
    want = plainly(rows)
    monkeypatch.setattr(cv, "BLOCK_ROWS", 40)
    for part_bytes in (3_000, 1 << 20):
        assert got(cv.repair(frame(spark, rows), part_bytes=part_bytes)) == want


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rows = invented(3, 40, 30)
    by = {}
    for t in cv.repaired_turns(frame(spark, rows), part_bytes=2_000).orderBy("part", "block", "place").collect():
        by.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    assert {o[0]: o[8] for o in plainly(rows)} == {c: hashlib.sha256("\n".join(by.get(c, [])).encode()).hexdigest() for c in {r[0] for r in rows}}


def test_undamaged_conversations_stay(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "First.")]
    assert {r.conv_id: (r.cost, r.audit) for r in cv.repair(frame(spark, rows), damage=False).collect()} == {1: (0, "KKK"), 2: (3, "IK")}


@pytest.mark.parametrize("audit,entry", [("KIRD", 0)])
def test_edits_write_roles_by_state(audit, entry):
    rows = [("user", "sound", 1), ("user", "sound", 1), ("tool", "blank", 1)]
    assert [t[:2] for t in cv.repaired(rows, ["a.", "b.", ""], entry, audit)] == [("user", "a."), ("assistant", ""), ("user", "b.")]
