"""Repair of damaged conversations by Dijkstra on an edit lattice (operator 13).

A node is (turn index, grammar state): how many rows of a conversation are dealt with, and where in `(s?(ua)+)?` the role
initials written so far end. Keep, Rerole, Delete and Insert are its edges. The queue is ordered by (cost, audit), the
audit being the initials of the edits so far, and the search stops at the first accepting end node that it pops. At one
node an audit never begins another of the same cost (it would have made fewer insertions, and those cost), so the order
of prefixes is the order of whole audits.

Equal rows of a conversation are counted into one before anything else, rows are dealt by ranges of (conversation, turn,
role, text), and a task cuts what it has of a conversation into blocks of bounded rows and bytes. A conversation that is
one block is repaired there. Of a longer one, or one that two tasks share, every block is searched from each of the four
states, and a second pass composes blocks in order, carrying only the four best ends; so a conversation of any length,
with any share of all rows, is bounded work a task. What remains in order by nature is the digest of a repaired
conversation, a sha256 over all of it: that streams through one task, block by block.

Nulls in turn come first, null roles and texts count as one space, rows without a conv_id are one conversation. Rows of
one turn are in order of role and text; equal rows are kept as often as they occur. Empty texts are blank. A conversation
whose rows are all dropped, or none of whose rows can stay, has an empty repair; an empty table gives no rows. Columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing written, after s, after u, after a; the role that is written next by Rerole and Insert.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = ("user", "user", "assistant", "user")
ACCEPTING = (NOTHING, ASSISTANT)
_AFTER = {"user": USER, "assistant": ASSISTANT}
#: Faults of a row, in the order in which they count.
GONE, BLANK, DUPLICATE, CUT_SHORT, SOUND = "dropped", "blank", "duplicate", "truncated", "sound"
#: Rows, and characters of text, of a block.
BLOCK_ROWS, BLOCK_CHARS = 512, 4 << 20
_LEGAL = ("su", "ua", "au")


def _kept(state: int, role: str) -> int | None:
    """The state after a row that stays as it is, if the grammar lets it."""
    initial = role[:1]
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return USER if initial == "u" and state != USER else None


def ends_from(rows: list[tuple[str, str, int]], entry: int, accepting: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) to end nodes over rows of (role, fault, copies): the first accepting one alone, or all four.

    Of a row's copies all but the first are duplicates, and of a blank row all are blank, so those are deleted at once:
    an insertion between them has a lesser audit before or after them.
    """
    found: dict[int, tuple[int, str]] = {}
    done: set[tuple[int, int]] = set()
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if accepting and state in ACCEPTING:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
            if len(found) == 4:
                break
        else:
            role, fault, copies = rows[at]
            others = DELETE * (copies - 1), "D" * (copies - 1)
            if fault in (CUT_SHORT, SOUND):
                more = others[0] + TRUNCATED * (fault == CUT_SHORT)
                kept = _kept(state, role)
                if kept is not None:
                    heapq.heappush(queue, (cost + KEEP + more, audit + "K" + others[1], at + 1, kept))
                heapq.heappush(queue, (cost + REROLE + more, audit + "R" + others[1], at + 1, _AFTER[NEXT_ROLE[state]]))
            heapq.heappush(queue, (cost + DELETE + others[0], audit + "D" + others[1], at + 1, state))
        heapq.heappush(queue, (cost + INSERT, audit + "I", at, _AFTER[NEXT_ROLE[state]]))
    return found


def repaired(rows: list[tuple[str, str, int]], texts: list[str], entry: int, audit: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, index of the row or -1) of what the edits of an audit write, from the grammar state they start in."""
    state, at, copy = entry, 0, 0
    for edit in audit:
        if edit == "I":
            role = NEXT_ROLE[state]
            yield role, "", -1
            state = _AFTER[role]
            continue
        if edit == "K":
            yield rows[at][0], texts[at], at
            state = _kept(state, rows[at][0])
        elif edit == "R":
            role = NEXT_ROLE[state]
            yield role, texts[at], at
            state = _AFTER[role]
        copy += 1
        if copy == rows[at][2]:
            at, copy = at + 1, 0


# --- damage and faults: built-in functions ------------------------------------------------------------------------

SPACES = r"[\x20\x09-\x0D]"


def damage_number(conv_id: Column, turn: Column) -> Column:
    """What befalls a row: crc32 of `conv_id:turn` modulo 20; nulls are one space."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20


def damaged(rows: DataFrame, damage: bool = True) -> DataFrame:
    """Distinct rows after damage (or none): conv_id, turn, role0 and text0 (before it), role, text, copies (0: dropped)."""
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), said("role").alias("role0"), said("text").alias("text0"))
    own = own.groupBy("conv_id", "turn", "role0", "text0").agg(F.count(F.lit(1)).alias("copies"))
    n = damage_number(F.col("conv_id"), F.col("turn")) if damage else F.lit(19)
    text = F.when(n == 1, "").when(n == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0"))
    return own.select("conv_id", "turn", "role0", "text0", F.when(n == 4, "user").otherwise(F.col("role0")).alias("role"), text.alias("text"), F.when(n == 0, 0).when(n == 3, F.col("copies") * 2).otherwise(F.col("copies")).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows of damaged() with the fault of the first copy of each; a dropped row keeps its conversation and no text.

    The first row of each (conversation, role, text) is an aggregate, and rows learn by their own whole key, which no
    two share, whether they are it; so neither a conversation nor a text that it repeats ever meets in one task.
    """
    key = ["turn", "role0", "text0"]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    first = rows.where((F.col("copies") > 0) & ~blank).groupBy("conv_id", "role", "text").agg(F.min(F.struct(*key)).alias("_f"))
    first = first.select(F.col("conv_id").alias("_conv"), *(F.col("_f")[c].alias(f"_{c}") for c in key))
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role0") == F.col("_role0")) & (F.col("text0") == F.col("_text0"))
    gone = F.col("copies") == 0
    fault = F.when(gone, GONE).when(blank, BLANK).when(F.col("_role0").isNull(), DUPLICATE).when(~F.col("text").rlike(rf"[.!?]{SPACES}*\z"), CUT_SHORT).otherwise(SOUND)
    text = lambda c: F.when(gone, "").otherwise(F.col(c)).alias(c)
    return rows.join(first, on, "left").select("conv_id", "turn", "role0", text("text0"), "role", text("text"), "copies", fault.alias("fault"))


# --- blocks, searched where their rows lie ------------------------------------------------------------------------

_ENDS = "array<struct<entry int, exit int, cost long, audit string>>"
_STATS = "n_rows long, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long"
BLOCKS = f"conv_id long, part int, block int, whole boolean, {_STATS}, ends {_ENDS}, roles array<string>, copies array<long>, texts array<string>, sha256 string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.texts, self.size = conv_id, [], [], 0
        self.low = self.high = self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT_SHORT), 0)

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += (self.last is not None and self.last + initial not in _LEGAL) + copies - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if fault in self.faults:
            self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        self.rows.append((role, fault, copies))
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.size >= BLOCK_CHARS

    def row(self, part: int, block: int, whole: bool, with_texts: bool) -> tuple:
        entries = (NOTHING,) if whole else range(4)
        ends = [(entry, leave, *best) for entry in entries for leave, best in ends_from(self.rows, entry, whole).items()]
        sha = _digest(repaired(self.rows, self.texts, NOTHING, ends[0][3])) if whole else None
        stats = (len(self.rows), self.low, self.high, self.turns, self.first, self.last, *self.faults.values(), self.illegal)
        kept = ([r[0] for r in self.rows], [r[2] for r in self.rows], self.texts) if with_texts or not whole else (None, None, None)
        return (self.conv_id, part, block, whole, *stats, [dict(zip(("entry", "exit", "cost", "audit"), e, strict=True)) for e in ends], *kept, sha)


def _digest(turns: Iterator[tuple[str, str, int]]) -> str:
    sha = hashlib.sha256()
    for k, (role, text, _) in enumerate(turns):
        sha.update(("\n" * (k > 0) + role + ":" + text).encode())
    return sha.hexdigest()


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_KINDS[_ENDS] = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _arrow(schema: str) -> pa.Schema:
    own = [c.strip().split(" ", 1) for c in schema.replace(_ENDS, "ENDS").split(",")]
    return pa.schema([(name, _KINDS[_ENDS if kind == "ENDS" else kind]) for name, kind in own])


def _batches(rows: Iterator[tuple], schema: str, size) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes."""
    kinds, held, total = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > 4 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.types, strict=True)], names=kinds.names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.types, strict=True)], names=kinds.names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _search(with_texts: bool):
    """Blocks of a sorted partition. Its first and its last conversation may go on in other partitions, so they are left open."""

    def blocks(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
        now, number, opened = None, 0, True  # opened: the conversation has a part elsewhere, as far as one can know
        for conv_id, turn, role, text, copies, fault in rows:
            if now is not None and (conv_id != now.conv_id or now.full()):
                same = conv_id == now.conv_id
                yield now.row(part, number, not opened and not same, with_texts)
                number, opened, now = number + 1, same, None
            now = now or _Block(conv_id)
            now.add(turn, role, text, copies, fault)
        if now is not None:
            yield now.row(part, number, False, with_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _batches(blocks(_rows(batches), part), BLOCKS, lambda r: sum(map(len, r[17] or ())) + 64)

    return run


def searched(conversations: DataFrame, damage: bool = True, with_texts: bool = False, part_bytes: int = 8 << 20) -> DataFrame:
    """Blocks of all conversations with what the search found, written; rows of the whole ones only where asked for."""
    conversations.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.ARROW_BYTES))
    rows = common.cut(with_faults(damaged(conversations, damage)), "turns")
    parts = common.parts_for(rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0], part_bytes)
    key = ["conv_id", "turn", "role0", "text0"]
    own = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("conv_id", "turn", "role", "text", "copies", "fault")
    out = common.cut(own.mapInArrow(_search(with_texts), BLOCKS), "blocks")
    common.drop(rows)
    return out


# --- composition of what is open ----------------------------------------------------------------------------------

CHOSEN = f"conv_id long, part int, block int, entry int, exit int, {_STATS}, cost long"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by conversation and place: entry and exit of each, and on the first the whole's counts and cost.

    The four ends so far carry their audits without what all of them begin with, which no comparison needs.
    """

    def chosen(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, places, back, ends, stats = None, [], [], {}, None

        def closed() -> Iterator[tuple]:
            state = min((e for e in ends.items() if e[0] in ACCEPTING), key=lambda e: e[1])[0]
            cost, path = ends[state][0], []
            for came in reversed(back):
                path.append((came[state], state))
                state = came[state]
            for k, (place, (entry, leave)) in enumerate(zip(places, reversed(path), strict=True)):
                yield (conv, *place, entry, leave, *(stats if k == 0 else [None] * len(stats)), cost if k == 0 else None)

        for conv_id, part, block, *own, found in rows:
            if stats is None or conv_id != conv:
                if stats is not None:
                    yield from closed()
                conv, places, back, ends, stats = conv_id, [], [], {NOTHING: (0, "")}, None
            stats = own if stats is None else _joined(stats, own)
            best: dict[int, tuple[int, str, int]] = {}
            for e in found:
                if e["entry"] in ends:
                    cost, audit = ends[e["entry"]]
                    way = (cost + e["cost"], audit + e["audit"], e["entry"])
                    if e["exit"] not in best or way < best[e["exit"]]:
                        best[e["exit"]] = way
            shared = len(os.path.commonprefix([w[1] for w in best.values()]))
            ends = {leave: (cost, audit[shared:]) for leave, (cost, audit, _) in best.items()}
            places.append((part, block))
            back.append({leave: w[2] for leave, w in best.items()})
        if stats is not None:
            yield from closed()

    yield from _batches(chosen(_rows(batches)), CHOSEN, lambda r: 128)


def _joined(a: list, b: list) -> list:
    """Counts of two neighbouring stretches of a conversation."""
    n, low, high, turns, first, last, *counts, illegal = a
    n2, low2, high2, turns2, first2, last2, *counts2, illegal2 = b
    between = n > 0 and n2 > 0 and last + first2 not in _LEGAL
    turns += turns2 - (high is not None and high == low2)
    return [n + n2, low if low is not None else low2, high2 if high2 is not None else high, turns, first if n else first2, last2 if n2 else last, *(x + y for x, y in zip(counts, counts2, strict=True)), illegal + illegal2 + between]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and audit of open conversations from their blocks in order; a conversation's texts pass by block by block."""

    def summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, head, audits, sha, wrote = None, None, [], None, False
        for conv_id, entry, cost, n, low, high, turns, blank, duplicate, truncated, illegal, roles, copies, texts, audit in rows:
            if head is None or conv_id != conv:
                if head is not None:
                    yield (*head, "".join(audits), sha.hexdigest())
                gaps = 0 if low is None else high - low + 1 - turns
                conv, head, audits, sha, wrote = conv_id, (conv_id, gaps, blank, duplicate, truncated, illegal, cost), [], hashlib.sha256(), False
            audits.append(audit)
            for role, text, _ in repaired([(r, "", c) for r, c in zip(roles, copies, strict=True)], texts, entry, audit):
                sha.update(("\n" * wrote + role + ":" + text).encode())
                wrote = True
        if head is not None:
            yield (*head, "".join(audits), sha.hexdigest())

    yield from _batches(summaries(_rows(batches)), SUMMARY, lambda r: len(r[7]) + 128)


def _decided(blocks: DataFrame) -> DataFrame:
    """Open blocks with entry, cost and counts (on a conversation's first) and the audit of the way through them."""
    open_ones = blocks.where(~F.col("whole"))
    stats = [c.split()[0] for c in _STATS.split(", ")]
    parts = common.parts_for(open_ones.count(), 4096)
    own = open_ones.select("conv_id", "part", "block", *stats, "ends").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "block")
    chosen = common.cut(own.mapInArrow(_compose, CHOSEN), "chosen")
    rows = open_ones.select("part", "block", "ends", "roles", "copies", "texts").join(chosen, ["part", "block"])
    way = F.filter("ends", lambda e: (e["entry"] == F.col("entry")) & (e["exit"] == F.col("exit")))[0]
    return rows.withColumn("audit", way["audit"])


def repair(conversations: DataFrame, damage: bool = True, part_bytes: int = 8 << 20) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    damage: whether rows are first damaged by their crc32, or taken as they are.
    """
    blocks = searched(conversations, damage, part_bytes=part_bytes)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = blocks.where("whole").select("conv_id", gaps, *counts, F.col("ends")[0]["cost"].alias("cost"), F.col("ends")[0]["audit"].alias("audit"), F.col("sha256").alias("repaired_sha256"))
    rows = _decided(blocks)
    parts = common.parts_for(blocks.where(~F.col("whole")).count(), 64)
    names = ["conv_id", "entry", "cost", "n_rows", "low", "high", "turns", *counts, "roles", "copies", "texts", "audit"]
    rest = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "block").select(*names).mapInArrow(_finish, SUMMARY)
    return whole.union(rest)


TURNS = "conv_id long, part int, block int, place int, role string, text string"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def turns() -> Iterator[tuple]:
        for conv_id, part, block, entry, audit, roles, copies, texts in _rows(batches):
            for place, (role, text, _) in enumerate(repaired([(r, "", c) for r, c in zip(roles, copies, strict=True)], texts, entry, audit)):
                yield conv_id, part, block, place, role, text

    yield from _batches(turns(), TURNS, lambda r: len(r[5]) + 64)


def repaired_turns(conversations: DataFrame, damage: bool = True, part_bytes: int = 8 << 20) -> DataFrame:
    """The repaired conversations themselves: conv_id, role and text, in order of part, block, place."""
    blocks = searched(conversations, damage, with_texts=True, part_bytes=part_bytes)
    names = ["conv_id", "part", "block", "entry", "audit", "roles", "copies", "texts"]
    whole = blocks.where("whole").withColumn("entry", F.lit(NOTHING)).withColumn("audit", F.col("ends")[0]["audit"])
    return whole.select(*names).union(_decided(blocks).select(*names)).mapInArrow(_written, TURNS)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations"))
