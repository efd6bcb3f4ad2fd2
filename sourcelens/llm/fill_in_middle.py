"""Fill-in-the-middle transformation by a sparse checkpoint index (operator 11).

A text's units are a run of white space with the word after it, and what white space is left at the end. Counting them
walks the text's bytes window by window and records, every `every` units, the byte and the code point where the next
unit begins. A cut after u units is then found by binary search among these checkpoints and a rescan of the one
stretch between two of them; no list of all units or of all code points ever exists, so a text of any length costs its
own bytes and 24 more for each checkpoint. Rows are worked on where they are read: nothing is shuffled.

Null texts count as empty and are plain, as is a text that holds one of the marks. A null doc_id is drawn as an empty
string, so rows without one (and rows that share one) have the same draws and differ by their texts. Repeated rows each
give a row; an empty table gives none. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sourcelens.llm import common

WINDOW, EVERY = 1 << 20, 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = ("<P>", "<S>", "<M>")


class Cut(NamedTuple):
    byte: int
    point: int


def _unit_ends(data: np.ndarray, begin: int, stop: int) -> np.ndarray:
    """Where units end within (begin, stop], in order; white space at the text's end is one more unit."""
    space = _SPACE[data[begin : stop + 1]]
    if stop == len(data):
        ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1 + begin
        return np.append(ends, stop) if len(space) and space[-1] else ends
    return np.flatnonzero(~space[:-1] & space[1:]) + 1 + begin


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but the continuation bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class CheckpointIndex:
    """Checkpoints of one text: after units[k] units, byte bytes[k] and code point points[k]."""

    def __init__(self, data: np.ndarray, every: int = EVERY, window: int = WINDOW):
        self.data, self.n = data, 0
        units, byte, point = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        seen = 0
        for begin in range(0, len(data), window):
            stop = min(begin + window, len(data))
            ends = _unit_ends(data, begin, stop)
            first = -(-(self.n + 1) // every) * every  # the next multiple of every that this window can reach
            at = ends[first - self.n - 1 :: every]
            lead = np.cumsum((data[begin:stop] & 0xC0) != 0x80, dtype=np.int64)
            units.append(first + every * np.arange(len(at), dtype=np.int64))
            byte.append(at)
            point.append(seen + lead[at - begin - 1])
            seen += int(lead[-1])
            self.n += len(ends)
        self.units, self.bytes, self.points = np.concatenate(units), np.concatenate(byte), np.concatenate(point)

    def cut(self, unit: int) -> Cut:
        """The byte and the code point after so many units."""
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        begin, rest = int(self.bytes[k]), unit - int(self.units[k])
        if not rest:
            return Cut(begin, int(self.points[k]))
        stop = int(self.bytes[k + 1]) if k + 1 < len(self.bytes) else len(self.data)
        end = int(_unit_ends(self.data, begin, stop)[rest - 1])
        return Cut(end, int(self.points[k]) + _points(self.data[begin:end]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of seed:doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes, marks: tuple[bytes, ...]) -> bytes:
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def restored(output: bytes, form: str, marks: tuple[bytes, ...]) -> bytes:
    """The text, from output and form alone: no mark overlaps itself or another, so each stands where it is first found."""
    if form == "plain":
        return output
    p, s, m = marks
    one, two = (p, s) if form == "psm" else (s, p)
    second = output.index(two, len(one))
    third = output.index(m, second + len(two))
    a, b, middle = output[len(one) : second], output[second + len(two) : third], output[third + len(m) :]
    return b"".join((a, middle, b) if form == "psm" else (b, middle, a))


def _transform(seed: int, fim_percent: int, spm_percent: int, marks: tuple[str, ...], every: int, with_output: bool):
    raw_marks = tuple(m.encode() for m in marks)

    def one(doc_id: int | None, data: np.ndarray) -> tuple:
        text = data.tobytes()
        index = CheckpointIndex(data, every)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or h3 % 100 >= fim_percent or any(m in text for m in raw_marks):
            return (index.n, "plain", None, None, text)
        lo, hi = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        a, b = index.cut(lo), index.cut(hi)
        form = "spm" if h4 % 100 < spm_percent else "psm"
        return (index.n, form, a.point, b.point - a.point, arranged(form, text[: a.byte], text[a.byte : b.byte], text[b.byte :], raw_marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                flat, offsets = common.flat_bytes(piece.column("text"))
                ids = piece.column("doc_id").to_pylist()
                rows = [one(None if i == common.NULL_ID else i, flat[a:b]) for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                back = [restored(o, f, raw_marks) for o, f in zip(output, form, strict=True)]
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in own]) for own in (output, back)]
                cols = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *sha]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                if with_output:
                    cols.append(pa.array(output, pa.binary()))
                    names.append("output")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS, every: int = EVERY, with_output: bool = True) -> DataFrame:
    """Per document: doc_id, n units, form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output_sha256, restored_sha256 (and output).

    marks stand for prefix, suffix and middle. None may begin another, and their first characters may stand nowhere
    else in any of them: then no two overlap, and an output tells its text.
    """
    if any(not m or m[0] in o[1:] for m in marks for o in marks) or any(marks[i].startswith(marks[k]) for i in range(3) for k in range(3) if i != k):
        raise ValueError("no mark may begin another, and their first characters may stand nowhere else in them")
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output binary" * with_output
    out = common.unkeyed(common.keyed(docs).mapInArrow(_transform(seed, fim_percent, spm_percent, tuple(marks), every, with_output), kind))
    return out.withColumn("output", out["output"].cast("string")) if with_output else out


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(common.table(spark, sf_dir, "documents"), with_output=False)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:n], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
