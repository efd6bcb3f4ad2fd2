"""Licence scan by ordered signature rules (operator 8).

The hand-written rules of license_rules are tried on the lower-case text, white space made single, only where one of the rule's
keywords is there; one Aho-Corasick pass over the text finds all keywords. Detections are taken by priority, then length, then
place; one that lies within the interval of a detection already taken is suppressed. So "lesser general public
license" is no second detection inside a longer grant of the same place.

Suppression keeps the intervals that no other contains, which rise at both ends, and so takes a binary search for each
detection. Texts of any length are scanned whole. Base places are plain word runs and stay whatever the rules say. Null and empty texts have no words, empty labels and
score 0. Rows that repeat a doc_id are scanned apart. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sourcelens.llm import common
from sourcelens.llm.license_rules import Rule, rules

#: phrase: label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_SPACE = re.compile(r"\s+")


class Scanner:
    def __init__(self, own: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if own is None else own
        self.by_key: dict[str, list[Rule]] = {}
        for r in self.rules:
            for k in r.keywords:
                self.by_key.setdefault(k, []).append(r)
        self.keys = ahocorasick.Automaton()
        for k in self.by_key:
            self.keys.add_word(k, k)
        self.keys.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """Detections that stand, as (begin, end, rule) in text with single white space, in order of place."""
        flat = _SPACE.sub(" ", text)
        live = {k for _, k in self.keys.iter(flat)}
        if not live:
            return []
        found = [(m.start(), m.end(), r) for r in {r.name: r for k in live for r in self.by_key[k]}.values() for m in r.pattern.finditer(flat) if m.end() > m.start()]
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name))
        kept: list[tuple[int, int, Rule]] = []
        begins: list[int] = []  # intervals taken, without those inside others: both ends rise
        ends: list[int] = []
        for a, b, r in found:
            at = bisect_right(begins, a)
            if at and ends[at - 1] >= b:
                continue
            kept.append((a, b, r))
            first, last = bisect_left(begins, a), bisect_right(ends, b)
            begins[first:last], ends[first:last] = [a], [b]
        return sorted(kept, key=lambda d: (d[0], d[1]))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every base phrase."""
    out = []
    for phrase, label in BASE.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[-1], at + 1)
            except ValueError:
                break
            first = at - len(parts) + 1
            if first >= 0 and words[first : at + 1] == parts:
                out.append((first, label))
    return out


_SCANNER: list[Scanner] = []
_DETECTION = pa.struct([("rule", pa.string()), ("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])


def _scan(with_detections: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                cols: list[list] = [[] for _ in range(8)]
                for text in piece.column("text").to_pylist():
                    raw = (text or "").encode().lower()
                    words = raw.translate(_WORDS).split()
                    places = base_places(words) if b"license" in raw else []
                    found = _SCANNER[0].detections(raw.decode())
                    base = {label for _, label in places}
                    starts = [p for p, _ in places]
                    row = (
                        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in found})),
                        max([r.confidence for _, _, r in found] + [0.85] * bool(base), default=0.0), [{"rule": r.name, "label": r.label, "begin": a, "end": b, "confidence": r.confidence} for a, b, r in found] if with_detections else None,
                    )
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_DETECTION)]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
                n = 7 + with_detections
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True))], ["doc_id", *names[:n]])

    return run


def scan_licenses(docs: DataFrame, with_detections: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and all detections)."""
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    kind += ", detections array<struct<rule string, label string, begin int, end int, confidence double>>" * with_detections
    return common.unkeyed(common.keyed(docs).mapInArrow(_scan(with_detections), kind))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
