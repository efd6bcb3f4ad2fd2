"""Fuzzy line deduplication by MinHash (operator 2).

Lines are stripped of white space at both ends; every line that is not blank takes part. A line's set is its
five-character shingles; a shorter line has none and is similar to its exact copies only. Signatures are one-permutation MinHashes with optimal densification, 14 bands of 5: at a
Jaccard similarity of 0.8 a pair shares a band with probability 0.996. Lines that share a band meet in bounded cells
with their texts, the exact Jaccard similarity decides, and a cell hands on a spanning forest of its links. A
distributed union-find joins them; of each component the occurrence with the least (doc_id, row, line number) stays.

Equal lines are one node, by two hashes of 128 bits together, so none is taken for another. Candidates, links and
components name a line by the first of its hashes alone: of different lines with one such hash (some 27,000 of 10**12
lines) the links are those of the one with the least second hash, and the others go with their exact copies only.
Texts of any length are read whole, in slices. Null texts have no lines; a blank line is never removed; rows that repeat
a doc_id, or have none, are documents of their own, in order of their text. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

SIMILARITY, SHINGLE, BANDS, BAND_ROWS, MIN_CHARS = 0.8, 5, 14, 5, 1
_U = np.uint64
_rng = np.random.default_rng(5)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_ODD32 = _ODD.astype(np.uint32)
BINS, _BLOCK = BANDS * BAND_ROWS, 1 << 15
_DONORS = np.random.default_rng(6).integers(0, BINS, (BINS, 200))
EMPTY = np.uint32(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _mix32(h: np.ndarray, spare: np.ndarray) -> None:
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(h, np.uint32(shift), out=spare)
        h ^= spare
        if odd:
            h *= np.uint32(odd)


def signatures(lines: list[str]) -> np.ndarray:
    """A row of 70 minima for each line; every line has SHINGLE characters at least.

    A shingle's 32-bit hash names its bin with the upper half and is ranked there by a product that permutes it.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, ends = len(code) - SHINGLE + 1, np.cumsum(size)
    first = np.repeat(np.arange(len(lines)) * BINS, size)[:n]
    across = (ends[:-1, None] - np.arange(1, SHINGLE)).ravel()  # shingles that begin in one line and end in the next
    across.sort()
    out = np.full(len(lines) * BINS, EMPTY, np.uint32)
    for a in range(0, n, _BLOCK):  # in blocks that stay in a core's cache
        b = min(n, a + _BLOCK)
        h, spare = code[a:b] * _ODD32[0], np.empty(b - a, np.uint32)
        for k in range(1, SHINGLE):
            np.multiply(code[a + k : b + k], _ODD32[k], out=spare)
            h += spare
        _mix32(h, spare)
        np.right_shift(h, np.uint32(16), out=spare)
        spare *= np.uint32(BINS)
        spare >>= np.uint32(16)
        h *= _ODD32[SHINGLE]
        h[across[np.searchsorted(across, a) : np.searchsorted(across, b)] - a] = EMPTY
        np.minimum.at(out, first[a:b] + spare, h)
    return densified(out.reshape(-1, BINS))


def densified(out: np.ndarray) -> np.ndarray:
    """Rows of minima whose empty bins take those of other bins of the row."""
    own = out.copy()
    row, bin_ = np.nonzero(own == EMPTY)
    for t in range(_DONORS.shape[1]):
        if not len(row):
            break
        got = own[row, _DONORS[bin_, t]]
        out[row, bin_] = got
        left = got == EMPTY
        row, bin_ = row[left], bin_[left]
    if len(row):
        out[row, bin_] = own[row].min(axis=1)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each line and band."""
    wide = sig.astype(_U).reshape(len(sig), BANDS, BAND_ROWS)
    return _mix((wide * _ODD[10 : 10 + BAND_ROWS]).sum(axis=2) + np.arange(BANDS, dtype=_U) * _ODD[30])


def split_lines(text: str | None) -> list[str]:
    return [] if text is None else [x.strip() for x in text.split("\n")]


def line_hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each line as two columns: its name among candidates, and what tells it from others of that name."""
    raw = b"".join(map(xxhash.xxh3_128_digest, lines))
    return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                docs, rows, numbers, found = [], [], [], []
                for d, r, text in zip(piece.column("doc_id").to_pylist(), piece.column("_row").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    own = split_lines(text)
                    kept = [k for k, line in enumerate(own) if len(line) >= least]
                    docs += [d] * (len(kept) + 1)
                    rows += [r] * (len(kept) + 1)
                    numbers.append(-len(own) - 1)  # a row for the document itself: how many lines it has
                    numbers += kept
                    found.append(None)
                    found += [own[k] for k in kept]
                whole = np.fromiter((x is None for x in found), bool, len(found))
                hashes = np.zeros((len(found), 2), np.int64)
                hashes[~whole] = line_hashes([x for x in found if x is not None])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), *(pa.array(hashes[:, k], mask=whole) for k in (0, 1))], ["doc_id", "row", "line", "h", "h2"])

    return run


#: Lines that a task remembers at most, so as to hand on each but once; beyond, it begins anew.
REMEMBERED = 400_000


def _distinct(piece: pa.RecordBatch, least: int, seen: set[bytes]) -> tuple[np.ndarray, list[str]]:
    """The distinct lines that take part, have shingles and were not seen before, and their hashes."""
    least = max(least, SHINGLE)
    found = list({line: None for text in piece.column("text").to_pylist() for line in split_lines(text) if len(line) >= least})
    digests = list(map(xxhash.xxh3_128_digest, found))
    new = [k for k, d in enumerate(digests) if d not in seen]
    if len(seen) > REMEMBERED:
        seen.clear()
    seen.update(digests)
    raw = b"".join(digests[k] for k in new)
    return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2), [found[k] for k in new]


def _bands(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in common.slices(batch, "text", 2 << 20):
                h, found = _distinct(piece, least, seen)
                if found:
                    keys = band_keys(signatures(found))
                    h = np.repeat(h[:, 0], BANDS)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(h)], ["key", "h"])

    return run


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                h, found = _distinct(piece, least, seen)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(found, pa.string())], ["h", "h2", "line_text"])

    return run


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and h, the distinct ones whose key has two h or more; holds one row besides the batch."""
    key, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    told = False  # the held row has been handed on already

    def pick(key, h, told, last):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, h = key[new], h[new]
        same = key[1:] == key[:-1]
        on = np.zeros(len(key), bool)
        on[1:] |= same
        on[:-1] |= same
        if told and len(on):
            on[0] = False
        stop = len(key) if last else len(key) - 1
        return key, h, on, stop

    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = np.append(key, np.asarray(batch.column(0))), np.append(h, np.asarray(batch.column(1)))
        key, h, on, stop = pick(key, h, told, False)
        told_last = bool(on[-1]) or (len(key) == 1 and told)
        yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(h[on])], ["key", "h"])
        key, h, told = key[-1:], h[-1:], told_last


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct shingles of all texts as numbers of so many bits, sorted text by text, and where each text's begin.

    Numbers are equal only for equal shingles; a text's place stands above them.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(code.max()) + 1, bool)
    known[code] = True
    code, n = (np.cumsum(known) - 1)[code].astype(_U), len(code) - SHINGLE + 1
    bits = max(1, int(code.max()).bit_length())
    value = code[:n].copy()
    for k in range(1, SHINGLE):
        if SHINGLE * bits <= 64:
            value |= code[k : n + k] << _U(bits * k)
        else:  # too many characters to put five side by side: number what there is, one character after the other
            value = np.unique((value << _U(32)) | code[k : n + k], return_inverse=True)[1].astype(_U)
    inside = np.ones(n, bool)
    inside[(np.cumsum(size)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    value, owner = value[inside], np.repeat(np.arange(len(texts), dtype=_U), size)[:n][inside]
    wide = int(value.max()).bit_length()
    if wide + len(texts).bit_length() > 64:
        value = np.unique(value, return_inverse=True)[1].astype(_U)
        wide = int(value.max()).bit_length()
    value |= owner << _U(wide)
    value.sort()
    value = value[np.append(True, value[1:] != value[:-1])]
    return value, np.searchsorted(value, np.arange(len(texts) + 1, dtype=_U) << _U(wide)), wide


#: Groups of so many texts at most are verified pair by pair, all groups of a stretch at once; larger ones text by text.
SMALL = 8


def _common(value: np.ndarray, starts: np.ndarray, wide: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many shingles the texts of each pair share; value holds every text's distinct shingles, its place above them."""
    size = np.diff(starts)
    out = np.zeros(len(first), np.int64)
    ends = np.cumsum(size[first] + size[second])
    at = 0
    while at < len(first):  # some million shingles at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        texts = np.concatenate([first[at:to], second[at:to]])
        n = size[texts]
        place = np.repeat(starts[texts] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        every = value[place] & _U((1 << wide) - 1) | np.repeat(np.tile(np.arange(to - at, dtype=_U), 2), n) << _U(wide)
        every.sort()
        out[at:to] = np.bincount((every[1:] >> _U(wide))[every[1:] == every[:-1]].astype(np.int64), minlength=to - at)
        at = to
    return out


def _pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups of SMALL texts or fewer."""
    first, second = [], []
    for m in range(2, SMALL + 1):
        i, j = np.triu_indices(m, 1)
        own = begin[size == m]
        first.append((own[:, None] + i).ravel())
        second.append((own[:, None] + j).ravel())
    return np.concatenate(first), np.concatenate(second)


def links(sets: list[np.ndarray], hashes: np.ndarray, side: np.ndarray, across: bool, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs with the similarity, within sets or only across sides."""
    us, vs = [], []
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    label, mark = np.arange(len(sets)), np.zeros(int(flat.max()) + 1, np.int64)
    for i in range(len(sets)):
        other = (label != label[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
        if across:
            other &= side != side[i]
        if not other.any():
            continue
        mine = flat[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[mine] = 0
        for j in np.flatnonzero(other & (both >= similarity * (size + size[i] - both))).tolist():
            if label[j] != label[i]:
                us.append(int(hashes[i]))
                vs.append(int(hashes[j]))
                label[label == label[j]] = label[i]
    return us, vs


def _verified(similarity: float):
    keys = ["key", "cell_a", "cell_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, keys):
            cols = [np.asarray(rows.column(k)) for k in keys]
            h, side, text = np.asarray(rows.column("h")), np.asarray(rows.column("side")), rows.column("line_text").to_pylist()
            us, vs = [], []
            starts = common.group_starts(cols)
            groups = [(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if b - a > 1]
            while groups:
                n, chars = 0, 0
                while n < len(groups) and chars < 1 << 19:
                    chars += sum(map(len, text[groups[n][0] : groups[n][1]]))
                    n += 1
                now, groups = groups[:n], groups[n:]
                base = now[0][0]
                value, starts_of, wide = shingle_sets(text[base : now[-1][1]])
                size = np.diff(starts_of)
                begin, count = np.array([a for a, _ in now]), np.array([b - a for a, b in now])
                i, j = _pairs(begin, count)
                alike = np.minimum(size[i - base], size[j - base]) >= similarity * np.maximum(size[i - base], size[j - base])
                alike &= (cols[1][i] == cols[2][i]) | (side[i] != side[j])
                i, j = i[alike], j[alike]
                both = _common(value, starts_of, wide, i - base, j - base)
                alike = both >= similarity * (size[i - base] + size[j - base] - both)
                us += h[i[alike]].tolist()
                vs += h[j[alike]].tolist()
                value &= _U((1 << wide) - 1)
                for a, b in now:
                    if b - a > SMALL:
                        sets = [value[starts_of[i] : starts_of[i + 1]] for i in range(a - base, b - base)]
                        u, v = links(sets, h[a:b], side[a:b], bool(cols[1][a] != cols[2][a]), similarity)
                        us += u
                        vs += v
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _forest_of(links):
    return lambda batches: common.forest(links(batches))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column more, and its name: 0 where no other row has the doc_id, else a number that grows with the text; such rows are written, so that it stays."""
    name, own = common.fresh(docs, "_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID))
    many = common.cut(docs.groupBy(own.alias("_many")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_many"), "repeated")
    n = many.count()
    if not n:
        return docs.withColumn(name, F.lit(0).cast("long")), name
    many = common.sized(many, n)
    some = docs.join(many, own == many["_many"], "left_semi").orderBy(own, docs["text"])
    some = common.cut(some.withColumn(name, F.monotonically_increasing_id() + 1), "repeated-rows")
    return docs.join(many, own == many["_many"], "left_anti").withColumn(name, F.lit(0).cast("long")).union(some), name


#: Bytes of text whose lines' band keys go to one task: seven times as many bytes at most, for lines of 30 characters.
BAND_BYTES = 16 << 20


def line_occurrences(docs: DataFrame, row: str, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, cell: int = 2000) -> DataFrame:
    """Every line that takes part, and a row for each document with line = -1 - its number of lines.

    docs are numbered(), row is their number's column. Columns doc_id, row, line, removed; doc_id stands for null as in common.keyed.
    """
    base = common.keyed(docs, row).withColumnRenamed(row, "_row")
    seen = common.cut(base.mapInArrow(_occurrences(min_chars), "doc_id long, row long, line long, h long, h2 long"), "lines")
    bands = base.select("text").mapInArrow(_bands(min_chars), "key long, h long")
    parts = common.parts_for(common.text_bytes(base), BAND_BYTES)
    met = common.cut(bands.repartition(parts, "key").sortWithinPartitions("key", "h").mapInArrow(shared, "key long, h long"), "bands")
    cells = common.dealt_once(met, ["key"], "h", cell)
    cells = common.cut(cells, "cells")
    common.drop(met)
    wanted = cells.select("h").distinct()
    texts = base.select("text").mapInArrow(_texts(min_chars), "h long, h2 long, line_text string").join(wanted.hint("shuffle_hash"), "h", "left_semi")
    texts = texts.groupBy("h").agg(F.min_by("line_text", "h2").alias("line_text"))
    keys = ["key", "cell_a", "cell_b"]
    edges = cells.hint("merge").join(texts, "h").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_forest_of(_verified(similarity)), "u long, v long")
    parts = common.components(edges, "u", "v", contracted=True)
    common.drop(cells)
    parts = parts.union(parts.select(F.col("component").alias("node"), "component").distinct())  # the least nodes too
    own, place = seen.where("h is not null"), F.struct("doc_id", "row", "line")
    first = own.groupBy("h").agg(F.min(F.struct("h2", "doc_id", "row", "line")).alias("first"), F.max("h2").alias("last_h2"))
    first = common.cut(first.select("h", F.struct("first.doc_id", "first.row", "first.line").alias("first"), F.col("first.h2").alias("main_h2"), "last_h2"), "firsts")
    linked = first.select("h", "first").join(parts, F.col("h") == F.col("node")).select("h", "first", "component")
    keeper = linked.groupBy("component").agg(F.min("first").alias("keep"))
    kept = linked.join(keeper, "component").select("h", "keep")
    keep = first.select("h", "first", "main_h2").join(kept, "h", "left").select("h", "main_h2", F.coalesce("keep", "first").alias("keep"))
    lines = own.join(common.cut(keep, "keepers"), "h")  # a table, so that Spark can split the rows of a line that is everywhere
    if not first.where("last_h2 != main_h2").isEmpty():  # different lines of one h: the others are kept once each
        others = lines.where("h2 != main_h2").groupBy("h", "h2").agg(F.min(place).alias("other_first"))
        lines = lines.join(others, ["h", "h2"], "left").withColumn("keep", F.coalesce("other_first", "keep"))
    lines = lines.select("doc_id", "row", "line", (place != F.col("keep")).alias("removed"))
    return lines.union(seen.where("h is null").select("doc_id", "row", "line", F.lit(False)))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending)."""
    rows = line_occurrences(*numbered(docs), **options)
    out = rows.groupBy("doc_id", "row").agg(
        F.sum(F.when(F.col("line") < 0, -F.col("line") - 1).otherwise(0)).alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"),
    )
    return common.unkeyed(out.drop("row"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the removed lines gone from text (and n_chars set anew); documents that lose all their text go."""
    names, (docs, row) = docs.columns, numbered(docs)
    marks = line_occurrences(docs, row, **options).where("removed").groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))
    gone, own = marks["gone"], F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID))
    joined = docs.join(marks, (own == marks["doc_id"]) & (docs[row] == marks["row"]), "left")
    lines = F.split(docs["text"], "\n")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), gone)
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i.cast("int"))), "\n")
    text = F.when(gone.isNull(), docs["text"]).otherwise(rest)
    count = F.when(gone.isNull(), docs["n_chars"]).otherwise(F.length(text).cast("long")) if "n_chars" in names else None
    new = {"text": text, "n_chars": count}
    return joined.where(gone.isNull() | text.rlike(r"\S")).select(*(new.get(c, docs[c]).alias(c) if c in new else docs[c] for c in names))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))
