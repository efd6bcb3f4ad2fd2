"""SimHash near-duplicates by covering locality-sensitive hashing (operator 5).

Fingerprints are 64-bit SimHashes of 4-word shingles. For radius r every bit position gets a vector of r+1 bits, and
each of the 2**(r+1)-1 nonzero vectors v gives a mask of the positions whose vector has an odd product with v
(Pagh, 2016). For any r differing bits some v is orthogonal to all their vectors, so that mask hides every difference
and the two fingerprints fall in one bucket of that table: no pair within the radius is missed.

Equal fingerprints are one node. Buckets go through bounded cells, a cell hands on a spanning forest of its links
instead of its pairs, and a distributed union-find joins the forests.

Null and empty texts have fingerprint zero and link like any other. Texts of any length are read whole. Repeated rows
are members of one node. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

RADIUS, WORDS, SEED = 4, 4, 42
#: For each byte value the 64-bit word whose k-th byte is bit k of the value: adding such words counts eight bits at once.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's runs of so many words, in order; a shorter text is one run."""
    import xxhash

    parts = (text or "").encode().lower().split()
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts or [b""]), np.int64) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.append(0, ends[: n - 1] + 1).tolist()
    stops = ends[-n:].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    if not (text or "").encode().split():
        return 0
    return int(majority(shingles(text, words, seed)).view(np.int64))


def majority(h: np.ndarray) -> np.uint64:
    """The word of the bits that are set in over half of h."""
    count = np.zeros(64, np.int64)
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    blocks = np.arange(0, len(h), 255)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], blocks)
        count[8 * k : 8 * k + 8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                made = [fingerprint(t, words) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return common.keyed(docs).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks, as signed numbers; positions get the nonzero vectors in turn."""
    size = 1 << (radius + 1)
    vectors = [1 + (i * 7) % (size - 1) for i in range(bits)]
    out = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within fps, or between fps and other.

    Rows are taken in blocks; a row whose component is known to hold all it could link to is skipped.
    """
    right = fps if other is None else other
    us, vs = [], []
    todo = np.arange(len(fps))
    label = np.arange(len(right))
    while len(todo):
        now, todo = todo[:512], todo[512:]
        near = np.bitwise_count((fps[now][:, None] ^ right[None, :]).view(np.uint64)) <= radius
        for i, row in zip(now.tolist(), near, strict=True):
            hit = np.flatnonzero(row)
            if other is None:
                hit = hit[label[hit] != label[i]]
            if not len(hit):
                continue
            first = hit[np.unique(label[hit], return_index=True)[1]]  # one link into each component
            us.append(np.full(len(first), fps[i]))
            vs.append(right[first])
            into = label[i] if other is None else label[first[0]]
            label[np.isin(label, label[first])] = into
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["mask", "bucket", "cell_a", "cell_b"]
        for rows in common.gathered(batches, keys):
            fp, side = np.asarray(rows.column("fp")), np.asarray(rows.column("side"))
            cols = [np.asarray(rows.column(k)) for k in keys]
            starts = common.group_starts(cols)
            size = np.diff(starts)
            us, vs = [], []
            two = starts[:-1][(size == 2) & (cols[2][starts[:-1]] == cols[3][starts[:-1]])]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
            us.append(fp[two][near])
            vs.append(fp[two + 1][near])
            for k in np.flatnonzero(size > 1).tolist():
                a, b = starts[k], starts[k + 1]
                whole = cols[2][a] == cols[3][a]
                if whole and size[k] == 2:
                    continue
                left = side[a:b] == cols[2][a]
                u, v = links(fp[a:b], None, radius) if whole else links(fp[a:b][left], fp[a:b][~left], radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def near_components(prints: DataFrame, radius: int = RADIUS, cell: int = 4096) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id: the smallest doc_id reachable over fingerprints within the radius."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks(radius))]))
    n = prints.count()
    parts = common.parts_for(n, 50_000)
    rows = nodes.select("fp").repartition(parts, "fp").select("fp", tables.alias("t")).select("t.mask", "t.bucket", "fp")  # dealt out before they multiply
    cells = common.dealt_once(rows, ["mask", "bucket"], "fp", cell)
    keys = ["mask", "bucket", "cell_a", "cell_b"]
    pairs = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cells(radius), "u long, v long")
    least = common.sized(nodes.select(F.col("fp").alias("u"), F.col("least").alias("a")), n)
    edges = pairs.distinct().join(least, "u").join(least.select(F.col("u").alias("v"), F.col("a").alias("b")), "v")
    found = common.components(edges)
    known = nodes.join(found, nodes["least"] == found["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return common.sized(prints, n).join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = common.cut(fingerprints(docs, words), "fingerprints")
    out = near_components(prints, radius)
    return common.unkeyed(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
