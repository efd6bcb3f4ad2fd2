"""What the operators of this subpackage share: scratch tables, text batches, bounded groups and union-find."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="sourcelens-")
    return _OWN_DIRS[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: lineage ends here and lost executors cost no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and a Python worker; long texts would else make batches of any size.
ARROW_BYTES = 8 << 20


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of docs.text: one cheap aggregate that sizes partitions and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def slices(batch: pa.RecordBatch, column: str, target: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about target bytes of one string or binary column; a longer value stands alone."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + target, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string or binary column as uint8, and len+1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by keys, runs of whole groups: no group is ever split between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for c in cols:
            same &= c == c[last]
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start == 0 and held and all(held[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, cols, strict=True)):
            held.append(batch)
            continue
        if held or start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, with the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


#: Rows up to which Spark may broadcast a side of a join whose size it can't tell beforehand: it goes by a file's compressed
#: bytes, and a broadcast once planned stays, even where what comes from a shuffle is found to be large, if to merge takes one more.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, n: int) -> DataFrame:
    """df of n rows as a side of a join: both sides are merged if it is long, whatever Spark takes its size for."""
    return df.hint("merge") if n > BROADCAST_ROWS else df


def dealt(rows: DataFrame, key: list[str], ident: str, limit: int) -> DataFrame:
    """Split groups of equal key into cells of bounded size such that every pair of a group meets in exactly one cell.

    Adds cell_a, cell_b and side. A group of at most limit rows is one cell (0, 0). A larger one is dealt by hash into
    m chunks, and each row goes to the m cells that name its chunk; where cell_a != cell_b only rows of different
    sides are to be compared. Groups of one row go. Rows are merged with their groups' sizes and not broadcast: Spark takes
    rows that an explode or a Python step makes of one row for one.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _chunks(rows.hint("merge").join(sizes, key), ident, limit)


def dealt_once(rows: DataFrame, key: list[str], ident: str, limit: int) -> DataFrame:
    """As dealt(), but of the groups with the same members (each once, named together by 128 bits) only one stays: near-copies meet in many groups."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(ident)).alias("_s"), F.bit_xor(F.xxhash64(F.lit(1), ident)).alias("_h")).where("_n > 1")
    one = sizes.groupBy("_n", "_s", "_h").agg(F.min(F.struct(*key)).alias("_k")).select("_n", *(F.col("_k")[k].alias(k) for k in key))
    return _chunks(rows.hint("merge").join(one, key), ident, limit)


def _chunks(rows: DataFrame, ident: str, limit: int) -> DataFrame:
    return (
        rows.withColumn("_m", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64(ident), F.col("_m")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("cell_a", F.least("side", "_o"))
        .withColumn("cell_b", F.greatest("side", "_o"))
        .drop("_n", "_m", "_o")
    )


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of the edges a-b: each node but the least one of its component, and that least one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(nodes))
    while True:  # label propagation with pointer jumping, all vectorised
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], least)
        np.minimum.at(new, low[v], least)
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == low).all():
            break
        low = new
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract batches of edges to the stars of their components, (u, v) with v the least node."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        held = union_find(np.concatenate([held[0], np.asarray(batch.column(0))]), np.concatenate([held[1], np.asarray(batch.column(1))]))
        if len(held[0]) > 500_000:  # bounded memory: what is left is a forest, hand it on
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["u", "v"])
            held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", contracted: bool = False) -> DataFrame:
    """Connected components of an edge table by distributed union-find: (node, component), component the least node.

    Every partition first contracts its own edges to a forest, then large-star and small-star rounds (Kiveris et al.,
    2014) shrink the rest to stars. Each round ends in a table in the shared scratch folder. Nodes without edges and
    the least nodes themselves are absent: a caller takes coalesce(component, node). contracted: the edges come from
    forest() already, in the Python step that made them; a second one in the same task would take a second worker.
    """
    own = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v")
    now = cut((own if contracted else own.mapInArrow(forest, "u long, v long")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return sized(now.select(F.col("u").alias("node"), F.col("v").alias("component")), state[0])
        seen, old = state, now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sized(both.where("v > u"), state[0]).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = sized(large, state[0]).join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "edges")
        drop(old)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with marks before it: no column of df, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Stands for a null doc_id inside an operator, so that such rows are kept like any other.
NULL_ID = -(2**63)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long, never null), text and more; any other columns of docs, whatever their names, stay behind."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[c] for c in more))


def unkeyed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_ID)) for c in names or ("doc_id",)})
