"""Token-set similarity of passages that share a scope (the sources of one query), and clusters of similar ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T

_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the cluster's shared folder; a temporary one only where spark.checkpoint.dir is unset and all runs in this process (tests)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sourcelens-core-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the least node of each connected component.

    Large-star and small-star rounds on written tables; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(stars, nodes["node"] == stars["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def similar_pairs(rows: DataFrame, threshold: float = C.SIMILARITY_CLUSTER) -> DataFrame:
    """scope, a, b, jaccard: pairs of different token sets of one scope that reach the threshold, a < b.

    rows: scope, ident, text. Equal token sets of a scope are one, named by their least ident. By prefix filter: with
    tokens in order of rising frequency, two sets of that similarity share one of their first n - ceil(threshold n) + 1.
    """
    sets = token_sets(rows)
    rare = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ordered = sets.select("scope", "ident", F.explode("tokens").alias("t")).join(rare, "t")
    place = F.row_number().over(W.partitionBy("scope", "ident").orderBy("f", "t"))
    size = F.count(F.lit(1)).over(W.partitionBy("scope", "ident"))
    prefix = ordered.select("scope", "ident", "t", place.alias("p"), size.alias("n")).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.col("a.n").between(F.col("b.n") * threshold, F.col("b.n") / threshold)
    met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.ident") < F.col("b.ident")) & near)
    met = met.select(F.col("a.scope").alias("scope"), F.col("a.ident").alias("a"), F.col("b.ident").alias("b")).distinct()
    left, right = sets.select("scope", F.col("ident").alias("a"), F.col("tokens").alias("ta")), sets.select("scope", F.col("ident").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    pairs = met.join(left, ["scope", "a"]).join(right, ["scope", "b"])
    return pairs.select("scope", "a", "b", F.round(both / (F.size("ta") + F.size("tb") - both), 9).alias("jaccard")).where(F.col("jaccard") >= threshold)


def token_sets(rows: DataFrame) -> DataFrame:
    own = rows.select("scope", "ident", F.array_sort(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("tokens")).where(F.size("tokens") > 0)
    return own.groupBy("scope", "tokens").agg(F.min("ident").alias("ident"), F.count(F.lit(1)).alias("copies"))


def clusters(spark: SparkSession, rows: DataFrame, threshold: float = C.SIMILARITY_CLUSTER) -> DataFrame:
    """scope, ident, cluster (least ident of it), n_links: every row; texts without tokens stand alone. ident is unique."""
    own = rows.select("scope", "ident", F.array_sort(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("tokens"))
    sets = written(token_sets(rows), "sets")
    pairs = written(similar_pairs(rows, threshold), "pairs")
    found = components(spark, pairs.select("a", "b"))
    copies = sets.select(F.col("ident").alias("i"), "copies")
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).join(copies, F.col("b") == F.col("i"))
    links = ends.groupBy("a").agg(F.sum("copies").alias("more"))
    named = sets.join(found, F.col("ident") == F.col("node"), "left").join(links, F.col("ident") == F.col("a"), "left")
    named = named.select("scope", "tokens", F.coalesce("component", "ident").alias("cluster"), (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return own.join(named, ["scope", "tokens"], "left").select("scope", "ident", F.coalesce("cluster", "ident").alias("cluster"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def independence(spark: SparkSession, rows: DataFrame, threshold: float = C.SIMILARITY_CLUSTER, least: float = C.SIMILARITY_LEAST) -> DataFrame:
    """Per scope: n_texts, n_clusters, max_similarity, coordinated, reasons. rows: scope, ident (unique), text.

    max_similarity is null where no two texts reach `least`, the smallest similarity any rule asks for. A text without
    tokens is a cluster of its own. Texts are coordinated if there are two or more and all are one cluster.
    """
    sets = written(token_sets(rows), "sets")
    pairs = written(similar_pairs(rows, least), "pairs")
    found = components(spark, pairs.where(F.col("jaccard") >= threshold).select("a", "b"))
    own = sets.join(found, F.col("ident") == F.col("node"), "left").groupBy("scope").agg(F.sum("copies").alias("n_told"), F.count_distinct(F.coalesce("component", "ident")).alias("n_parts"), F.max("copies").alias("most"))
    near = pairs.groupBy("scope").agg(F.max("jaccard").alias("near"))
    out = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_texts")).join(own, "scope", "left").join(near, "scope", "left")
    n_clusters = F.col("n_texts") - F.coalesce("n_told", F.lit(0)) + F.coalesce("n_parts", F.lit(0))
    out = out.select("scope", "n_texts", n_clusters.alias("n_clusters"), F.round(F.when(F.col("most") > 1, 1.0).otherwise(F.col("near")), 3).alias("max_similarity"))
    high, copied = (F.col("n_clusters") < F.col("n_texts")) & (F.col("max_similarity") >= threshold), F.col("max_similarity") >= C.SIMILARITY_COPY
    told = F.array_compact(F.array(F.when(high, "high_textual_similarity_across_domains"), F.when(copied, "likely_shared_copy_or_template")))
    together = (F.col("n_clusters") == 1) & (F.col("n_texts") >= 2) & (F.col("max_similarity") >= least)
    return out.withColumns({"coordinated": F.coalesce(together, F.lit(False)), "reasons": told})
