"""Sheets of labels and predictions: flattening, comparison, disagreements, and the picks that make a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import agreement, numbering, similarity

# Fields with their levels in rising strictness, blocks of labels by preference, comparisons of a sheet.
LEVELS = {
    "retrieve_permission": ["allow", "downrank", "defer", "reject"],
    "mention_permission": ["allow", "deny"],
    "factual_permission": ["allow", "attribute_only", "require_corroboration", "deny"],
    "endorsement_permission": ["allow", "deny"],
    "parasitic": ["none", "elevated", "suspected"],
}
BLOCKS = ["llm_labels", "labels", "draft_labels"]
COMPARISONS = {"anti_vs_adjudicated": ("adjudicated", "anti"), "human_vs_llm": ("human", "llm"), "anti_vs_human": ("human", "anti"), "anti_vs_llm": ("llm", "anti")}
FORBIDDEN = ["predictions", "llm_action", "permissions_llm_reason", "parasitic_llm_reason", "parasitic_geo_risk", "parasitic_source", "heuristic", "subscores"]
BUCKETS = ["soft_sell_near_miss", "planted_hit", "hard_endorsement", "review_framed", "other_l1", "clean_or_other"]
_FIELDS = ", ".join(f"{f} string" for f in LEVELS)
SHEET = f"pages array<struct<id string, query string, url string, domain string, source string, role_hint string, llm_labels struct<{_FIELDS}>, labels struct<{_FIELDS}>, draft_labels struct<{_FIELDS}>>>"


def read_sheet(spark: SparkSession, path: str, schema: str = SHEET) -> DataFrame:
    """The pages of JSON sheets, one row each, in their order (position)."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("pages").alias("position", "p")).select("position", "p.*")


def drafted(*blocks: str) -> Column:
    """The first block of labels, a struct of the fields, that has any; all null where none has."""
    filled = [F.when(F.coalesce(*(F.col(f"{b}.{f}") for f in LEVELS)).isNotNull(), F.col(b)) for b in blocks or BLOCKS]
    return F.coalesce(*filled)


def long(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """keys, field, value: a row for each field of a wide sheet."""
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias(value)) for f in LEVELS))).alias("x")).select(*keys, "x.*")


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs that count: both given, and no deferred retrieval, which is no judgement."""
    defers = (F.col("field") == "retrieve_permission") & ((F.col("gold") == "defer") | (F.col("pred") == "defer"))
    return pairs.where(F.col("gold").isNotNull() & F.col("pred").isNotNull() & ~defers)


def comparisons(labels: DataFrame) -> DataFrame:
    """comparison, field and the measures of agreement. labels: id, field, adjudicated, human, llm, anti, parasitic_source.

    Rows without a parasitic_source have no prediction of that field.
    """
    sides = F.array(*(F.struct(F.lit(name).alias("comparison"), F.col(gold).alias("gold"), F.col(pred).alias("pred"), F.lit(pred == "anti").alias("predicted")) for name, (gold, pred) in COMPARISONS.items()))
    pairs = labels.select("field", "parasitic_source", F.explode(sides).alias("x")).select("field", "parasitic_source", "x.*")
    pairs = _scored(pairs.where(~((F.col("field") == "parasitic") & F.col("predicted") & F.col("parasitic_source").isNull())))
    counts = similarity.written(pairs.groupBy("field", "comparison", "gold", "pred").agg(F.count(F.lit(1)).alias("n")), "cells")  # all that the measures read
    out = None
    for field, levels in LEVELS.items():  # five fields with levels of their own
        own = counts.where(F.col("field") == field).select(F.col("comparison").alias("field"), "gold", "pred", "n")
        levels = [v for v in levels if v != "defer"]
        made = agreement.measures(agreement.filled(own, levels), levels).withColumnRenamed("field", "comparison").withColumn("field", F.lit(field))
        out = made if out is None else out.unionByName(made)
    return out


def disagreements(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """id, field, gold, pred where both sheets say something and differ. Both: id, field, value."""
    both = gold.select("id", "field", F.col("value").alias("gold")).join(pred.select("id", "field", F.col("value").alias("pred")), ["id", "field"])
    return _scored(both).where("gold <> pred")


def error_order(errors: DataFrame, active: list[str]) -> DataFrame:
    """errors with place: those of active fields first, then by field and id."""
    return numbering.numbered(errors, "place", ~F.col("field").isin(active), "field", "id")


def knobs(scores: DataFrame, bars: dict[str, float], monitored: list[str]) -> DataFrame:
    """field, macro_f1, bar, action: freeze what reaches its bar, work on what doesn't."""
    bar = F.create_map(*(F.lit(x) for kv in bars.items() for x in kv))[F.col("field")] if bars else F.lit(None).cast("double")
    unknown = bar.isNull() | F.col("macro_f1").isNull() | F.isnan("macro_f1")
    action = F.when(F.col("field").isin(monitored), "monitor_only").when(unknown, "unknown").when(F.col("macro_f1") >= bar, "freeze").otherwise("active")
    return scores.select("field", "macro_f1", bar.alias("bar"), action.alias("action"))


def three_tiers(suspected: Column, elevated: Column, status: Column) -> Column:
    return F.when(F.coalesce(suspected, F.lit(False)), "suspected").when(F.coalesce(elevated, F.lit(False)) | F.coalesce(status == "sparse_suspicious", F.lit(False)), "elevated").otherwise("none")


def leaks(page_json: Column) -> Column:
    """Names of what a labeller must not see in a page's JSON."""
    found = (F.when(F.coalesce(F.get_json_object(page_json, f"$.{k}"), F.lit("null")).isin("null", "{}", "[]"), None).otherwise(F.lit(k)) for k in FORBIDDEN)
    return F.array_compact(F.array(*found))


def invalid(rows: DataFrame) -> Column:
    """Names of the fields of a wide sheet whose label is missing or no level of theirs."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(F.col(f).isin(levels), F.lit(False)), F.lit(f)) for f, levels in LEVELS.items())))


def picked(urls: Column, most: int) -> Column:
    """So many of an array's URLs: one a domain, repeats only until half are found, then the rest in order."""
    domain = lambda u: F.regexp_replace(F.lower(U.authority(u)), r"^www\.", "")
    least = max(3, most // 2)
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, u: Column) -> Column:
        full, repeat = F.size(state["kept"]) >= most, F.array_contains(state["seen"], domain(u)) & (F.size(state["kept"]) >= least)
        return F.when(full | repeat | (domain(u) == ""), state).otherwise(F.struct(F.array_append(state["kept"], u).alias("kept"), F.array_append(state["seen"], domain(u)).alias("seen")))

    first = F.aggregate(urls, empty, step)["kept"]
    return F.slice(F.concat(first, F.array_distinct(F.array_except(urls, first))), 1, most)


def sheet_rows(queries: DataFrame, prefix: str) -> DataFrame:
    """id, query, url, domain: a blank sheet with running ids. queries: ord (unique), query, urls."""
    rows = numbering.numbered(queries.select("ord", "query", F.posexplode("urls").alias("k", "url")), "n", "ord", "k")
    n = F.col("n")
    domain = F.regexp_replace(F.lower(U.authority(F.col("url"))), r"^www\.", "")
    padded = F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    return rows.select(F.concat(F.lit(prefix), padded).alias("id"), "query", "url", domain.alias("domain"))


def matched(sheet: DataFrame, results: DataFrame) -> DataFrame:
    """Sheet rows with the result of the same address, else of the same place in their query's list.

    sheet: id, query_id, position, url. results: query_id, position, url, final_url, value. The first of equal addresses counts.
    """
    key = lambda c: U.normalised(F.col(c))
    named = results.select("query_id", "position", "value", F.explode(F.array(key("url"), key("final_url"))).alias("key"))
    by_url = named.groupBy("query_id", "key").agg(F.min_by("value", "position").alias("by_url"))
    by_place = results.select("query_id", "position", F.col("value").alias("by_place"))
    out = sheet.withColumn("key", key("url")).join(by_url, ["query_id", "key"], "left").join(by_place, ["query_id", "position"], "left")
    return out.select("id", F.coalesce("by_url", "by_place").alias("value"), F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_place").isNotNull(), "position").alias("matched_by"))


def best_entity(diagnoses: DataFrame) -> DataFrame:
    """Per target and referrer the entity with the most telling bucket: target, referrer, entity, bucket.

    diagnoses: target, referrer, ord, entity, bucket, present; of equal buckets one whose entity is there, then the first.
    """
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    best = F.min(F.struct(rank.alias("rank"), (~F.col("present")).alias("absent"), "ord", "entity", "bucket")).alias("b")
    tidy = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    return diagnoses.groupBy(tidy("target").alias("target"), tidy("referrer").alias("referrer")).agg(best).select("target", "referrer", "b.entity", "b.bucket")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last written row of each key: a keyed table with last-write-wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), at).alias("r")).select(key, "r.*")


def missing(requests: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """Distinct requests that a cache table doesn't answer."""
    return requests.dropDuplicates(list(keys)).join(cache, list(keys), "left_anti")
