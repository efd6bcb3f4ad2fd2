"""Queries from their candidate pages to ranked, guarded and disclosed answers, all queries of a table at once.

Every query's candidates are a corpus of their own. What a page or passage is by itself is computed once, whatever the
number of queries it is a candidate of; what depends on the query follows per (query, page) or (query, passage). The
stages are tables in the shared folder, so that the ladders of one stage are not recomputed inside the next.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import claims, commerce, decisions, guard, retrieval, signals, similarity

PERMISSIONS = list(decisions.STRICTNESS)


class Analysis(NamedTuple):
    """What investigate() gives, by table.

    sources: (query_id, url) with trust, role, subscores, permissions and actions. passages: (query_id, ident) with
    score, penalties and defended score, of those that may be retrieved. baseline and defended: the k places of each
    query, with share of what is seen. context: per query independence, consensus, dominance before and after, claim and
    its corroboration. permissions: per (query, url) what commerce leaves. verdicts and disclosures: per query.
    """

    sources: DataFrame
    passages: DataFrame
    baseline: DataFrame
    defended: DataFrame
    context: DataFrame
    permissions: DataFrame
    verdicts: DataFrame
    disclosures: DataFrame


def ident(url: Column, chunk_id: Column) -> Column:
    """A passage's name among all passages."""
    return F.concat(url, F.lit("|"), chunk_id)


def judged_sources(queries: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Every candidate page as its query sees it: content signals, trust, subscores, permissions, actions; text is the excerpt from here on."""
    own = similarity.written(signals.densities(sources).drop("_plain"), "source-signals")
    pairs = candidates.select("query_id", "url").distinct().join(queries.select("query_id", "query", "intent"), "query_id").join(own, "url")
    rows = signals.for_query(pairs).withColumns({"text": F.substring("text", 1, signals.EXCERPT), "host": U.authority(F.col("url"))})
    rows = rows.withColumn("trust", signals.trust_score(rows))
    return decisions.actions(decisions.permissions(decisions.subscores(rows)))


def passage_texts(chunks: DataFrame) -> DataFrame:
    """ident, url, segment, text and what each passage is by itself, written. chunks: url, chunk_id, segment, text."""
    told = signals.densities(chunks.select("url", "chunk_id", "segment", "text")).drop("_plain").withColumn("ident", ident(F.col("url"), F.col("chunk_id")))
    return similarity.written(told.drop("chunk_id"), "passage-signals")


def passage_signals(judged: DataFrame, texts: DataFrame) -> DataFrame:
    """Every passage of every candidate as its query sees it, without its text."""
    of = judged.select("query_id", "query", "intent", "url", "host", "role", "ok", "trust", "mismatch", "retrieve_permission", F.col("n_words").alias("source_words"))
    rows = signals.for_query(of.join(texts, "url")).drop("text", "query")
    return rows.withColumnsRenamed({"n_words": "passage_words", "source_words": "n_words"})


def with_penalties(rows: DataFrame) -> DataFrame:
    """rows of passage_signals() with score: all of them, those that may be retrieved with chunk_trust, l1, l2 and defended."""
    kept = retrieval.chunk_scores(rows)
    gone = rows.join(kept.select("query_id", "ident"), ["query_id", "ident"], "left_anti")
    return kept.unionByName(gone, allowMissingColumns=True)


def ranked(passages: DataFrame, sources: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k places of each query by base score alone, and by defended score with one host first and dominance put down; both with share."""
    rows = passages.select("query_id", F.col("ident").alias("doc_id"), "url", "host", "score", "defended", "trust", F.col("passage_words").alias("n_words"))
    first = retrieval.top(rows, k)
    second = retrieval.reranked(rows.where("defended is not null").drop("score"), k, sources=sources.select("query_id", "host", "trust"))
    second = second.drop("score").withColumnRenamed("place", "rank")
    return first, second


def _shares(places: DataFrame) -> DataFrame:
    """places with the share of what is seen that their url has."""
    return places.join(retrieval.by_url(places).select("query_id", "url", "share"), ["query_id", "url"])


def investigate(spark: SparkSession, queries: DataFrame, candidates: DataFrame, sources: DataFrame, chunks: DataFrame, k: int = 5) -> Analysis:
    """Each query's whole run.

    queries: query_id, query, intent, claim (null: the usable name that most of its sources share). candidates:
    query_id, url. sources: one row a url with text, ok and what facts there are (see signals.trust_score and
    decisions.subscores; commercial_tier, context_flags and whois_age_days are needed). chunks: url, chunk_id, segment,
    text. A query without candidates has a verdict and nothing else; a page without passages is a source all the same.
    """
    judged = similarity.written(judged_sources(queries, candidates, sources), "judged")
    texts = passage_texts(chunks)
    rows = similarity.written(passage_signals(judged, texts), "passages")
    scores = retrieval.scoped_scores(queries.select("query_id", F.col("query").alias("text")), rows.select("query_id", F.col("ident").alias("doc_id")), texts.select(F.col("ident").alias("doc_id"), "text"))
    return concluded(spark, queries, judged, rows.join(scores.withColumnRenamed("doc_id", "ident"), ["query_id", "ident"]), texts, k)


def concluded(spark: SparkSession, queries: DataFrame, judged: DataFrame, scored: DataFrame, texts: DataFrame, k: int) -> Analysis:
    """What follows from judged sources and from passages with their base scores: rankings, context, verdicts, disclosures.

    Texts of passages are read for the k places of each query only; of the others only numbers travel.
    """
    passages = similarity.written(with_penalties(scored), "penalised")
    first, second = (similarity.written(_shares(t), n) for t, n in zip(ranked(passages, judged, k), ("baseline", "defended"), strict=True))

    excerpts = judged.where("text <> ''").select(F.col("query_id").alias("scope"), F.concat_ws("|", F.col("query_id").cast("string"), "url").alias("ident"), "text")
    told = similarity.independence(spark, excerpts).withColumnRenamed("scope", "query_id")
    seen = {name: retrieval.dominance(retrieval.visibility(t)) for name, t in (("baseline", first), ("defended", second))}
    alone = F.col("n_texts") < 2
    scopes = queries.select("query_id").join(told, "query_id", "left").withColumn("n_clusters", F.when(~alone, F.col("n_clusters")))
    context = guard.query_context(scopes.withColumnRenamed("n_texts", "n_urls"), seen["defended"])
    shared = claims.shared_claims(judged.select(F.col("query_id").alias("scope"), "text")).select(F.col("scope").alias("query_id"), F.col("claim").alias("_shared"))
    asked = queries.join(shared, "query_id", "left").withColumn("claim", F.coalesce("claim", "_shared")).drop("_shared")
    asked = similarity.written(asked.join(scopes, "query_id").join(context, "query_id"), "asked")
    backed = guard.corroboration(judged.withColumn("endorsement_allowed", F.col("endorsement_permission") == "allow"), asked.where("claim is not null and n_clusters is not null"))

    whole = asked.select("query_id", "intent", "query", (F.coalesce("coordinated", F.lit(False)) | (F.col("consensus") == "coordinated")).alias("coordinated"))
    of = judged.select("query_id", "url", "role", "context_flags", "commercial_tier", "harm", "whois_age_days", *PERMISSIONS)
    leads = second.select("query_id", F.col("doc_id").alias("ident"), F.col("rank").alias("defended_rank"))
    rows = passages.select("query_id", "ident", "url", "host", "segment", "comparative", "flags", "semantic_risk", F.col("chunk_trust").alias("trust")).join(leads, ["query_id", "ident"]).join(texts.select("ident", "text"), "ident")
    rows = similarity.written(commerce.tighten(commerce.influence(rows.join(of, ["query_id", "url"]).join(whole, "query_id"))), "influenced")
    tight = decisions.tightest(rows.select("query_id", "url", *PERMISSIONS).union(judged.select("query_id", "url", *PERMISSIONS)), "query_id", "url")
    guarded = rows.drop(*PERMISSIONS).join(tight, ["query_id", "url"]).withColumn("rank", F.col("defended_rank")).withColumn("endorsement_allowed", F.col("endorsement_permission") == "allow")
    verdicts = guard.verdicts(guarded, asked.withColumn("entity", F.col("claim")).select("query_id", "query", "intent", "entity", "consensus", "n_clusters"))
    shown = commerce.disclosures(rows.withColumn("rank", F.col("defended_rank")), rows.where("defended_rank = 1").select("query_id", F.col("text").alias("answer")))

    before = seen["baseline"].select("query_id", F.col("dominant_share").alias("baseline_dominance"), F.col("alert").alias("baseline_alert"))
    after = seen["defended"].select("query_id", F.col("dominant_share").alias("defended_dominance"), F.col("alert").alias("defended_alert"))
    summary = asked.join(before, "query_id", "left").join(after, "query_id", "left").join(backed.select("query_id", "n_support", "institutional", F.col("endorsement_allowed").alias("corroborated")), "query_id", "left")
    return Analysis(judged, passages, first, second, summary, tight, verdicts, shown)


def changes(run: Analysis) -> DataFrame:
    """Per passage with a place before or after: query_id, doc_id, url, baseline_rank, defended_rank, status, reasons."""
    a = run.baseline.select("query_id", "doc_id", F.col("rank").alias("baseline_rank"))
    b = run.defended.select("query_id", "doc_id", F.col("rank").alias("defended_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full").join(run.passages.select("query_id", F.col("ident").alias("doc_id"), "url", "score", "defended"), ["query_id", "doc_id"])
    both = both.join(run.sources.select("query_id", "url", "retrieve_permission", "commercial_tier"), ["query_id", "url"]).join(run.context.select("query_id", "coordinated"), "query_id")
    status = F.when(F.col("defended_rank").isNull(), "excluded").when(F.col("baseline_rank").isNull(), "admitted").when(F.col("defended_rank") < F.col("baseline_rank"), "raised").when(F.col("defended_rank") > F.col("baseline_rank"), "lowered").otherwise("same")
    return both.withColumns({"status": status, "reasons": retrieval.exclusion_reasons(both)}).drop("retrieve_permission", "commercial_tier", "coordinated")
