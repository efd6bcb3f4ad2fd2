"""Queries of the referral, suggestion and ranking operators over sheets made from ids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import decisions, referrals, retrieval, similarity, suggestions
from sourcelens.plans import decision_queries, role_sql
from sourcelens.plans.decision_queries import doubles
from sourcelens.plans.sheet import pick, text
from sourcelens.sources.tables import table

THREADS = pick("doc_id", *text("https://forum.kettles.net/threads/kettle.12", "https://a.io/posts/1", "https://b.org/comments/9", "https://c.com/reviews/x"))
PLAIN = pick("doc_id", *text("https://blog.tea.org/about", "https://shop.acme.co.uk/product/kettle-9", "https://m.com/p/abc", "https://d.net/wiki/x", "https://e.net/directory/"))
MIXED = pick("doc_id", *text("https://health.gov/a", "https://x.com/picks/a", "https://forum.kettles.net/threads/kettle.12", "https://blog.tea.org/about", "https://shop.acme.co.uk/product/kettle-9", "https://f.org/reviews/x"))
REFERRER = {
    "url": f"CASE target_id % 3 WHEN 0 THEN {THREADS} WHEN 1 THEN {PLAIN} ELSE {MIXED} END",
    "stance": f"CASE WHEN target_id % 2 = 0 THEN 'promotional' ELSE {pick('doc_id', *text('complaint', 'neutral', 'promotional', 'unknown', ''))} END",
    "marks": pick("doc_id * 3", *text("", "comparative_superlatives", "", "planted_mention", "")),
    "high_risk": "(doc_id * 7 + target_id) % (3 + target_id % 9) = 0",
    "llm_parasitic": "doc_id % 11 = 0",
    "manipulability": "(doc_id * 13 % 20) / 2e1",
    "excerpt": "CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'words' END",
}
TARGET = {
    "role": pick("target_id", *text("commercial_product", "factual_blog", "editorial", "expert_listicle", "ugc_thread", "institutional", "commercial_product")),
    "trust": "(target_id * 29 % 100) / 1e2",
    "commercial_tier": pick("target_id", *text("none", "none", "low", "high", "none")),
    "query": pick("target_id", *text("is acme legit", "best kettle", "acme", "worth it")),
    "discovery": pick("target_id", *text("success", "partial", "failed")),
    "n_errors": "CASE WHEN target_id % 4 = 0 THEN 2 ELSE 0 END",
    "n_sampled": "CAST(target_id % 5 AS INT)",
    "coordinated": "target_id % 7 = 0",
    "scored": "CAST(target_id % 4 AS INT)",
    "content_high_risk": "CAST(target_id % 3 AS INT)",
    "engine_cited": "target_id % 2 = 0",
    "n_cited": "CAST(target_id % 3 AS INT)",
}
_made = lambda columns: ", ".join(f"{e} AS {c}" for c, e in columns.items())
SQL = f"""ids AS (SELECT doc_id, doc_id // 25 AS target_id FROM documents),
  referrers AS (SELECT *, {role_sql.page_role()} AS role FROM (SELECT doc_id, target_id, {_made(REFERRER)} FROM ids WHERE doc_id % 25 < (target_id * 7 + 3) % 26)),
  targets AS (SELECT target_id, {_made(TARGET)} FROM (SELECT DISTINCT target_id FROM ids))"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 25 AS target_id")


def _referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).where("doc_id % 25 < (target_id * 7 + 3) % 26").selectExpr("doc_id", "target_id", *(f"{e} AS {c}" for c, e in REFERRER.items()))
    return rows.withColumns({"role": U.page_role(F.col("url")), "flags": F.filter(F.split("marks", ","), lambda x: x != "")})


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("target_id").distinct().selectExpr("target_id", *(f"{e} AS {c}" for c, e in TARGET.items()))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referrals.profiles(_referrers(spark, sf_dir), _targets(spark, sf_dir))


def referral_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _profiles(spark, sf_dir)
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("target_id", "n", "count", "n_surface", "n_sure", "editorial", r("share"), r("risk"), "alignment", "status", "discovery", "confidence", "suspected", "soft_band", "elevated")


def referral_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _profiles(spark, sf_dir)
    extra = referrals.extra_actions(out)
    merged = decisions.merged_actions(F.array(F.lit("pass")), extra)
    return out.select("target_id", F.array_join(extra, ",").alias("extra"), decisions.primary(merged).alias("action"), referrals.verdict(out).alias("verdict"), F.array_join(referrals.gates(out), ",").alias("gates"), referrals.is_decisive(out).alias("decisive"))


def referral_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after a round through JSON, and a row that doesn't parse."""
    out = referrals.frozen(_profiles(spark, sf_dir)).withColumn("profile", F.when(F.col("target_id") % 5 == 0, "damaged {").otherwise(F.col("profile")))
    return referrals.thawed(out).select("target_id", "status", "n", F.round("risk", 9).alias("risk"), "suspected")


def referrer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = referrals.role_mix(_referrers(spark, sf_dir), "target_id")
    return mix.select("target_id", F.array_join(F.transform(F.array_sort(F.map_entries("mix")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("mix"))


def referrers_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referrals.eligible(_referrers(spark, sf_dir), 6).select("target_id", "doc_id", "parasitic", "place")


def referrer_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _referrers(spark, sf_dir).withColumn("segments", F.filter(F.array(
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("main_post").alias("role"), F.concat(F.lit("Acme stands in post "), F.col("doc_id").cast("string")).alias("text"))),
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("comment").alias("role"), F.lit("nothing named").alias("text"))),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("nested_comment").alias("role"), F.lit("a reply about ACME here").alias("text"))),
    ), lambda s: s.isNotNull()))
    body = F.concat(F.repeat(F.lit("before "), (F.col("doc_id") % 200).cast("int")), F.when(F.col("doc_id") % 7 == 0, "").otherwise("acme kettle "), F.repeat(F.lit("after "), F.lit(300)))
    found = referrals.scoped_excerpt(body, F.col("segments"), F.lit("Acme"), F.lit("a"))
    thread, edit = referrals.thread_surface(F.col("url"), F.col("segments")), referrals.editability(F.col("url"), F.col("role"))
    return rows.select("doc_id", F.round(thread, 9).alias("thread"), F.round(edit, 9).alias("edit"), F.round(F.greatest(thread, edit), 9).alias("manipulable"), F.length(found["excerpt"]).cast("long").alias("n_chars"), found["role"].alias("segment"))


def stance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions.top_for_stance(_referrers(spark, sf_dir)).select("target_id", "doc_id", "place")


SUGGESTED = {
    "suggested_retrieve_permission": pick("doc_id", *text("allow", "Downrank ", "reject", "nonsense", "null"), "CAST(NULL AS STRING)"),
    "suggested_mention_permission": pick("doc_id * 5", *text("allow", "deny", "none", "x", "y", "z", "deny")),
    "suggested_factual_permission": pick("doc_id * 3", *text("allow", "attribute_only", "deny", "require_corroboration", "")),
    "suggested_endorsement_permission": pick("doc_id * 3", *text("deny", "allow", "", "none")),
}


def suggested_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision_queries._decided(spark, sf_dir).selectExpr("*", *(f"{e} AS {c}" for c, e in SUGGESTED.items()))
    return suggestions.merged_permissions(rows).select("doc_id", *decision_queries.PERMISSIONS, "merge_source")


#: Replies of all kinds, by doc_id modulo their number, and what each suggests: retrieve, mention, factual, endorsement, reason.
REPLIES = [
    ('{"retrieve_permission":"downrank","mention_permission":"allow","factual_permission":"attribute_only","endorsement_permission":"deny","reason":"it  sells"}', ("downrank", "allow", "attribute_only", "deny", "it sells")),
    ('```json\n{"endorsement_permission": " DENY ", "reason": 3}\n```', (None, None, None, "deny", "")),
    ('Sure: {"factual_permission":"require_corroboration","mention_permission":7,"reason":"see {this}"} so it is', (None, None, "require_corroboration", None, "see {this}")),
    ("no object here", (None,) * 4 + ("",)),
    ('["downrank"]', (None,) * 4 + ("",)),
    (None, (None,) * 4 + ("",)),
    ('{"retrieve_permission":"never","endorsement_permission":"allow","factual_permission":["deny"]}', (None, None, None, "allow", "")),
    ('{"retrieve_permission": "reject"', (None,) * 4 + ("",)),
    ('[{"factual_permission":"deny","retrieve_permission":"allow"}]', ("allow", None, "deny", None, "")),
    ('{"retrieve_permission":null,"mention_permission":"deny","factual_permission":"none"}', (None, "deny", None, None, "")),
    ("```\n{}\n```", (None,) * 4 + ("",)),
]


def reply_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the sheet after raw replies of a model, with why some rows were not put to one."""
    literal = lambda v: F.lit(None).cast("string") if v is None else F.lit(v)
    raw = F.get(F.array(*(literal(r) for r, _ in REPLIES)), (F.col("doc_id") % len(REPLIES)).cast("int"))
    rows = similarity.written(decision_queries._decided(spark, sf_dir).withColumn("raw", raw), "decided")
    return suggestions.from_replies(rows, "raw").select("doc_id", "skipped", *decision_queries.PERMISSIONS, "merge_source", "suggestion_reason")


def decisive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referrers of each target up to the one that settles their mix, and the mix at that point."""
    rows = referrals.counted(_referrers(spark, sf_dir).withColumn("coordinated", F.col("target_id") % 7 == 0)).withColumn("ord", F.col("doc_id"))
    out = referrals.until_decisive(rows, 20)
    return out.select("doc_id", "target_id", "hard", "seen", F.col("count").alias("n_hard"), "editorial", "decisive")


def _penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are written first: a filter on them would else be pushed down as the whole ladder that made them."""
    rows = similarity.written(decision_queries._decided(spark, sf_dir), "decisions")
    return retrieval.chunk_scores(rows.withColumn("score", (F.col("doc_id") * 41 % 97 + 3) / 100))


def chunk_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _penalised(spark, sf_dir).select("doc_id", *(F.round(c, 9).alias(c) for c in ("chunk_trust", "l1", "l2", "defended")))


def dominance_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best of each query's sources, dealt over three hosts, after a dominant risky host is put down."""
    rows = _penalised(spark, sf_dir).withColumn("host", F.concat(F.lit("h"), (F.col("doc_id") % 3).cast("string")))
    out = retrieval.reranked(rows, 4)
    return out.select("query_id", "doc_id", "host", "place", F.round("defended", 9).alias("defended"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _penalised(spark, sf_dir).withColumn("coordinated", F.col("consensus") == "coordinated")
    changed = retrieval.rank_changes(rows.select("query_id", "doc_id", "score", "defended"), 5)
    out = changed.join(rows.select("doc_id", "retrieve_permission", "commercial_tier", "coordinated"), "doc_id")
    reasons = retrieval.exclusion_reasons(out)
    place = W.partitionBy("query_id").orderBy("baseline_rank")
    gone = out.withColumn("reasons", F.array_join(reasons, ",")).where("status = 'excluded'").withColumn("k", F.row_number().over(place)).where("k <= 5")
    return gone.select("query_id", "doc_id", "baseline_rank", "reasons")


QUERIES = {f.__name__: f for f in (
    decisive_prefix, reply_permissions, referral_profiles, referral_actions, referral_freeze, referrer_roles, referrers_to_score, referrer_surfaces, stance_candidates, suggested_permissions, chunk_penalties, dominance_rerank, exclusions,
)}

_PARASITIC = f"({role_sql.OPEN_POSTING} OR {role_sql.PUBLISH} OR {role_sql.DIRECTORY} OR role IN ('review_profile', 'ugc_thread'))"
_COMMERCIAL = ", ".join(f"'{r}'" for r in referrals.COMMERCIAL_ROLES)
_PROFILE = doubles(f"""counted AS (SELECT r.*, coordinated, llm_parasitic OR {_PARASITIC} OR (r.role = 'factual_blog' AND high_risk) AS surface, r.role IN ('ugc_thread', 'review_profile') OR {role_sql.OPEN_POSTING} AS gated,
    CASE WHEN stance NOT IN ('', 'unknown') THEN stance = 'promotional' ELSE high_risk OR marks <> '' END AS promotes FROM referrers r JOIN (SELECT target_id, coordinated FROM targets) t USING (target_id)),
  mix AS (SELECT target_id, count(*) AS n, count(*) FILTER (surface AND (NOT gated OR coordinated OR high_risk OR promotes)) AS count, count(*) FILTER (surface) AS n_surface, count(*) FILTER (surface AND high_risk) AS n_sure,
    count(*) FILTER (role IN ('editorial', 'institutional')) AS editorial, count(*) FILTER (role IN ({_COMMERCIAL})) AS n_commercial FROM counted GROUP BY target_id),
  p0 AS (SELECT t.*, coalesce(m.n, 0) AS n, coalesce(m.count, 0) AS count, coalesce(n_surface, 0) AS n_surface, coalesce(n_sure, 0) AS n_sure, coalesce(editorial, 0) AS editorial, coalesce(n_commercial, 0) AS n_commercial FROM targets t LEFT JOIN mix m USING (target_id)),
  p1 AS (SELECT *, CASE WHEN n > 0 THEN count / n ELSE 0.0 END AS share, CASE WHEN n > 0 THEN n_commercial / n ELSE 0.0 END AS cs, 0.35 + 0.35 * least(1.0, n / 10) AS w,
    CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, (w * share + (1 - w) * least(1.0, count / 5)) * CASE WHEN editorial > 0 THEN greatest(0.25, 1 - 0.55 * least(1.0, editorial) - 0.35 * editorial / n) ELSE 1.0 END + least(0.25, 0.1 * n_sure))), 4) END AS risk0,
    CASE WHEN n = 0 THEN 'inconclusive' WHEN role IN ('editorial', 'institutional', 'factual_blog') AND cs >= 0.7 AND n_commercial >= 2 THEN 'coordinated_commercial' WHEN (role IN ({_COMMERCIAL}) OR commercial_tier IN ('low', 'medium', 'high')) AND cs < 0.3 AND n >= 3 THEN 'mismatch' ELSE 'aligned' END AS alignment,
    n = 0 AND n_errors > 0 AS failed, n < 10 AND share >= 0.8 AND n >= 3 AS lone,
    CASE WHEN failed THEN 'inconclusive' WHEN n = 0 THEN 'sparse' WHEN n >= 20 THEN 'complete' WHEN lone THEN 'sparse_suspicious' ELSE 'sparse' END AS status,
    CASE WHEN failed AND n_sampled = 0 THEN 'failed' WHEN failed THEN discovery WHEN n = 0 THEN 'success' ELSE discovery END AS found,
    CASE WHEN failed THEN NULL WHEN n = 0 THEN false WHEN (n >= 10 AND share > 0.5 AND editorial = 0) OR (alignment = 'mismatch' AND share >= 0.8 AND n >= 5 AND editorial = 0) THEN true WHEN alignment = 'coordinated_commercial' THEN NULL ELSE false END AS suspected,
    n >= 10 AND editorial = 0 AND share BETWEEN 0.35 AND 0.5 AS soft_band, CASE WHEN n >= 10 OR (n = 0 AND NOT failed) THEN 'medium' ELSE 'low' END AS confidence FROM p0),
  p2 AS (SELECT *, n >= 5 AND editorial = 0 AND count >= 3 AND n_sure >= 1 AS e1, n >= 5 AND editorial = 0 AND n_sure >= 2 AND count >= 2 AS e2,
    n > 0 AND NOT coalesce(suspected, false) AND CASE WHEN role = 'commercial_product' OR commercial_tier IN ('medium', 'high') THEN e1 OR e2 OR (trust < 0.62 AND risk0 >= 0.55)
      ELSE soft_band OR status = 'sparse_suspicious' OR (risk0 >= 0.35 AND n >= 5 AND (n_sure >= 1 OR share >= 0.35)) OR e1 OR e2 END AS raised,
    NOT coalesce(suspected, false) AND role = 'commercial_product' AND n <= 5 AND found IN ('success', 'partial') AND status <> 'inconclusive' AND regexp_matches(query, 'legit|worth it') AS brand,
    CASE WHEN brand THEN greatest(risk0, 0.4) ELSE risk0 END AS risk, raised OR brand AS elevated FROM p1)""")
_P = f"WITH {SQL}, {_PROFILE}"
_ALLOW = "retrieve_permission = 'allow' AND mismatch < 0.5 AND (role <> 'commercial_product' OR (shopping AND NOT legit))"
_got = lambda p, column: f"CASE WHEN lower(trim({column})) IN ({', '.join(repr(v) for v in decisions.STRICTNESS[p])}) THEN lower(trim({column})) END"
_PENALTY = doubles(f"""pen AS (SELECT *, (doc_id * 41 % 97 + 3) / 100 AS score, role IN ('ugc_thread') AS thread, segment IN ('comment', 'sidebar') AS open_part,
  CASE segment WHEN 'comment' THEN 0.65 WHEN 'sidebar' THEN 0.45 ELSE 1.0 END AS c1, CASE WHEN thread AND segment = 'comment' THEN least(c1, 0.6) ELSE c1 END AS c2, CASE WHEN role = 'review_profile' AND segment <> 'main_post' THEN least(c2, 0.5) ELSE c2 END AS c3,
  greatest(0.05, least(trust, c3) * (1 - least(0.25, rhet * 0.35))) AS chunk_trust, least(1.0, front_load * greatest(0.2, rhet, comparative, authority * 0.5)) AS rr,
  CASE WHEN shopping AND NOT open_part THEN 0.0 ELSE least(0.85, rhet * 0.5 * (CASE WHEN info THEN 1.0 ELSE 0.8 END) + rr * 0.35) END AS x1,
  CASE WHEN info THEN least(0.85, x1 + mismatch * 0.3) ELSE x1 END AS x2, CASE WHEN segment = 'comment' THEN least(0.85, x2 + CASE WHEN intent = 'commercial' THEN 0.3 ELSE 0.15 END) ELSE x2 END AS x3,
  CASE WHEN thread AND open_part THEN least(0.85, x3 + 0.12) ELSE x3 END AS l1,
  least(0.85, (1 - chunk_trust) * 0.45 + CASE WHEN ok AND n_words < 80 THEN 0.05 ELSE 0.0 END + CASE WHEN ok THEN 0.0 ELSE 0.35 END + CASE WHEN retrieve_permission = 'downrank' THEN 0.25 ELSE 0.0 END) AS l2,
  CASE segment WHEN 'sidebar' THEN 0.35 WHEN 'comment' THEN CASE WHEN thread AND intent = 'commercial' THEN 0.4 ELSE 0.5 END ELSE 1.0 END AS mul,
  round(score * (1 - l1) * (1 - l2) * mul, 9) AS defended, retrieve_permission = 'reject' OR (retrieve_permission = 'defer' AND score < 0.35) AS gone FROM acted),
  live AS (SELECT * FROM pen WHERE NOT gone)""")
_PEN = f"WITH {decision_queries._ALL}, {_PENALTY}"
_div = lambda source, by: f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, {by} DESC, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host3 ORDER BY {by} DESC, doc_id) > 1 AS later FROM {source})"

_MERGE = f"""h AS (SELECT *, concealment_risk >= 0.9 OR failure IS NOT NULL OR (confidence < 0.25 AND floored) OR coalesce(g0, g1, g2, g3) IS NULL AS held, held OR concealment_risk >= 0.5 AS most, coalesce(g0, retrieve_permission) AS s0, coalesce(g1, mention_permission) AS s1, coalesce(g2, factual_permission) AS s2,
        shopping AND ((role IN ('expert_listicle', 'review_profile') AND factual_permission IN ('allow', 'attribute_only')) OR (role IN ('ugc_thread', 'review_profile') AND factual_permission = 'attribute_only' AND NOT legit)) AS attributed,
        CASE WHEN attributed AND s2 IN ('require_corroboration', 'deny') THEN factual_permission ELSE s2 END AS t1, CASE WHEN shopping AND role IN ('expert_listicle', 'review_profile', 'factual_blog') AND factual_permission = 'attribute_only' AND t1 = 'allow' THEN 'attribute_only' ELSE t1 END AS t2,
        CASE WHEN role = 'institutional' AND factual_permission = 'allow' THEN 'allow' WHEN factual_permission = 'require_corroboration' AND t2 IN ('allow', 'attribute_only') THEN 'require_corroboration' ELSE t2 END AS t3 FROM g)"""
_MERGED = f"""SELECT doc_id, CASE WHEN most THEN retrieve_permission WHEN {_ALLOW} THEN 'allow' WHEN retrieve_permission = 'downrank' AND s0 = 'allow' AND ((role = 'commercial_product' AND (shopping OR legit)) OR (role = 'ugc_thread' AND legit) OR (shopping AND role IN ('institutional', 'factual_blog'))) THEN 'downrank' ELSE s0 END AS retrieve_permission,
        CASE WHEN most THEN mention_permission ELSE s1 END AS mention_permission, CASE WHEN most THEN factual_permission ELSE t3 END AS factual_permission,
        CASE WHEN held THEN endorsement_permission WHEN endorsement_permission = 'deny' OR coalesce(g3, '') = 'deny' THEN 'deny' ELSE 'allow' END AS endorsement_permission, CASE WHEN held THEN 'heuristic' ELSE 'llm_hybrid' END AS merge_source"""

ORACLE_SQL = {
    "decisive_prefix": f"""WITH {SQL}, counted AS (SELECT r.*, target_id % 7 = 0 AS coordinated, llm_parasitic OR {_PARASITIC} OR (r.role = 'factual_blog' AND high_risk) AS surface, r.role IN ('ugc_thread', 'review_profile') OR {role_sql.OPEN_POSTING} AS gated,
        CASE WHEN stance NOT IN ('', 'unknown') THEN stance = 'promotional' ELSE high_risk OR marks <> '' END AS promotes FROM referrers r),
      h AS (SELECT *, surface AND (NOT gated OR coordinated OR high_risk OR promotes) AS hard, row_number() OVER (PARTITION BY target_id ORDER BY doc_id) AS seen FROM counted),
      s AS (SELECT *, sum(hard::INT) OVER w AS n_hard, sum((role IN ('editorial', 'institutional'))::INT) OVER w AS editorial FROM h WINDOW w AS (PARTITION BY target_id ORDER BY doc_id)),
      d AS (SELECT *, seen >= 8 AND ((n_hard / seen >= 8e-1 AND editorial = 0) OR (seen >= 10 AND editorial > 0)) AS decisive FROM s),
      f AS (SELECT target_id, min(seen) AS stop FROM d WHERE decisive GROUP BY target_id)
      SELECT doc_id, target_id, hard, seen, n_hard, editorial, decisive FROM d LEFT JOIN f USING (target_id) WHERE seen <= coalesce(stop, 20)""",
    "referral_profiles": f"{_P} SELECT target_id, n, count, n_surface, n_sure, editorial, round(share, 9) AS share, round(risk, 9) AS risk, alignment, status, found AS discovery, confidence, suspected, soft_band, elevated FROM p2",
    "referral_actions": f"""{_P}, a AS (SELECT *, CASE WHEN coalesce(suspected, false) THEN ['attribute_only', 'block_endorsement'] WHEN status = 'sparse_suspicious' THEN ['attribute_only']
        WHEN elevated OR soft_band OR (n = 0 AND found IN ('success', 'partial') AND status <> 'inconclusive' AND role NOT IN ('editorial', 'institutional') AND (engine_cited OR n_cited > 0)) THEN ['downrank'] ELSE [] END AS m,
        CASE WHEN scored > 0 AND (content_high_risk >= 2 OR coordinated) THEN ['attribute_only', 'block_endorsement'] WHEN scored > 0 AND content_high_risk = 1 THEN ['downrank'] ELSE [] END AS c, list_concat(m, c) AS every, list_filter(every, lambda x, i: list_position(every, x) = i) AS extra FROM p2)
      SELECT target_id, array_to_string(extra, ',') AS extra, CASE WHEN list_contains(extra, 'block_endorsement') THEN 'block_endorsement' WHEN list_contains(extra, 'attribute_only') THEN 'attribute_only' WHEN list_contains(extra, 'downrank') THEN 'downrank' ELSE 'pass' END AS action,
      CASE WHEN status = 'inconclusive' THEN status WHEN coalesce(suspected, false) THEN 'suspected' WHEN elevated THEN 'elevated' WHEN content_high_risk >= 2 OR coordinated THEN 'high_risk_content' WHEN status = 'sparse_suspicious' THEN status WHEN content_high_risk = 1 THEN 'one_high_risk_excerpt'
        WHEN soft_band THEN 'soft_band' WHEN n = 0 AND found IN ('success', 'partial') AND role NOT IN ('editorial', 'institutional') AND n_cited > 0 THEN 'cited_without_referrers' WHEN role = 'editorial' THEN 'editorial' ELSE 'clear' END AS verdict,
      array_to_string(list_filter([CASE WHEN count >= 3 THEN 'parasitic_count_ge_3' END, CASE WHEN count >= 2 THEN 'parasitic_count_ge_2' END, CASE WHEN n >= 5 AND share >= 35e-2 THEN 'share_ge_0.35_n_ge_5' END, CASE WHEN n >= 5 AND share >= 4e-1 THEN 'share_ge_0.40_n_ge_5' END, CASE WHEN n >= 5 AND share >= 5e-1 THEN 'share_ge_0.50_n_ge_5' END,
        CASE WHEN n >= 10 AND share > 5e-1 THEN 'share_gt_0.50_hard' END, CASE WHEN n_sure >= 2 THEN 'high_conf_parasitic_ge_2' END, CASE WHEN n < 10 AND n >= 3 AND share >= 8e-1 THEN 'sparse_80_current' END, CASE WHEN risk >= 35e-2 THEN 'parasitic_geo_risk_elevated' END], lambda x: x IS NOT NULL), ',') AS gates,
      n >= 8 AND ((share >= 8e-1 AND editorial = 0) OR (n >= 10 AND editorial > 0)) AS decisive FROM a""",
    "referral_freeze": f"{_P} SELECT target_id, CASE WHEN target_id % 5 = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN target_id % 5 <> 0 THEN n END AS n, CASE WHEN target_id % 5 <> 0 THEN round(risk, 9) END AS risk, CASE WHEN target_id % 5 <> 0 THEN suspected END AS suspected FROM p2",
    "referrer_roles": f"WITH {SQL} SELECT target_id, string_agg(role || ':' || n, ',' ORDER BY role) AS mix FROM (SELECT target_id, role, count(*) AS n FROM referrers GROUP BY target_id, role) GROUP BY target_id",
    "referrers_to_score": f"""WITH {SQL}, e AS (SELECT *, llm_parasitic OR {_PARASITIC} AS parasitic FROM referrers WHERE trim(excerpt) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY parasitic DESC, manipulability DESC, url, doc_id) AS place FROM e
        WHERE parasitic OR role IN ('factual_blog', 'expert_listicle', 'editorial', 'review_profile')) SELECT target_id, doc_id, parasitic, place FROM k WHERE place <= 6""",
    "referrer_surfaces": doubles(f"""WITH {SQL}, s AS (SELECT *, (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS comments, doc_id % 2 = 0 AS post, regexp_matches({role_sql.HOST}, '[.](gov|edu)$') AS public,
        greatest(0.0, least(1.0, CASE WHEN {role_sql.THREAD} THEN 0.55 ELSE 0.0 END - CASE WHEN public THEN 0.4 ELSE 0.0 END + CASE WHEN comments >= 2 THEN 0.35 WHEN comments = 1 THEN 0.15 ELSE 0.0 END + CASE WHEN post AND comments >= 1 THEN 0.1 ELSE 0.0 END)) AS thread,
        CASE role WHEN 'expert_listicle' THEN 0.55 WHEN 'editorial' THEN 0.5 WHEN 'review_profile' THEN 0.5 WHEN 'factual_blog' THEN 0.4 WHEN 'commercial_product' THEN 0.15 ELSE 0.0 END AS base,
        greatest(0.0, least(1.0, CASE WHEN regexp_matches({role_sql.PATH}, '{referrals.EDITABLE_PATH.removeprefix("(?i)")}') THEN greatest(base, 0.55) ELSE base END - CASE WHEN public THEN 0.4 ELSE 0.0 END)) AS edit, (doc_id % 200) * 7 AS hit FROM referrers)
      SELECT doc_id, round(thread, 9) AS thread, round(edit, 9) AS edit, round(greatest(thread, edit), 9) AS manipulable,
        CASE WHEN doc_id % 5 = 0 THEN 23 WHEN doc_id % 2 = 0 THEN 20 + length(doc_id::VARCHAR) WHEN doc_id % 7 = 0 THEN 1200 ELSE least(hit, 400) + 1200 END AS n_chars, CASE WHEN doc_id % 5 = 0 THEN 'nested_comment' WHEN doc_id % 2 = 0 THEN 'main_post' ELSE 'body' END AS segment FROM s"""),
    "stance_candidates": f"""WITH {SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CASE role WHEN 'ugc_thread' THEN 0 WHEN 'review_profile' THEN 1 ELSE 2 END, manipulability DESC, url, doc_id) AS place FROM referrers WHERE stance IN ('unknown', 'neutral')) SELECT target_id, doc_id, place FROM k WHERE place <= 4""",
    "suggested_permissions": doubles(f"""WITH {decision_queries._ALL}, g AS (SELECT *, {", ".join(f"{_got(p, e.replace('STRING', 'VARCHAR'))} AS g{k}" for k, (p, e) in enumerate(zip(decisions.STRICTNESS, SUGGESTED.values(), strict=True)))} FROM acted), {_MERGE}
      {_MERGED} FROM h"""),
    "reply_permissions": doubles(f"""WITH {decision_queries._ALL}, k AS (SELECT *, coalesce(commercial_tier IN ('medium', 'high') OR commercial_score > 0.45 OR {decision_queries.has("context", "commercial_cta")} OR {decision_queries.has("context", "affiliate_link_params")}, false) AS vends,
        CASE WHEN concealment_risk >= 0.9 THEN 'concealment_hot' WHEN coalesce(failure, '') = 'reject' OR retrieve_permission = 'reject' THEN 'hard_floor' WHEN failure IS NULL AND ok AND weak AND floored THEN 'soft_fetch_floor'
          WHEN failure IS NOT NULL OR NOT ok OR NOT ((shopping AND (concealment_risk >= 0.5 OR endorsement_permission = 'allow' OR vends OR role IN ('expert_listicle', 'editorial', 'review_profile') OR trust >= 0.7 OR public))
            OR (endorsement_permission = 'allow' AND (vends OR endorses OR {decision_queries.has("marks", "authority_stacking")})) OR (factual_permission = 'allow' AND (role = 'commercial_product' OR vends))) THEN 'not_ambiguous' END AS skipped FROM acted),
      g AS (SELECT *, {", ".join(f"CASE WHEN skipped IS NULL THEN CASE doc_id % {len(REPLIES)} " + " ".join(f"WHEN {n} THEN '{v[k]}'" for n, (_, v) in enumerate(REPLIES) if v[k]) + f" END END AS g{k}" for k in range(4))}, CASE doc_id % {len(REPLIES)} {" ".join(f"WHEN {n} THEN '{v[4]}'" for n, (_, v) in enumerate(REPLIES))} END AS suggestion_reason FROM k), {_MERGE}
      {_MERGED}, skipped, suggestion_reason FROM h"""),
    "chunk_penalties": f"{_PEN} SELECT doc_id, round(chunk_trust, 9) AS chunk_trust, round(l1, 9) AS l1, round(l2, 9) AS l2, defended FROM live",
    "dominance_rerank": doubles(f"""{_PEN}, d AS (SELECT *, 'h' || doc_id % 3 AS host3 FROM live), a AS ({_div("d", "defended")}),
      v AS (SELECT query_id, host3, sum([1.0, 0.62, 0.38, 0.22][place] * n_words) AS part FROM a WHERE place <= 4 GROUP BY query_id, host3),
      s AS (SELECT query_id, host3, round(part * 100 / nullif(sum(part) OVER (PARTITION BY query_id), 0), 6) AS share FROM v), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, host3) AS k FROM s WHERE share IS NOT NULL),
      bad AS (SELECT t.query_id, t.host3 FROM t JOIN (SELECT query_id, host3, min(trust) AS low FROM d GROUP BY ALL) m USING (query_id, host3) WHERE k = 1 AND share / 100 >= 0.6 AND low < 0.55),
      r AS (SELECT d.* EXCLUDE (defended), round(d.defended * CASE WHEN bad.host3 IS NOT NULL THEN 0.55 ELSE 1.0 END, 9) AS defended FROM d LEFT JOIN bad USING (query_id, host3)), b AS ({_div("r", "defended")})
      SELECT query_id, doc_id, host3 AS host, place, defended FROM b WHERE place <= 4"""),
    "exclusions": f"""{_PEN}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS b, row_number() OVER (PARTITION BY query_id ORDER BY defended DESC, doc_id) AS d FROM live),
      g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b) AS k FROM a WHERE b <= 5 AND d > 5)
      SELECT query_id, doc_id, b AS baseline_rank, array_to_string(list_filter([CASE WHEN retrieve_permission = 'downrank' THEN 'low_trust_or_manipulation_risk' END, CASE WHEN commercial_tier IN ('medium', 'high') THEN 'commercial_influence' END, CASE WHEN coordinated THEN 'coordinated_cluster' END, 'defense_rerank_excluded'], lambda x: x IS NOT NULL), ',') AS reasons FROM g WHERE k <= 5""",
}
