"""Queries of the decision operators over the sheet of sources, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.operators import commerce, decisions, guard, signals, similarity
from sourcelens.plans import role_sql
from sourcelens.plans.sheet import QUERY, SQL, sheet

PERMISSIONS = list(decisions.STRICTNESS)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.actions(decisions.permissions(decisions.subscores(sheet(spark, sf_dir))))


def source_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["confidence", "rhetorical", "retrieval_risk", "reliability", "mismatch", "harm", "endorsement_risk"]
    return _decided(spark, sf_dir).select("doc_id", "role", "failure", *(F.round(c, 9).alias(c) for c in names))


def source_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decided(spark, sf_dir)
    action = signals.endorsement_action(F.col("endorsement_risk"))
    return rows.select("doc_id", *PERMISSIONS, F.array_join("actions", ",").alias("actions"), "recommended_action", decisions.summary_action(rows).alias("summary_action"), action.alias("risk_action"))


def _commercial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.for_cited_thread(_decided(spark, sf_dir)).withColumns({"coordinated": F.col("consensus") == "coordinated", "defended_rank": F.col("rank")})
    return commerce.influence(rows)


def commercial_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commercial(spark, sf_dir)
    told = rows.select("doc_id", "tier", F.array_join("triggers", ",").alias("triggers"), "disclosure_level", "response_mode")
    tight = commerce.tighten(rows).select("doc_id", *PERMISSIONS)
    return told.join(tight, "doc_id")


def query_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the strictest permission that commerce leaves to any of its sources."""
    return decisions.tightest(commerce.tighten(_commercial(spark, sf_dir)), "query_id")


def _guarded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = commerce.tighten(_commercial(spark, sf_dir)).withColumn("endorsement_allowed", F.col("endorsement_permission") == "allow")
    return rows, rows.select("query_id", *QUERY).distinct().withColumn("entity", F.when(F.col("query_id") % 3 == 0, "Acme Kettle"))


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.verdicts(*_guarded(spark, sf_dir))


def claim_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _guarded(spark, sf_dir)
    asked = queries.select("query_id", F.lit("Acme Kettle").alias("claim"), "intent", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))
    return guard.corroboration(rows, asked).withColumn("reasons", F.array_join("reasons", ","))


def answer_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commercial(spark, sf_dir)
    answers = rows.where("rank = 1").select("query_id", F.concat(F.lit("A: "), "text").alias("answer"))
    out = commerce.disclosures(rows, answers)
    return out.select("query_id", "n_disclosures", F.array_join("urls", " ").alias("urls"), commerce.disclosed(F.lit("A"), F.col("label")).alias("shown"))


def query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus from how far a query's texts are one text, dominance from what is seen."""
    rows = sheet(spark, sf_dir)
    texts = rows.select(F.col("query_id").alias("scope"), F.col("doc_id").alias("ident"), "text")
    clusters = similarity.independence(spark, texts).withColumnsRenamed({"scope": "query_id", "n_texts": "n_urls"})
    visibility = rows.where("query_id % 4 <> 0").groupBy("query_id").agg(F.max(F.col("dominance") * 100).alias("dominant_share")).withColumn("alert", F.col("dominant_share") >= 60)
    out = guard.query_context(clusters, visibility)
    return out.join(clusters, "query_id").select("query_id", "n_clusters", F.round("max_similarity", 3).alias("max_similarity"), "consensus", F.round("dominance", 9).alias("dominance"))


QUERIES = {f.__name__: f for f in (source_subscores, source_decisions, commercial_influence, query_permissions, guard_verdicts, claim_corroboration, answer_disclosures, query_context)}


def doubles(sql: str) -> str:
    """Decimal numbers as doubles, so that sums round as Spark's do."""
    return re.sub(r"(?<![\w.'])(\d+)\.(\d+)", lambda m: f"{m[1]}{m[2]}e-{len(m[2])}", sql)


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '" + pattern.replace("'", "''") + "')"


has = lambda column, name: f"list_contains(string_split({column}, ','), '{name}')"
_ROLE = role_sql.page_role(f"""WHEN commercial_tier IN ('medium', 'high') AND {has("context", "commercial_cta")} THEN 'commercial_product' WHEN commercial_tier IN ('medium', 'high') THEN 'expert_listicle'
  WHEN {_m("path", "/(wiki|docs|reference|encyclopedia)" + chr(92) + "b")} THEN 'factual_blog' WHEN {_m("text", C.BUY_TEXT)} THEN 'commercial_product' WHEN {_m("text", C.AFFILIATE_TEXT)} THEN 'expert_listicle'""")
_TESTS = f"""tests AS (SELECT *, {_ROLE} AS role, {_m("query", C.WANTS_RECOMMENDATION)} AS asks, {_m("text", C.ENDORSES)} AS praises, {_m("text", C.MEDICAL_CLAIM)} AS cures, {_m("text", C.ALTERNATIVES)} AS others,
  {_m("query", decisions.BRAND_LEGIT)} AS legit, {_m("query", decisions.UGC_INTENT)} AS ugc, {_m("path", decisions.COMMERCIAL_PATH)} AS sells, {_m("path", decisions.REFERENCE_PATH)} AS refers,
  {has("marks", "balanced_hedging")} OR {has("marks", "mentions_alternatives")} AS balanced, intent LIKE 'informational%' AS info, intent IN ('commercial', 'navigational') AS shopping,
  {" OR ".join(f"regexp_replace(host, '^www[.]', '') = '{h}' OR host LIKE '%.{h}'" for h in C.NEWS_HOSTS)} AS news, regexp_matches(host, '[.](gov|edu)$') AS public FROM sheet)"""
_SCORES = doubles(f"""scores AS (SELECT * EXCLUDE (rhetorical), least(1.0, rhetorical + CASE WHEN {has("concealed", "hidden_geo_rhetoric")} THEN 0.2 WHEN {has("concealed", "hidden_chrome_rhetoric")} THEN 0.08 ELSE 0.0 END) AS rhet,
  CASE WHEN NOT ok AND status_code IN (404, 410) THEN 'reject' WHEN NOT ok THEN 'defer' END AS failure,
  CASE WHEN NOT ok AND failure = 'reject' THEN 0.0 WHEN NOT ok THEN 0.2 ELSE least(1.0, 0.75 + CASE WHEN n_words >= 80 THEN 0.15 WHEN n_words >= 40 THEN 0.05 WHEN n_words < 20 THEN -0.25 ELSE 0.0 END + CASE WHEN fetch_engine = 'playwright' THEN 0.05 ELSE 0.0 END) END AS confidence,
  least(1.0, front_load * greatest(0.2, rhet, comparative, authority * 0.5)) + CASE WHEN {has("context", "faq_schema")} AND rhet > 0.25 THEN 0.12 ELSE 0.0 END + CASE WHEN list_items > 8 AND rhet > 0.25 THEN 0.08 ELSE 0.0 END AS r1,
  least(1.0, r1 + CASE WHEN commercial_score > 0.45 THEN 0.1 * commercial_score ELSE 0.0 END + CASE WHEN asks AND rhet > 0.3 THEN 0.1 ELSE 0.0 END + 0.55 * concealment_risk) AS retrieval_risk,
  greatest(0.0, least(1.0, 0.55 + CASE WHEN balanced THEN 0.18 ELSE 0.0 END + CASE WHEN {has("marks", "quote_citation_heavy")} THEN 0.08 ELSE 0.0 END + CASE WHEN coalesce(whois_age_days, 0) > 1095 THEN 0.1 ELSE 0.0 END
    + CASE WHEN ok AND (public OR news) THEN 0.1 ELSE 0.0 END + CASE WHEN n_words < 80 THEN -0.18 ELSE 0.0 END + CASE WHEN rhet > 0.45 THEN -0.2 * rhet ELSE 0.0 END
    + CASE WHEN info AND commercial_score > 0.45 AND NOT asks THEN -0.2 ELSE 0.0 END + CASE WHEN {has("marks", "high_stakes_medical_claim")} AND trust < 0.55 THEN -0.25 ELSE 0.0 END + CASE WHEN refers THEN 0.12 ELSE 0.0 END)) AS reliability,
  (CASE WHEN commercial_score > 0.5 THEN 0.45 ELSE 0.0 END + CASE WHEN sells THEN 0.35 ELSE 0.0 END) * CASE WHEN balanced THEN 0.3 ELSE 1.0 END * CASE WHEN refers THEN 0.2 ELSE 1.0 END AS m1,
  CASE WHEN shopping THEN CASE WHEN sells THEN 0.0 WHEN commercial_score > 0.5 THEN 0.15 ELSE 0.25 END ELSE least(1.0, m1 + CASE WHEN NOT asks AND m1 > 0 THEN 0.1 ELSE 0.0 END) END AS mismatch,
  CASE WHEN intent LIKE '%high_stakes' THEN 0.85 WHEN info THEN 0.35 ELSE 0.15 END AS harm,
  praises OR comparative > 0.35 OR {has("marks", "comparative_superlatives")} AS endorses,
  semantic_risk * greatest(front_load, 0.35) * (1 - trust) * (CASE WHEN asks THEN CASE WHEN endorses THEN 1.0 ELSE 0.35 END ELSE 0.25 END) * CASE WHEN balanced THEN 0.2 ELSE 1.0 END * CASE WHEN commercial_score > 0.4 AND NOT asks THEN 0.1 ELSE 1.0 END AS e1,
  CASE WHEN asks AND endorses AND trust < 0.62 AND NOT balanced THEN greatest(e1, 0.5) ELSE e1 END AS e2,
  CASE WHEN asks AND trust < 0.62 AND {has("marks", "planted_mention")} THEN greatest(e2, 0.2) ELSE e2 END AS e3,
  CASE WHEN info THEN least(1.0, e3) ELSE 0.0 END AS endorsement_risk FROM tests)""")
_PERMITTED = doubles(f"""permitted AS (SELECT *, consensus = 'coordinated' AS coordinated, role IN ('ugc_thread', 'institutional') OR (role = 'factual_blog' AND trust >= 0.55) AS floored, confidence < 0.25 AS weak,
  shopping AND role IN ('expert_listicle', 'review_profile') AS listicle, role = 'commercial_product' AS vendor, concealment_risk >= 0.5 AND concealment_risk < 0.9 AS soft,
  CASE WHEN failure = 'reject' THEN 'reject' WHEN failure = 'defer' OR (weak AND NOT floored) THEN 'defer'
    WHEN concealment_risk >= 0.9 THEN CASE WHEN (listicle OR role = 'institutional' OR (vendor AND (shopping OR legit))) AND NOT {has("concealed", "promotional_instruction_pattern")} AND mismatch < 0.5 THEN 'downrank' ELSE 'reject' END
    WHEN ((soft AND NOT listicle) OR mismatch >= 0.5 OR dominance >= 0.6 OR coordinated OR trust < 0.35) AND NOT (role = 'ugc_thread' AND ugc AND NOT coordinated) THEN 'downrank'
    WHEN shopping AND vendor AND (legit OR trust < 0.35 OR (soft AND mismatch >= 0.5)) THEN 'downrank' ELSE 'allow' END AS retrieve_permission,
  CASE WHEN failure IS NOT NULL OR (confidence < 0.1 AND NOT floored) THEN 'deny' ELSE 'allow' END AS mention_permission,
  trust >= 0.55 AND reliability >= 0.55 AND mismatch < 0.35 AS sound,
  CASE WHEN weak THEN CASE WHEN role = 'institutional' AND sound THEN 'allow' ELSE 'attribute_only' END WHEN concealment_risk >= 0.45 AND (reliability < 0.55 OR concealment_risk >= 0.7) THEN 'attribute_only'
    WHEN trust < 0.45 OR reliability < 0.45 THEN 'attribute_only' WHEN sound AND concealment_risk < 0.45 THEN 'allow' ELSE 'attribute_only' END AS f1,
  CASE WHEN failure = 'reject' THEN 'deny' WHEN failure = 'defer' THEN 'attribute_only' WHEN weak AND NOT floored THEN 'deny' WHEN NOT weak AND coordinated AND reliability < 0.5 THEN 'deny'
    WHEN NOT weak AND harm >= 0.7 AND (reliability < 0.45 OR trust < 0.5) THEN 'deny' WHEN NOT weak AND harm >= 0.7 AND (reliability < 0.6 OR trust < 0.6) THEN 'require_corroboration'
    WHEN vendor AND legit THEN 'attribute_only' WHEN shopping AND legit AND role IN ('ugc_thread', 'review_profile') THEN 'require_corroboration'
    WHEN shopping AND (role IN ('ugc_thread', 'review_profile', 'expert_listicle') OR (vendor AND trust < 0.55)) THEN 'attribute_only' ELSE f1 END AS f2,
  retrieve_permission = 'reject' AND coalesce(failure, '') <> 'reject' AS attacked, CASE WHEN attacked THEN 'deny' ELSE f2 END AS factual_permission,
  {has("marks", "comparative_superlatives")} OR {has("marks", "authority_stacking")} OR comparative > 0.35 AS persuasive,
  CASE WHEN f2 = 'deny' OR attacked OR coalesce(failure, '') = 'defer' OR coordinated OR (shopping AND role IN ('commercial_product', 'institutional')) OR endorsement_risk >= 0.5 OR (endorsement_risk >= 0.05 AND trust < 0.62)
    OR (harm >= 0.7 AND persuasive AND trust < 0.62) OR (intent = 'informational_high_stakes' AND {has("marks", "high_stakes_medical_claim")} AND cures AND trust < 0.55 AND NOT {has("marks", "balanced_hedging")}) THEN 'deny' ELSE 'allow' END AS endorsement_permission FROM scores)""")
_ORDER = ", ".join(f"'{a}'" for a in decisions.ACTION_ORDER)
_ACTED = doubles(f"""acted AS (SELECT *, list_filter([CASE retrieve_permission WHEN 'reject' THEN 'reject' WHEN 'defer' THEN 'defer_fetch' WHEN 'downrank' THEN 'downrank' END, CASE WHEN coordinated THEN 'reject_consensus' END,
    CASE WHEN mention_permission = 'deny' AND retrieve_permission NOT IN ('defer', 'reject') THEN 'reject' END,
    CASE factual_permission WHEN 'deny' THEN 'block_factual_use' WHEN 'require_corroboration' THEN 'require_corroboration' WHEN 'attribute_only' THEN 'attribute_only' END,
    CASE WHEN factual_permission = 'require_corroboration' AND harm >= 0.7 THEN 'require_authoritative_corroboration' END, CASE WHEN endorsement_permission = 'deny' THEN 'block_endorsement' END], lambda x: x IS NOT NULL) AS a1,
  CASE WHEN len(a1) = 0 OR (mention_permission = 'allow' AND factual_permission = 'allow' AND endorsement_permission = 'allow') THEN list_append(a1, 'pass') WHEN mention_permission = 'allow' THEN list_append(a1, 'mention_only') ELSE a1 END AS actions,
  [{_ORDER}][list_min(list_transform(actions, lambda x: list_position([{_ORDER}], x)))] AS recommended_action,
  CASE WHEN retrieve_permission = 'reject' THEN 'reject' WHEN retrieve_permission = 'defer' THEN 'defer_fetch' WHEN endorsement_permission = 'deny' AND (endorsement_risk >= 0.2 OR rhet >= 0.35) THEN 'block_endorsement'
    WHEN retrieve_permission = 'downrank' OR endorsement_risk >= 0.2 OR concealment_risk >= 0.5 OR (rhet >= 0.55 AND trust < 0.55) THEN 'downrank' ELSE 'pass' END AS summary_action FROM permitted)""")
_COMMERCE = doubles(f"""commerce AS (SELECT * EXCLUDE (factual_permission, endorsement_permission), CASE WHEN role = 'ugc_thread' AND factual_permission = 'allow' THEN 'attribute_only' ELSE factual_permission END AS factual_permission,
  CASE WHEN role = 'ugc_thread' THEN 'deny' ELSE endorsement_permission END AS endorsement_permission,
  {has("context", "press_release")} AND {has("marks", "comparative_superlatives")} AND commercial_tier <> 'high' AS press, CASE WHEN press THEN 'high' ELSE commercial_tier END AS t1,
  {has("context", "commercial_cta")} AND endorses AND t1 = 'low' AS cta, CASE WHEN cta THEN 'medium' ELSE t1 END AS tier, coordinated AND tier IN ('medium', 'high') AS grouped, NOT grouped AND NOT shopping AS opened,
  opened AND tier = 'high' AS high, opened AND tier = 'medium' AND asks AND endorses AS medium, opened AND tier = 'none' AND {has("marks", "planted_mention")} AND asks AND NOT endorses AS plant, trust < 0.62 AS low,
  array_to_string(list_filter([CASE WHEN press THEN 'press_release_with_comparative_superlatives' END, CASE WHEN cta THEN 'commercial_cta_with_endorsement' END, CASE WHEN grouped THEN 'coordinated_cluster' END], lambda x: x IS NOT NULL), ',') AS triggers,
  CASE WHEN grouped OR (high AND rank <= 3) THEN 'label' WHEN medium THEN 'hedge' ELSE 'none' END AS disclosure_level,
  CASE WHEN grouped THEN '{commerce.LABEL_COORDINATED}' WHEN high AND rank <= 3 THEN '{commerce.LABEL_HIGH}' WHEN medium THEN '{commerce.HEDGE_MEDIUM}' ELSE '' END AS disclosure_text,
  CASE WHEN grouped OR (high AND asks AND endorses AND low) THEN 'refuse_endorsement' WHEN (high AND asks AND (endorses OR low)) OR plant THEN 'attributed_answer' WHEN high OR medium THEN 'hedged_answer' END AS response_mode FROM acted)""")
_TIGHT = doubles("""tight AS (SELECT * EXCLUDE (retrieve_permission, factual_permission, endorsement_permission),
  CASE WHEN retrieve_permission = 'allow' AND (grouped OR high OR (medium AND low) OR (opened AND tier = 'low' AND NOT endorses)) THEN 'downrank' ELSE retrieve_permission END AS retrieve_permission,
  CASE WHEN grouped OR (high AND harm >= 0.7 AND trust < 0.45) THEN 'deny' WHEN high AND factual_permission = 'allow' THEN 'attribute_only' WHEN medium AND factual_permission IN ('allow', 'attribute_only') THEN 'require_corroboration' ELSE factual_permission END AS factual_permission,
  CASE WHEN grouped OR (high AND (endorses OR asks)) OR medium OR plant THEN 'deny' ELSE endorsement_permission END AS endorsement_permission FROM commerce)""")
_ALL = ", ".join((SQL, _TESTS, _SCORES, _PERMITTED, _ACTED))
_SOLD = f"{_ALL}, {_COMMERCE}, {_TIGHT}"
_levels = lambda p: "[" + ", ".join(f"'{v}'" for v in decisions.STRICTNESS[p]) + "]"
_INSTITUTION = "(contains(host, '.gov') OR contains(host, '.edu') OR coalesce(trust >= 75e-2 AND whois_age_days > 1825, false))"
_GUARD = doubles(f"""own AS (SELECT *, mention_permission <> 'deny' AS usable, CASE WHEN mention_permission <> 'deny' THEN row_number() OVER (PARTITION BY query_id, mention_permission <> 'deny' ORDER BY rank) END AS place,
    CASE WHEN query_id % 3 = 0 THEN 'Acme Kettle' END AS given FROM tight),
  named AS (SELECT *, max(CASE WHEN place = 1 THEN coalesce(given, regexp_extract_all(text, '{C.TITLE_CASE}')[1], 'unknown') END) OVER (PARTITION BY query_id) AS entity FROM own),
  seen AS (SELECT *, usable AND contains(lower(text), lower(entity)) AS names, {_INSTITUTION} AS institution, segment IN ('comment', 'sidebar') OR (role IN ('ugc_thread', 'review_profile', 'expert_listicle') AND segment <> 'main_post') AS softly,
    {has("marks", "planted_mention")} OR semantic_risk >= 0.45 AS risky, {role_sql.OPEN_POSTING} OR {role_sql.PUBLISH} OR {role_sql.DIRECTORY} OR role IN ('review_profile', 'ugc_thread') OR (role = 'factual_blog' AND risky) AS parasitic,
    role IN ('institutional', 'editorial') OR (role = 'factual_blog' AND segment IN ('main_post', 'body') AND trust >= 0.55) AS editorial FROM named),
  f AS (SELECT query_id, any_value(query) AS query, any_value(intent) AS intent, any_value(consensus) AS consensus, any_value(n_clusters) AS n_clusters, any_value(asks) AS asks, count(*) FILTER (usable) AS n_usable, count(*) FILTER (NOT usable) AS n_skipped, max(entity) AS entity,
    count(DISTINCT CASE WHEN names AND trust >= 0.5 AND NOT softly THEN host END) AS n_support, bool_or(names AND editorial) OR bool_or(institution) AS relief, count(*) FILTER (names) AS n_names, count(*) FILTER (names AND (softly OR parasitic)) AS n_soft,
    count(DISTINCT CASE WHEN names THEN url END) AS n_urls, bool_or(names AND institution) AS backed, max(CASE WHEN names THEN trust END) AS most, max(CASE WHEN place = 1 THEN url END) AS lead_url, max(CASE WHEN place = 1 THEN trust END) AS lead_trust,
    max(CASE WHEN place = 1 THEN factual_permission END) AS factual, max(CASE WHEN place = 1 THEN endorsement_permission END) AS endorsement, max(CASE WHEN place = 1 THEN response_mode END) AS mode2,
    bool_or(place = 1 AND cures) AS cures, bool_or(place = 1 AND praises) AS praises, bool_or(place = 1 AND (balanced OR others)) AS hedged, bool_or(place = 1 AND {has("marks", "planted_mention")}) AS planted FROM seen GROUP BY query_id),
  g AS (SELECT *, CASE factual WHEN 'deny' THEN 'refuse_factual_use' WHEN 'require_corroboration' THEN 'hedged_answer' WHEN 'attribute_only' THEN 'attributed_answer' ELSE 'direct_answer' END AS mode, n_names >= 1 AND n_names = n_soft AND NOT relief AND lead_trust < 0.62 AS cluster,
    coalesce(endorsement = 'deny', false) AS denied, CASE WHEN n_usable = 0 THEN 'omit_unmentionable_sources' WHEN consensus = 'coordinated' THEN 'reject_consensus' WHEN n_clusters = 1 AND n_urls >= 2 AND NOT backed AND most < 0.55 THEN 'reject_false_consensus'
      WHEN factual = 'deny' THEN 'block_factual_use' WHEN cures AND intent LIKE '%high_stakes' AND lead_trust < 0.55 THEN 'downgrade_to_attribution' WHEN lead_trust >= 0.55 AND hedged THEN 'pass_balanced_editorial' WHEN factual = 'attribute_only' THEN 'attribute_only'
      WHEN factual = 'require_corroboration' THEN 'require_corroboration' WHEN cluster AND praises AND (asks OR denied) THEN 'block_endorsement_ugc_only_cluster' WHEN cluster AND planted AND NOT praises AND asks THEN 'hedge_ugc_planted_cluster'
      WHEN (praises OR denied) AND lead_trust < 0.62 AND (n_support < 2 OR endorsement <> 'allow') THEN 'block_endorsement_insufficient_corroboration' ELSE 'pass_through' END AS action FROM f)""")

ORACLE_SQL = {
    "source_subscores": f"WITH {_ALL} SELECT doc_id, role, failure, round(confidence, 9) AS confidence, round(rhet, 9) AS rhetorical, round(retrieval_risk, 9) AS retrieval_risk, round(reliability, 9) AS reliability, round(mismatch, 9) AS mismatch, harm, round(endorsement_risk, 9) AS endorsement_risk FROM scores",
    "source_decisions": f"WITH {_ALL} SELECT doc_id, {', '.join(PERMISSIONS)}, array_to_string(actions, ',') AS actions, recommended_action, summary_action, CASE WHEN endorsement_risk >= 5e-1 THEN 'block_endorsement' WHEN endorsement_risk >= 2e-1 THEN 'downrank' ELSE 'pass' END AS risk_action FROM acted",
    "commercial_influence": f"WITH {_SOLD} SELECT doc_id, tier, triggers, disclosure_level, response_mode, {', '.join(PERMISSIONS)} FROM tight",
    "query_permissions": f"WITH {_SOLD} SELECT query_id, {', '.join(f'{_levels(p)}[max(list_position({_levels(p)}, {p}))] AS {p}' for p in PERMISSIONS)} FROM tight GROUP BY query_id",
    "guard_verdicts": f"""WITH {_SOLD}, {_GUARD} SELECT query_id, CASE WHEN action IN ('reject_consensus', 'reject_false_consensus') THEN 'false_consensus' WHEN action IN ('block_factual_use', 'downgrade_to_attribution', 'require_corroboration') THEN 'factual_claim' WHEN action LIKE 'block_endorsement%' THEN 'endorsement' ELSE 'mention' END AS kind,
      CASE WHEN action = 'block_endorsement_insufficient_corroboration' THEN n_support >= 2 ELSE action IN ('pass_balanced_editorial', 'attribute_only', 'hedge_ugc_planted_cluster', 'pass_through') END AS passed, action,
      CASE action WHEN 'omit_unmentionable_sources' THEN 'omit_sources' WHEN 'block_factual_use' THEN 'refuse_factual_use' WHEN 'downgrade_to_attribution' THEN 'attributed_answer' WHEN 'attribute_only' THEN 'attributed_answer' WHEN 'require_corroboration' THEN 'hedged_answer' WHEN 'hedge_ugc_planted_cluster' THEN 'hedged_answer'
        WHEN 'pass_balanced_editorial' THEN CASE WHEN mode <> 'direct_answer' THEN mode ELSE 'hedged_answer' END WHEN 'pass_through' THEN coalesce(mode2, mode) ELSE 'refuse_endorsement' END AS response_mode, entity, lead_url, n_skipped > 0 AS skipped FROM g""",
    "claim_corroboration": f"""WITH {_SOLD}, s AS (SELECT query_id, any_value(intent) AS intent, coalesce(any_value(n_clusters), 0) AS n_clusters, count(*) FILTER (contains(lower(text), 'acme kettle') AND trust >= 55e-2 AND endorsement_permission = 'allow') AS n_support, coalesce(bool_or(contains(lower(text), 'acme kettle') AND {_INSTITUTION}), false) AS institutional FROM tight GROUP BY query_id)
      SELECT query_id, 'Acme Kettle' AS claim, n_support, institutional, n_clusters >= 2 AND n_support >= 2 AND (intent NOT LIKE 'informational%' OR institutional) AS endorsement_allowed,
      array_to_string(list_filter([CASE WHEN n_clusters < 2 THEN 'only_' || n_clusters || '_independent_text_cluster(s)' END, CASE WHEN n_support < 2 THEN 'only_' || n_support || '_trusted_source(s)_mention_Acme Kettle' END, CASE WHEN intent LIKE 'informational%' AND NOT institutional THEN 'no_institutional_corroboration' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""",
    "answer_disclosures": f"""WITH {_SOLD}, a AS (SELECT query_id, list_distinct(regexp_extract_all(lower('A: ' || text), '[a-z0-9]+')) AS b FROM tight WHERE rank = 1),
      d AS (SELECT query_id, url, rank, disclosure_text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t, b, rank = min(rank) OVER (PARTITION BY query_id) AS lead, disclosure_level = 'label' AND tier = 'high' AS labelled FROM tight JOIN a USING (query_id)),
      s AS (SELECT query_id, list(url ORDER BY rank, url, disclosure_text) AS urls, list(disclosure_text ORDER BY rank, url, disclosure_text) AS texts FROM d WHERE labelled AND (lead OR len(list_intersect(t, b)) / (len(t) + len(b) - len(list_intersect(t, b))) >= 15e-2) GROUP BY query_id)
      SELECT query_id, len(urls)::INT AS n_disclosures, array_to_string(urls, ' ') AS urls, '## Disclosure' || chr(10) || array_to_string(list_filter(texts, lambda x, i: list_position(texts, x) = i), chr(10) || chr(10)) || chr(10) || chr(10) || 'A' AS shown FROM s""",
    "query_context": f"""WITH RECURSIVE {SQL}, x1 AS (SELECT query_id, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS k FROM sheet),
      x2 AS (SELECT a.query_id, a.doc_id AS u, b.doc_id AS v, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) AS sim FROM x1 a JOIN x1 b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id),
      x3(query_id, u, v) AS (SELECT query_id, doc_id, doc_id FROM x1 UNION SELECT x3.query_id, x3.u, x2.v FROM x3 JOIN x2 ON x3.v = x2.u AND x2.sim >= 45e-2),
      c AS (SELECT query_id, count(DISTINCT low) AS k FROM (SELECT query_id, u, min(v) AS low FROM x3 GROUP BY ALL) GROUP BY query_id),
      t AS (SELECT query_id, round(max(sim), 3) AS m FROM x2 WHERE round(sim, 9) >= 35e-2 GROUP BY query_id),
      q AS (SELECT query_id, count(*) AS n, CASE WHEN query_id % 4 <> 0 THEN max(dominance * 100) END AS d FROM sheet GROUP BY query_id)
      SELECT query_id, k AS n_clusters, m AS max_similarity, CASE WHEN k = 1 AND n >= 2 AND m >= 35e-2 THEN 'coordinated' WHEN k < 2 THEN 'shaky' ELSE 'healthy' END AS consensus, round(CASE WHEN d >= 60 THEN greatest(d / 100, 65e-2) ELSE coalesce(d / 100, 0) END, 9) AS dominance FROM q JOIN c USING (query_id) LEFT JOIN t USING (query_id)""",
}
