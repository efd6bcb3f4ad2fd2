"""Queries of label, impression, tier, claim and rewrite operators over rows made from ids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.operators import audit, claims, impressions, labels, rewrites, tiers
from sourcelens.plans import role_sql, sheet
from sourcelens.plans.decision_queries import doubles
from sourcelens.plans.sheet import pick, text
from sourcelens.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *(f"{e} AS {c}" for c, e in columns.items()))


_as_cte = lambda name, columns: f"{name} AS (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM documents)"

FIELD = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(labels.LEVELS)) + " END"
_levels = list(labels.LEVELS.values())


def _level(factor: int) -> str:
    """A level of the row's field by its number, or null."""
    n = f"(doc_id * {factor} // 5)"
    return "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {pick(n, *text(*own), own[0] and repr(own[0]), 'CAST(NULL AS STRING)')}" for k, own in enumerate(_levels)) + " END"


SIDES = {"field": FIELD, "adjudicated": _level(3), "human": _level(7), "llm": _level(11), "anti": _level(13), "parasitic_source": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'rules' END"}


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, {c: e.replace("//", "div") for c, e in SIDES.items()}).withColumnRenamed("doc_id", "id")


def label_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.comparisons(_sides(spark, sf_dir))


def label_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sides(spark, sf_dir)
    found = labels.disagreements(rows.select("id", "field", F.col("adjudicated").alias("value")), rows.select("id", "field", F.col("anti").alias("value")))
    return labels.error_order(found, ["factual_permission", "parasitic"])


def label_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = labels.comparisons(_sides(spark, sf_dir)).where("comparison = 'anti_vs_adjudicated'").select("field", "macro_f1")
    return labels.knobs(scores, {"retrieve_permission": 0.2, "factual_permission": 0.65, "endorsement_permission": 0.3, "mention_permission": 0.95}, ["mention_permission"])


def sheet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels of a wide sheet are no labels, which pages would give the system's view away, and the three tiers."""
    rows = _docs(spark, sf_dir, {f: pick(f"doc_id * {k + 2}", *text(*v), "'bad'", "CAST(NULL AS STRING)") for k, (f, v) in enumerate(labels.LEVELS.items())})
    page = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ',"predictions":{"a":1}').when(F.col("doc_id") % 3 == 1, ',"predictions":{}').otherwise(""), F.when(F.col("doc_id") % 4 == 0, ',"llm_action":"pass"').otherwise(',"subscores":null'), F.lit("}"))
    tier = labels.three_tiers(F.when(F.col("doc_id") % 5 == 0, F.lit(True)), F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 7 == 0, "sparse_suspicious"))
    return rows.select("doc_id", F.array_join(labels.invalid(rows), ",").alias("invalid"), F.array_join(labels.leaks(page), ",").alias("leaks"), tier.alias("tier"))


def blank_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet.sheet(spark, sf_dir)
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "url"))), lambda x: x["url"]).alias("urls"))  # eight a query
    return labels.sheet_rows(lists.select(F.col("query_id").alias("ord"), F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), "urls"), "v1p")


def sheet_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet.sheet(spark, sf_dir)
    own = rows.select(F.col("doc_id").alias("id"), "query_id", F.col("rank").alias("position"), F.concat("url", F.when(F.col("doc_id") % 3 == 0, "/").otherwise("?x=%41")).alias("url"))
    results = rows.where("doc_id % 5 <> 0").select("query_id", F.col("rank").alias("position"), F.when(F.col("doc_id") % 2 == 0, F.upper("url")).otherwise("https://z.org").alias("url"), F.concat("url", F.lit("?x=A")).alias("final_url"), F.col("doc_id").alias("value"))
    return labels.matched(own, results)


def entity_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, {"target": "'https://T.org/' || CAST(doc_id % 17 AS STRING) || '/'", "referrer": "'https://r.org/' || CAST(doc_id % 5 AS STRING)", "bucket": pick("doc_id * 7", *text(*labels.BUCKETS)), "present": "doc_id % 2 = 0", "ord": "CAST(doc_id AS INT)", "entity": "'e' || CAST(doc_id % 9 AS STRING)"})
    return labels.best_entity(rows)


def latest_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events as a keyed table, less those with an event of a type that a cache holds."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = labels.latest(rows, "user_id", "event_id")
    return labels.missing(last, rows.where("event_id % 50 = 0").select("user_id"), "user_id")


CITED = {
    "answer": "'Kettle words one stand here [' || CAST(doc_id % 4 + 1 AS STRING) || ']. Another longer sentence follows it [' || CAST(doc_id % 3 + 2 AS STRING) || '][' || CAST(doc_id % 7 AS STRING) || ']! No source here? ' || chr(10) || chr(10) || 'Second paragraph of words [' || CAST(doc_id % 5 + 1 AS STRING) || ']. The end'",
}


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, CITED).select(F.col("doc_id").alias("answer_id"), F.col("answer").alias("text"), F.lit(5).alias("n_sources"))


def cited_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions.impressions(_answers(spark, sf_dir))


def rewrite_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, {"query_id": "doc_id % 8", "method": pick("doc_id", "CAST(NULL AS STRING)", "'quotes'", "'stats'"), "completion": "doc_id % 2", "source": "doc_id % 5", "score": "(doc_id * 17 % 50) / 1e2", "idx": "(doc_id % 8) % 5"})
    return impressions.improvements(rows)


def method_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, {"method": pick("doc_id", *text("quotes", "stats", "none")), "simple": "(doc_id * 17 % 64) / 64e0", "subjective": "(doc_id * 5 % 32) / 32e0"})
    return impressions.leaderboard(rows, ["simple", "subjective"], "simple")


def attack_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet.sheet(spark, sf_dir).select("doc_id", "text", "query")
    return rewrites.rewritten(rows).select("doc_id", "method", "rewritten")


def attack_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"suite": pick("doc_id", *text("attack", "false_positive")), "method": pick("doc_id * 5", *text(*rewrites.FORMATS)), "baseline_share": "(doc_id % 64) * 1e0", "defended_share": "(doc_id % 32) * 1e0", "baseline_rank": "CAST(doc_id % 5 + 1 AS INT)", "defended_rank": pick("doc_id", "1", "3", "CAST(NULL AS INT)", "5")}
    return rewrites.outcome(_docs(spark, sf_dir, columns))


TIERED = {
    "query": "'q' || CAST(doc_id % 13 AS STRING)", "url": sheet.SOURCE["host"].replace("CASE", "'https://' || CASE", 1) + " || '/' || CAST(doc_id % 20 AS STRING)",
    "llm_action": pick("doc_id * 3", *text("pass", "downrank", "block_endorsement", "attribute_only", "reject", "pass"), "CAST(NULL AS STRING)"),
    "suspected": pick("doc_id", "true", "false", "false", "CAST(NULL AS BOOLEAN)", "false"), "status": pick("doc_id * 5", *text("complete", "sparse", "sparse_suspicious", "inconclusive", "complete", "complete", "sparse")),
    "n_verified": "CAST(doc_id * 7 % 24 AS INT)", "confidence": pick("doc_id", *text("medium", "low", "medium")), "semantic_risk": "(doc_id * 19 % 90) / 1e2", "n_high_risk": "CAST(doc_id % 11 % 3 AS INT)", "coordinated": "doc_id % 17 = 0", "is_ugc": "doc_id % 9 = 0",
}


def domain_risk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiers.list_tiers(_docs(spark, sf_dir, TIERED))
    out = tiers.domain_tiers(rows.select("query", "url", "tier", "mechanisms"))
    return out.select("domain", "tier", "n_queries", F.array_join("mechanisms", ",").alias("mechanisms"), F.array_join("urls", " ").alias("urls"))


CLAIMED = {
    "product": pick("doc_id", *text("", "Steam Kettle", "Acme", "the best", "Best Kettles Guide", "")), "brand": pick("doc_id * 3", *text("Acme", "Theo Grace", "", "Review", "Bolt")),
    "site_name": pick("doc_id", *text("Acme", "", "Tea Blog")), "organization": pick("doc_id", *text("", "Bolt", "theo grace", "")), "domain": pick("doc_id", *text("acme.com", "teablog.org", "theograce.com", "x.io")),
    "role": pick("doc_id", *text("ugc_thread", "factual_blog", "commercial_product", "editorial", "ugc_thread")),
}


def claim_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, CLAIMED).withColumn("scope", F.floor(F.col("doc_id") / 3)).withColumn("ord", F.col("doc_id"))
    roles = rows.groupBy("scope").agg(F.collect_set("role").alias("roles"))
    named = roles.join(claims.brands(rows), "scope", "left")
    intent = F.element_at(F.array(*map(F.lit, ("informational", "commercial", "navigational", "informational_high_stakes"))), (F.col("scope") % 4 + 1).cast("int"))
    topic, shared = F.when(F.col("scope") % 3 != 0, F.lit("kettle choice")), F.when(F.col("scope") % 2 == 0, F.lit("Shared Name"))
    return named.select("scope", "brand", claims.resolved_claim(intent, topic, F.col("brand"), shared, F.col("roles")).alias("claim"))


def target_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet.sheet(spark, sf_dir).groupBy("query_id").agg(F.collect_list("url").alias("cited_urls"))  # eight a query
    found = audit.for_target(rows, "acme").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("cited_urls")).cast("long").alias("n_urls"))
    return audit.referral_audit(rows, "acme").crossJoin(found)  # one row each


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: a user's question, every fourth one a paraphrase of the next user's."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("query"), F.when(F.col("user_id") % 4 == 0, (F.col("user_id") + 1).cast("string")).alias("paraphrase_of"), F.col("event_id").alias("ord"), "ts", F.array("event_type").alias("cited_domains"))
    scored = sheet.sheet(spark, sf_dir).select("url", F.col("rhetorical").alias("retrieval_risk"), "commercial_tier").groupBy("url").agg(F.min("retrieval_risk").alias("retrieval_risk"), F.min("commercial_tier").alias("commercial_tier"))
    return audit.summary(log, scored)


QUERIES = {f.__name__: f for f in (
    label_comparisons, label_disagreements, label_knobs, sheet_checks, blank_sheet, sheet_matches, entity_choices, latest_and_missing, cited_impressions, rewrite_gains, method_leaderboard, attack_rewrites, attack_outcome,
    domain_risk_list, claim_entities, target_citations, audit_summary,
)}

_V = {c.replace("anti", "anti_"): e.replace("STRING", "VARCHAR") for c, e in SIDES.items()}
_q = lambda s: s.replace("'", "''")
_RANK = lambda c: "CASE field " + " ".join(f"WHEN '{f}' THEN list_position([{', '.join(repr(v) for v in own if v != 'defer')}], {c})" for f, own in labels.LEVELS.items()) + " END"
_SIZE = "CASE field " + " ".join(f"WHEN '{f}' THEN {len([v for v in own if v != 'defer'])}" for f, own in labels.LEVELS.items()) + " END"
_PAIRS = f"""{_as_cte("s", _V)}, pairs AS (SELECT comparison, field, gold, pred FROM ({" UNION ALL ".join(f"SELECT '{n}' AS comparison, field, {g} AS gold, {p.replace('anti', 'anti_')} AS pred, '{p}' = 'anti' AS predicted, parasitic_source FROM s" for n, (g, p) in labels.COMPARISONS.items())})
    WHERE gold IS NOT NULL AND pred IS NOT NULL AND NOT (field = 'parasitic' AND predicted AND parasitic_source IS NULL) AND NOT (field = 'retrieve_permission' AND (gold = 'defer' OR pred = 'defer'))),
  r AS (SELECT comparison, field, {_RANK("gold")} AS g, {_RANK("pred")} AS p, {_SIZE} AS k FROM pairs), t AS (SELECT comparison, field, count(*) AS n, count(*) FILTER (g = p) AS ok, count(*) FILTER (abs(g - p) = 1) AS near, sum((g - p) * (g - p) / ((k - 1) * (k - 1))) AS seen FROM r GROUP BY ALL),
  gm AS (SELECT comparison, field, k, g AS c, count(*) AS ng FROM r GROUP BY ALL), pm AS (SELECT comparison, field, p AS c, count(*) AS np FROM r GROUP BY ALL), both_ AS (SELECT comparison, field, g AS c, count(*) AS tp FROM r WHERE g = p GROUP BY ALL),
  f AS (SELECT comparison, field, avg(2 * coalesce(tp, 0) / (coalesce(ng, 0) + coalesce(np, 0))) AS f1 FROM (SELECT comparison, field, c, ng FROM gm) FULL JOIN pm USING (comparison, field, c) LEFT JOIN both_ USING (comparison, field, c) GROUP BY ALL),
  e AS (SELECT comparison, field, sum((gm.c - pm.c) * (gm.c - pm.c) / ((k - 1) * (k - 1)) * ng * np) AS raw FROM gm JOIN pm USING (comparison, field) GROUP BY ALL),
  m AS (SELECT comparison, field, n, round(ok / n, 9) AS accuracy, round(f1, 9) AS macro_f1, round(CASE WHEN raw = 0 THEN CASE WHEN seen = 0 THEN 1 END ELSE 1 - seen / (raw / n) END, 9) AS kappa, round(near / n, 9) AS off_by_one FROM t JOIN f USING (comparison, field) JOIN e USING (comparison, field))"""
_ENTITY = f"""SELECT 'https://t.org/' || doc_id % 17 AS target, 'https://r.org/' || doc_id % 5 AS referrer, 'e' || doc_id % 9 AS entity, {pick("doc_id * 7", *text(*labels.BUCKETS))} AS bucket, doc_id % 2 = 0 AS present, doc_id FROM documents"""
_CITED = f"""p AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x) <> '') AS s FROM a),
  u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x, unnest(range(len(s))) AS i FROM p), c AS (SELECT doc_id, n, i, len(regexp_extract_all(x, '\\w{{3,}}')) AS w, regexp_extract_all(x, '\\[(\\d+)\\]', 1) AS cites FROM u),
  d AS (SELECT doc_id, CASE WHEN n > 1 THEN exp(-i / (n - 1)) ELSE 1 END AS decay, w, len(cites) AS k, unnest(cites)::INT AS source FROM c WHERE len(cites) > 0),
  z AS (SELECT doc_id, source, sum(w / k) AS a1, sum(decay / k) AS a2, sum(w * decay / k) AS a3 FROM d WHERE source BETWEEN 1 AND 5 GROUP BY ALL), slots AS (SELECT doc_id, r.s AS source FROM a, range(1, 6) r(s))"""
_CITES = f"""{_as_cte("a", {c: e.replace("STRING", "VARCHAR") for c, e in CITED.items()})}, {_CITED}"""
_share = lambda c: f"round(coalesce(coalesce({c}, 0) / nullif(sum({c}) OVER (PARTITION BY doc_id), 0), 0.2), 9)"
_T = {c: e.replace("STRING", "VARCHAR") for c, e in TIERED.items()}
_TIER = doubles(f"""{_as_cte("t0", _T)}, t1 AS (SELECT *, coalesce(suspected, false) OR n_high_risk >= 2 OR coordinated AS referred, coalesce(llm_action IN ({", ".join(repr(a) for a in C.HARD_ACTIONS)}), false) AND NOT referred AS ph,
    NOT ph AND (coalesce(llm_action IN ({", ".join(repr(a) for a in C.SOFT_ACTIONS)}), false) OR semantic_risk >= 0.35) AS ps, NOT referred AND (status = 'sparse_suspicious' OR n_high_risk = 1) AS rs,
    NOT is_ugc AND n_verified >= 10 AND status IN ('complete', 'sparse') AND confidence <> 'low' AS strong, is_ugc OR status IN ('inconclusive', 'sparse_suspicious') OR n_verified < 5 OR (suspected IS NULL AND status IN ('complete', 'sparse')) AS weak,
    CASE WHEN ph AND referred AND strong AND NOT weak THEN 1 WHEN (ph OR referred) AND strong AND NOT weak THEN 2 WHEN ph OR referred THEN 3 WHEN (ps OR rs) AND strong THEN 3 WHEN ps OR rs OR is_ugc OR weak THEN 4 WHEN llm_action IS NULL OR llm_action = 'pass' THEN 5 ELSE 4 END AS rank FROM t0),
  d AS (SELECT {role_sql.domain(role_sql.AUTHORITY)} AS domain, min(rank) AS rank, count(DISTINCT query) AS nq, bool_or(ph OR ps) AS onp, bool_or(referred OR rs) AS ref, list_sort(list(DISTINCT url))[1:8] AS urls FROM t1 GROUP BY 1)""")
_STOP = ", ".join(f"'{w}'" for w in C.NAME_STOPWORDS)
_CLAIM = f"""{_as_cte("c0", CLAIMED)}, c1 AS (SELECT doc_id // 3 AS scope, doc_id, unnest([product, brand]) AS name, unnest([0, 1]) AS k, site_name, organization, domain FROM c0),
  c2 AS (SELECT *, string_split_regex(lower(name), '\\s+') AS w, list_filter(w, lambda x: x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '\\d+')) AS own, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS bare FROM c1 WHERE name <> ''),
  c3 AS (SELECT * FROM c2 WHERE length(name) >= 4 AND w[1] NOT IN ({", ".join(f"'{x}'" for x in C.INTERROGATIVES)}) AND w[-1] NOT IN ({", ".join(f"'{x}'" for x in C.DANGLING)}) AND len(own) > 0 AND (len(w) < 2 OR len(own) * 2 > len(w)) AND lower(name) NOT IN ({", ".join(f"'{x}'" for x in C.WEAK_MARKERS)})
    AND NOT (length(site_name) >= 3 AND bare = regexp_replace(lower(site_name), '[^a-z0-9]', '', 'g')) AND NOT (length(organization) >= 3 AND bare = regexp_replace(lower(organization), '[^a-z0-9]', '', 'g')) AND bare <> regexp_replace(domain, '[^a-z0-9]', '', 'g') AND NOT (length(string_split(domain, '.')[1]) >= 3 AND bare = string_split(domain, '.')[1])),
  b AS (SELECT scope, arg_min(name, doc_id * 2 + k) AS brand FROM c3 GROUP BY scope), g AS (SELECT doc_id // 3 AS scope, bool_or(role IN ('commercial_product', 'review_profile', 'expert_listicle')) AS com, bool_and(role = 'ugc_thread') AS ugc FROM c0 GROUP BY 1),
  h AS (SELECT scope, brand, com, ugc, ['informational', 'commercial', 'navigational', 'informational_high_stakes'][scope % 4 + 1] AS intent, CASE WHEN scope % 3 <> 0 THEN 'kettle choice' END AS topic, CASE WHEN scope % 2 = 0 THEN 'Shared Name' END AS shared FROM g LEFT JOIN b USING (scope))"""
_sql_rewrite = lambda f: "||".join(part for part in ("'" + _q(f.replace("%%", "%")) + "'").replace("%1$s", "' || text || '").replace("%2$s", "' || query || '").split("||"))

ORACLE_SQL = {
    "label_comparisons": f"WITH {_PAIRS} SELECT * FROM m",
    "label_disagreements": f"""WITH {_as_cte("s", _V)} SELECT doc_id AS id, field, adjudicated AS gold, anti_ AS pred, row_number() OVER (ORDER BY field NOT IN ('factual_permission', 'parasitic'), field, doc_id) AS place FROM s WHERE adjudicated <> anti_ AND NOT (field = 'retrieve_permission' AND (adjudicated = 'defer' OR anti_ = 'defer'))""",
    "label_knobs": f"""WITH {_PAIRS} SELECT field, macro_f1, CASE field WHEN 'retrieve_permission' THEN 2e-1 WHEN 'factual_permission' THEN 65e-2 WHEN 'endorsement_permission' THEN 3e-1 WHEN 'mention_permission' THEN 95e-2 END AS bar,
      CASE WHEN field = 'mention_permission' THEN 'monitor_only' WHEN field = 'parasitic' THEN 'unknown' WHEN macro_f1 >= CASE field WHEN 'retrieve_permission' THEN 2e-1 WHEN 'factual_permission' THEN 65e-2 ELSE 3e-1 END THEN 'freeze' ELSE 'active' END AS action FROM m WHERE comparison = 'anti_vs_adjudicated'""",
    "sheet_checks": f"""WITH {_as_cte("w", {f: pick(f"doc_id * {k + 2}", *text(*v), "'bad'", "NULL") for k, (f, v) in enumerate(labels.LEVELS.items())})} SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT coalesce({f} IN ({', '.join(repr(x) for x in v)}), false) THEN '{f}' END" for f, v in labels.LEVELS.items())}], lambda x: x IS NOT NULL), ',') AS invalid,
      array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'predictions' END, CASE WHEN doc_id % 4 = 0 THEN 'llm_action' END], lambda x: x IS NOT NULL), ',') AS leaks, CASE WHEN doc_id % 5 = 0 THEN 'suspected' WHEN doc_id % 4 = 0 OR doc_id % 7 = 0 THEN 'elevated' ELSE 'none' END AS tier FROM w""",
    "blank_sheet": f"""WITH {sheet.SQL}, r AS (SELECT *, row_number() OVER (ORDER BY query_id, doc_id) AS n FROM sheet) SELECT 'v1p' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS id, 'q' || query_id AS query, url, regexp_replace(host, '^www[.]', '') AS domain FROM r""",
    "sheet_matches": f"""WITH {sheet.SQL}, a AS (SELECT doc_id, query_id, rank, CASE WHEN doc_id % 3 = 0 THEN lower(rtrim(url, '/')) ELSE lower(url || '?x=A') END AS key FROM sheet),
      r AS (SELECT query_id, rank, doc_id AS value, unnest([CASE WHEN doc_id % 2 = 0 THEN lower(rtrim(url, '/')) ELSE 'https://z.org' END, lower(url || '?x=A')]) AS key FROM sheet WHERE doc_id % 5 <> 0), u AS (SELECT query_id, key, arg_min(value, rank) AS v FROM r GROUP BY ALL)
      SELECT a.doc_id AS id, coalesce(u.v, CASE WHEN a.doc_id % 5 <> 0 THEN a.doc_id END) AS value, CASE WHEN u.v IS NOT NULL THEN 'url' WHEN a.doc_id % 5 <> 0 THEN 'position' END AS matched_by FROM a LEFT JOIN u USING (query_id, key)""",
    "entity_choices": f"""WITH e AS ({_ENTITY}), k AS (SELECT *, row_number() OVER (PARTITION BY target, referrer ORDER BY list_position([{", ".join(repr(b) for b in labels.BUCKETS)}], bucket), NOT present, doc_id) AS k FROM e) SELECT target, referrer, entity, bucket FROM k WHERE k = 1""",
    "latest_and_missing": "WITH l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) SELECT * FROM l WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)",
    "cited_impressions": f"WITH {_CITES} SELECT doc_id AS answer_id, source, {_share('a1')} AS by_words, {_share('a2')} AS by_position, {_share('a3')} AS by_both FROM slots LEFT JOIN z USING (doc_id, source)",
    "answer_impressions": f"WITH a AS (SELECT conv_id * 100000 + turn AS doc_id, coalesce(text, '') AS answer FROM conversations WHERE role = 'assistant'), {_CITED} SELECT doc_id AS answer_id, source, {_share('a1')} AS by_words, {_share('a2')} AS by_position, {_share('a3')} AS by_both FROM slots LEFT JOIN z USING (doc_id, source)",
    "rewrite_gains": f"""WITH {_as_cte("r", {"query_id": "doc_id % 8", "method": pick("doc_id", "NULL", "'quotes'", "'stats'"), "source": "doc_id % 5", "score": "(doc_id * 17 % 50) / 1e2", "idx": "(doc_id % 8) % 5"})}, m AS (SELECT query_id, method, source, avg(score) AS a, max(idx) AS idx FROM r GROUP BY ALL),
      g AS (SELECT m.query_id, m.method, m.source, m.idx, m.a - b.a AS gain FROM m JOIN m b ON b.query_id = m.query_id AND b.source = m.source AND b.method IS NULL WHERE m.method IS NOT NULL)
      SELECT query_id, method, source, round(gain, 9) AS gain, coalesce(max(CASE WHEN source = idx THEN gain > 0 END) OVER (PARTITION BY query_id, method), false) AS wins FROM g""",
    "method_leaderboard": f"""WITH {_as_cte("r", {"method": pick("doc_id", *text("quotes", "stats", "none")), "simple": "(doc_id * 17 % 64) / 64e0", "subjective": "(doc_id * 5 % 32) / 32e0"})} SELECT method, round(avg(simple) * 100, 1) AS simple, round(avg(subjective) * 100, 1) AS subjective FROM r GROUP BY method""",
    "attack_rewrites": f"WITH {sheet.SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS method, {_sql_rewrite(f)} AS rewritten FROM sheet" for n, f in rewrites.FORMATS.items()),
    "attack_outcome": f"""WITH {_as_cte("r", {"suite": pick("doc_id", *text("attack", "false_positive")), "method": pick("doc_id * 5", *text(*rewrites.FORMATS)), "b": "doc_id % 64", "d": "doc_id % 32", "br": "doc_id % 5 + 1", "dr": pick("doc_id", "1", "3", "NULL", "5")})}
      SELECT suite, method, count(*) AS n_cases, round(avg(b), 6) AS baseline_share, round(avg(d), 6) AS defended_share, count(*) FILTER (dr IS NULL OR dr > br) AS n_lowered FROM r GROUP BY ALL""",
    "domain_risk_list": f"WITH {_TIER} SELECT domain, ['very_high', 'high', 'medium', 'review', 'clean'][CASE WHEN nq < 2 THEN greatest(rank, 3) ELSE rank END] AS tier, nq AS n_queries, array_to_string(list_filter([CASE WHEN onp THEN 'on_page' END, CASE WHEN ref THEN 'referrer' END], lambda x: x IS NOT NULL), ',') AS mechanisms, array_to_string(urls, ' ') AS urls FROM d",
    "claim_entities": f"""WITH {_CLAIM} SELECT scope, brand, CASE WHEN intent = 'commercial' AND NOT ugc AND brand IS NOT NULL AND com THEN brand WHEN intent = 'commercial' THEN coalesce(topic, brand, shared) WHEN intent LIKE 'informational%' AND com AND brand IS NOT NULL THEN brand
      WHEN intent = 'navigational' THEN coalesce(brand, topic, shared) ELSE coalesce(topic, brand, shared) END AS claim FROM h""",
    "target_citations": f"""WITH {sheet.SQL}, u AS (SELECT *, contains({role_sql.domain(role_sql.AUTHORITY)}, 'acme') OR contains(lower(url), 'acme') AS hit FROM sheet) SELECT count(DISTINCT url) AS citations_sampled, count(DISTINCT url) FILTER (hit) AS citations_to_target, count(DISTINCT query_id) FILTER (hit) AS n_records, count(*) FILTER (hit) AS n_urls FROM u""",
    "audit_summary": f"""WITH {sheet.SQL}, l AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN user_id + 1 END AS p, event_id, CAST(ts AS DATE) AS day, event_type AS d FROM events),
      a AS (SELECT user_id AS o, arg_max(d, event_id) AS d FROM l WHERE p IS NULL GROUP BY 1), b AS (SELECT p AS o, arg_max(d, event_id) AS d FROM l WHERE p IS NOT NULL GROUP BY 1), x AS (SELECT a.d <> b.d AS c FROM a JOIN b USING (o)),
      dd AS (SELECT DISTINCT user_id AS q, day, d AS domain FROM l), st AS (SELECT * FROM (SELECT day AS now, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM dd)) WHERE date_diff('day', before, now) <= 7), ak AS (SELECT DISTINCT q, day AS now FROM dd),
      pp AS (SELECT dd.q, dd.domain, st.now FROM dd JOIN st ON dd.day = st.before JOIN ak ON ak.q = dd.q AND ak.now = st.now), y AS (SELECT count(dd.q) AS h, count(*) AS n FROM pp LEFT JOIN dd ON dd.q = pp.q AND dd.day = pp.now AND dd.domain = pp.domain), z AS (SELECT url, min(rhetorical) AS r, min(commercial_tier) AS t FROM sheet GROUP BY url)
      SELECT (SELECT count(DISTINCT user_id) FROM l) AS n_queries, (SELECT round(coalesce(avg(c::INT), 0), 9) FROM x) AS mean_distance, (SELECT round(coalesce(avg(c::INT) * 100, 0), 9) FROM x) AS pct_changed, (SELECT round(h / nullif(n, 0), 9) FROM y) AS persistence,
      (SELECT round(avg((r >= 55e-2)::INT), 9) FROM z) AS geo_risk_share, (SELECT round(avg((t = 'high')::INT), 9) FROM z) AS commercial_high_share""",
}
