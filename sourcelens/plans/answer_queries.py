"""Whole runs of queries over their candidates: benchmark items ask, documents are pages, first retrieval picks candidates.

A page is a document's text behind one phrase of the sheet, so that rules on English wording meet the driver's texts as
well as words they know; its address and facts are the sheet's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.operators import answers, pruned, retrieval, rewrites, similarity
from sourcelens.plans import decision_queries, referral_queries
from sourcelens.plans.decision_queries import doubles, has
from sourcelens.plans.sheet import QUERY, SOURCE
from sourcelens.sources.tables import benchmark_queries, table

CANDIDATES, PLACES = 10, 5
FACTS = ["host", "path", "ok", "status_code", "fetch_engine", "whois_age_days", "commercial_score", "commercial_tier", "list_items", "concealment_risk", "concealed", "context", "segment", "body"]
ASKED = {
    "query": f"{QUERY['query']} || ' ' || coalesce(text, '')",
    "intent": QUERY["intent"],
    "claim": "CASE WHEN query_id % 3 = 0 THEN 'Acme Kettle' END",
}
URL = "'https://' || host || path || '?n=' || doc_id"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_queries(spark, sf_dir).selectExpr("query_id", *(f"{e} AS {c}" for c, e in ASKED.items()))


def pages(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """Documents with a wanted doc_id as pages: doc_id, url, text and facts."""
    rows = table(spark, sf_dir, "documents").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").selectExpr("doc_id", "text AS own", *(f"{SOURCE[c]} AS {c}" for c in FACTS))
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = rows.withColumns({"url": F.expr(URL), "text": F.expr("body || ' ' || coalesce(own, '')"), "concealment_flags": listed("concealed"), "context_flags": listed("context")})
    return rows.drop("own", "host", "path", "concealed", "context", "body")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id of the documents that a first retrieval over all of them gives."""
    best, _ = pruned.top(table(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir), CANDIDATES)
    return similarity.written(best.select("query_id", "doc_id"), "candidates")


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.select("url", "segment", F.explode(T.chunks(F.col("text"))).alias("c")).select("url", "segment", F.col("c.chunk_id").alias("chunk_id"), F.col("c.text").alias("text"))


def run(spark: SparkSession, sf_dir: str) -> answers.Analysis:
    wanted = _candidates(spark, sf_dir)
    own = similarity.written(pages(spark, sf_dir, wanted), "pages")
    return answers.investigate(spark, _asked(spark, sf_dir), wanted.join(own.select("doc_id", "url"), "doc_id").select("query_id", "url"), own.drop("segment"), _chunks(own), PLACES)


def scoped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the passages of its own candidates, which are its corpus."""
    wanted = _candidates(spark, sf_dir)
    passages = table(spark, sf_dir, "documents").join(wanted.select("doc_id").distinct(), "doc_id").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c"))
    texts = passages.select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "c.chunk_id").alias("ident"), F.col("c.text").alias("text"), F.col("doc_id").alias("page"))
    asked = wanted.join(texts.select("page", "ident"), wanted["doc_id"] == F.col("page")).select("query_id", F.col("ident").alias("doc_id"))
    out = retrieval.scoped_scores(benchmark_queries(spark, sf_dir), asked, texts.select(F.col("ident").alias("doc_id"), "text"))
    return out.select("query_id", F.col("doc_id").alias("passage"), F.round("score", 6).alias("score"))


def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate page as its query sees it."""
    rows = run(spark, sf_dir).sources
    return rows.select("query_id", "url", "n_words", F.round("front_load", 9).alias("front_load"), F.round("quotes", 9).alias("quotes"), F.array_join("flags", ",").alias("flags"), F.round("trust", 9).alias("trust"), "role", *answers.PERMISSIONS, "recommended_action")


def defended_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that have a place before or after the defence, with both places and why they lost one."""
    out = answers.changes(run(spark, sf_dir))
    return out.select("query_id", F.col("doc_id").alias("passage"), "baseline_rank", "defended_rank", F.round("score", 6).alias("score"), F.round("defended", 6).alias("defended"), "status", F.array_join("reasons", ",").alias("reasons"))


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: independence of its sources, consensus, and what dominates before and after the defence."""
    out = run(spark, sf_dir).context
    return out.select("query_id", "n_texts", "n_clusters", F.round("max_similarity", 3).alias("max_similarity"), "coordinated", F.array_join("reasons", ",").alias("reasons"), "consensus", F.round("dominance", 9).alias("dominance"), "claim", "baseline_dominance", "defended_dominance", "n_support", "corroborated")


def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the guard's verdict over its defended passages, and how many disclosures the answer carries."""
    done = run(spark, sf_dir)
    shown = done.disclosures.select("query_id", F.size("urls").cast("long").alias("n_disclosures"))
    return done.verdicts.join(shown, "query_id", "left").select("query_id", "kind", "passed", "action", "response_mode", "entity", "lead_url", F.coalesce("n_disclosures", F.lit(0).cast("long")).alias("n_disclosures"))


def attack_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item a case whose target is its third candidate, under every rewrite."""
    wanted = _candidates(spark, sf_dir)
    own = similarity.written(pages(spark, sf_dir, wanted), "pages")
    urls = wanted.join(own.select("doc_id", "url"), "doc_id").select(F.col("query_id").alias("case_id"), "doc_id", "url")
    third = urls.groupBy("case_id").agg(F.get(F.array_sort(F.collect_list(F.struct("doc_id", "url"))), F.lit(2))["url"].alias("target")).where("target is not null")  # ten at most
    cases = _asked(spark, sf_dir).withColumnRenamed("query_id", "case_id").join(third, "case_id").withColumn("suite", F.expr("CASE WHEN case_id % 2 = 0 THEN 'attack' ELSE 'false_positive' END"))
    out = rewrites.attacked(spark, cases, urls.select("case_id", "url"), own.drop("segment", "doc_id"), _chunks(own), k=PLACES)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(F.col("case_id").cast("long").alias("case_id"), "suite", "method", "target", r("trust"), r("semantic_risk"), r("endorsement_risk"), "recommended_action", *answers.PERMISSIONS, "baseline_rank", r("baseline_share"), "defended_rank", r("defended_share"), "guard_action")


QUERIES = {f.__name__: f for f in (scoped_scores, candidate_sources, defended_ranking, answer_context, answer_verdicts, attack_grid)}


# --- the same in SQL ---------------------------------------------------------------------------------------------

_q = lambda p: p.replace("'", "''")
_m = lambda column, p: f"regexp_matches({column}, '{_q(p)}')"
_hits = lambda t, patterns: " + ".join(f"len(regexp_extract_all({t}, '{_q(p)}'))" for p in patterns)
_density = lambda patterns: f"least(1.0, ({_hits('p', patterns)}) / greatest(n_words, 1) * 8)"
_words = lambda t: f"list_filter(string_split_regex({t}, '{_q(T.SPACE)}'), lambda x: x <> '')"
_plain = lambda t: f"regexp_replace(lower({t}), '{T.FOREIGN}', 'q', 'g')"


def _signals(name: str, rows: str) -> str:
    """CTEs that end in one called name: rows (with text and query) with the signals of a text that answers a query."""
    terms = f"list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in C.QUERY_STOPWORDS)}))"
    seen = lambda where: f"len(list_filter(terms, lambda x: contains({where}, x)))"
    flags = [
        (f"authority > {C.AUTHORITY_FLAG}", "authority_stacking"), (f"comparative > {C.COMPARATIVE_FLAG}", "comparative_superlatives"), (_m("p", C.MEDICAL_CLAIM), "high_stakes_medical_claim"), (f"hedges > {C.HEDGING_FLAG}", "balanced_hedging"),
        ("front_load > 0.65", "front_loaded"), (f"quotes > {C.QUOTES_FLAG}", "quote_citation_heavy"), (_m("p", C.ALTERNATIVES), "mentions_alternatives"),
        (f"n_words >= {C.PLANT_LEAST_WORDS} AND NOT ({_m('p', C.ENDORSES)} OR {_m('p', C.ALTERNATIVES)} OR {_m('p', C.REVIEW_FRAME)}) AND {_m('p', C.NARRATIVE)} AND {_m('p', C.CONSUMER)} AND {_m('p', C.BRAND_PLACED)}", "planted_mention"),
    ]
    told = ", ".join(f"CASE WHEN {test} THEN '{flag}' END" for test, flag in flags)
    return doubles(f"""{name}1 AS (SELECT *, {_words("lower(text)")} AS w, {_plain("text")} AS p, regexp_replace(text, '{T.FOREIGN}', 'q', 'g') AS kept, {terms} AS terms FROM {rows}),
  {name}2 AS (SELECT * EXCLUDE (w), len({_words("text")}) AS n_words, array_to_string(w[1:200], ' ') AS head, array_to_string(w[201:], ' ') AS tail FROM {name}1),
  {name}3 AS (SELECT *, {_density(C.AUTHORITY)} AS authority, {_density(C.COMPARATIVE)} AS comparative, {_density(C.TEMPORAL)} AS temporal, {_density(C.PURPOSE)} AS purpose, {_density(C.HEDGES)} AS hedges,
    least(1.0, ({_hits("kept", C.QUOTES)}) / greatest(n_words, 1) * 10) AS quotes, {seen("head")} AS sh, {seen("tail")} AS st FROM {name}2),
  {name}4 AS (SELECT *, CASE WHEN n_words < 40 OR sh + st = 0 THEN 0.0 ELSE sh / (sh + st) END AS front_load, least(1.0, (authority + comparative + purpose) / 2) AS narrative,
    greatest(0.0, 0.3 * authority + 0.3 * narrative + 0.25 * comparative + 0.15 * temporal - 0.35 * hedges) AS raw FROM {name}3),
  {name} AS (SELECT * EXCLUDE (p, kept, head, tail, terms, sh, st), least(1.0, raw) AS rhetorical, CASE WHEN front_load > 0.6 AND raw > 0 THEN least(1.0, raw * (1 + 0.25 * front_load)) ELSE raw END AS semantic_risk,
    CASE WHEN n_words = 0 THEN 'empty_content' ELSE array_to_string(list_filter([{told}], lambda x: x IS NOT NULL), ',') END AS marks FROM {name}4)""")


_TFIDF_ALL = """terms AS (SELECT doc_id, term, ln(count(*)) + 1 AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM terms GROUP BY term), nn AS (SELECT count(*) + 1 AS n FROM documents),
  wt AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w0, tf * (ln((1 + n) / (2 + df)) + 1) AS w1 FROM terms JOIN df USING (term), nn),
  norms AS (SELECT doc_id, sum(w0 * w0) AS norm2 FROM wt GROUP BY doc_id),
  qq AS (SELECT query_id, term, (ln(c) + 1) * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS qw FROM (SELECT query_id, term, count(*) AS c FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY query_id, term) LEFT JOIN df USING (term), nn),
  qn AS (SELECT query_id, sum(qw * qw) AS qnorm2 FROM qq GROUP BY query_id),
  met AS (SELECT query_id, doc_id, sum(w1 * qw) AS dot, sum(w1 * w1 - w0 * w0) AS more FROM wt JOIN qq USING (term) GROUP BY query_id, doc_id),
  wanted AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, round(dot / sqrt((norm2 + more) * qnorm2), 9) AS score FROM met JOIN norms USING (doc_id) JOIN qn USING (query_id))) WHERE r <= 10)"""


def _cut(rows: str, keys: str) -> str:
    """CTEs that end in pieces: keys, chunk_id and text of the chunks of rows' texts."""
    return f"""c1 AS (SELECT {keys}, text, list_transform(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS every FROM {rows} WHERE text IS NOT NULL),
  c2 AS (SELECT {keys}, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare, list_filter(every, lambda x: len({_words("x")}) >= 30) AS own FROM c1),
  c3 AS (SELECT {keys}, CASE WHEN len(own) > 0 THEN own WHEN length(bare) > 0 THEN [bare] ELSE []::VARCHAR[] END AS parts FROM c2),
  c4 AS (SELECT {keys}, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM c3),
  pieces AS (SELECT {keys}, 'p' || i AS chunk_id, part AS text FROM c4 WHERE len({_words("part")}) <= 400
    UNION ALL SELECT {keys}, 'p' || i || '_' || j, array_to_string({_words("part")}[j * 400 + 1:j * 400 + 400], ' ') FROM (SELECT *, unnest(range(cast(ceil(len({_words("part")}) / 400) AS BIGINT))) AS j FROM c4 WHERE len({_words("part")}) > 400))"""


def _scoped(asked: str) -> str:
    """CTEs that end in scoped: (query_id, ident, score). asked: query_id, text; cand: query_id, ident; told: ident, text."""
    return f"""s1 AS (SELECT query_id, ident, term, ln(count(*)) + 1 AS tf FROM (SELECT query_id, ident, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM cand JOIN told USING (ident)) GROUP BY ALL),
  s2 AS (SELECT query_id, term, ln(count(*)) + 1 AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {asked}) GROUP BY ALL),
  s3 AS (SELECT query_id, count(*) + 1 AS n FROM cand GROUP BY query_id),
  s4 AS (SELECT query_id, term, ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0) + (qtf IS NOT NULL)::INT)) + 1 AS idf, qtf FROM (SELECT query_id, term, count(*) AS df FROM s1 GROUP BY ALL) FULL JOIN s2 USING (query_id, term) JOIN s3 USING (query_id)),
  s5 AS (SELECT query_id, sum((qtf * idf) ** 2) AS q2 FROM s4 GROUP BY query_id),
  s6 AS (SELECT query_id, ident, sum(tf * idf * qtf * idf) AS dot, sum((tf * idf) ** 2) AS n2 FROM s1 JOIN s4 USING (query_id, term) GROUP BY ALL),
  scoped AS (SELECT query_id, ident, round(coalesce(dot / nullif(sqrt(n2 * q2), 0), 0), 9) AS score FROM cand LEFT JOIN s6 USING (query_id, ident) LEFT JOIN s5 USING (query_id))"""


_PAGES = f"""page AS (SELECT doc_id, {URL} AS url, text, {", ".join(f for f in FACTS if f != "body")} FROM (SELECT doc_id, {SOURCE["body"]} || ' ' || coalesce(text, '') AS text, {", ".join(f"{SOURCE[c]} AS {c}" for c in FACTS if c != "body")} FROM documents WHERE doc_id IN (SELECT doc_id FROM wanted))),
  asked AS (SELECT query_id, {", ".join(f"{e} AS {c}" for c, e in ASKED.items())} FROM (SELECT item_id AS query_id, text FROM benchmark)),
  pair AS (SELECT query_id, query, intent, claim, page.* FROM wanted JOIN page USING (doc_id) JOIN asked USING (query_id))"""
_NEWS = "(" + " OR ".join(f"regexp_replace(host, '^www[.]', '') = '{h}' OR host LIKE '%.{h}'" for h in C.NEWS_HOSTS) + ")"
_TRUST = doubles(f"""greatest(0.0, least(1.0, 0.55 + CASE WHEN ok THEN 0.0 ELSE -0.35 END + CASE WHEN {_m("host", C.SUSPICIOUS_TLD)} THEN -0.08 ELSE 0.0 END + CASE WHEN len(string_split(regexp_replace(host, '^www[.]', ''), '.')) >= 4 AND NOT regexp_matches(host, '[.](gov|edu)$') THEN -0.05 ELSE 0.0 END
    + CASE WHEN whois_age_days < 90 THEN -0.20 WHEN whois_age_days > 1095 THEN 0.10 ELSE 0.0 END + CASE WHEN ok AND regexp_matches(host, '[.](gov|edu)$') THEN 0.10 ELSE 0.0 END + CASE WHEN ok AND {_NEWS} THEN 0.10 ELSE 0.0 END
    + CASE WHEN n_words < 80 THEN -0.10 ELSE 0.0 END + CASE WHEN {has("marks", "balanced_hedging")} THEN 0.08 ELSE 0.0 END + CASE WHEN commercial_score > 0.5 THEN -0.04 ELSE 0.0 END))""")
#: Sources judged: the sheet's ladders over rows made of pages.
_SEEN = f"""{_signals("src", "pair")},
  judged AS (WITH sheet AS (SELECT * EXCLUDE (query, text), query AS asked_query, text AS page_text, {_plain("query")} AS query, {_plain("substr(text, 1, 500)")} AS text, {_TRUST} AS trust, 'healthy' AS consensus, 0e0 AS dominance FROM src),
    {decision_queries._TESTS}, {decision_queries._SCORES}, {decision_queries._PERMITTED}, {decision_queries._ACTED} SELECT * FROM acted)"""
_JUDGED = f"{_TFIDF_ALL}, {_PAGES}, {_SEEN}"
_SCOPED = f"""{_cut("page", "url, segment")}, told AS (SELECT *, url || '|' || chunk_id AS ident FROM pieces),
  cand AS (SELECT DISTINCT query_id, ident FROM pair JOIN told USING (url)), {_scoped("(SELECT query_id, query AS text FROM asked)")},
  passage AS (SELECT query_id, query, ident, told.url, told.segment, told.text FROM (SELECT DISTINCT query_id, query, url FROM pair) JOIN told USING (url)), {_signals("pas", "passage")}"""
_RANKED = doubles(f"""rows AS (SELECT pas.query_id, pas.ident, pas.url, pas.segment, pas.text, pas.n_words AS passage_words, pas.rhetorical AS rhet, pas.front_load, pas.comparative, pas.authority, pas.marks AS own_marks, pas.semantic_risk,
    j.* EXCLUDE (query_id, url, segment, text, rhet, front_load, comparative, authority, marks, semantic_risk), scoped.score FROM pas JOIN judged j USING (query_id, url) JOIN scoped USING (query_id, ident)),
  first_k AS (SELECT query_id, ident, url, host, score, passage_words, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM rows),
  live AS (WITH acted AS (SELECT * EXCLUDE (score), score FROM rows), {referral_queries._PENALTY.replace("(doc_id * 41 % 97 + 3) / 100 AS score, ", "")} SELECT * FROM live),
  a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, defended DESC, ident) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY defended DESC, ident) > 1 AS later FROM live)),
  v AS (SELECT query_id, host, round(part * 100 / nullif(sum(part) OVER (PARTITION BY query_id), 0), 6) AS share FROM (SELECT query_id, host, sum([1.0, 0.62, 0.38, 0.22, 0.15][place] * passage_words) AS part FROM a WHERE place <= 5 GROUP BY query_id, host)),
  v1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, host) AS k FROM v WHERE share IS NOT NULL),
  bad AS (SELECT v1.query_id, v1.host FROM v1 JOIN (SELECT query_id, host, min(trust) AS low FROM judged GROUP BY ALL) USING (query_id, host) WHERE k = 1 AND share / 100 >= 0.6 AND low < 0.55),
  again AS (SELECT live.* EXCLUDE (defended), round(live.defended * CASE WHEN bad.host IS NOT NULL THEN 0.55 ELSE 1.0 END, 9) AS defended FROM live LEFT JOIN bad USING (query_id, host)),
  second_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, defended DESC, ident) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY defended DESC, ident) > 1 AS later FROM again))""")
_dominant = lambda rows: f"SELECT query_id, max_by(share, (share, -ord)) AS share FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY host) AS ord FROM (SELECT query_id, host, round(part * 100 / nullif(sum(part) OVER (PARTITION BY query_id), 0), 6) AS share FROM (SELECT query_id, host, sum([1.0::DOUBLE, 62e-2, 38e-2, 22e-2, 15e-2][rank] * passage_words) AS part FROM {rows} WHERE rank <= 5 GROUP BY query_id, host))) WHERE share IS NOT NULL GROUP BY query_id"
_CONTEXT = f"""x1 AS (SELECT query_id, url, substr(page_text, 1, 500) AS t, list_distinct(regexp_extract_all(lower(substr(page_text, 1, 500)), '[a-z0-9]+')) AS k FROM judged),
  x2 AS (SELECT a.query_id, a.url AS u, b.url AS v, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) AS sim FROM x1 a JOIN x1 b ON a.query_id = b.query_id AND a.url <> b.url WHERE len(a.k) > 0 AND len(b.k) > 0),
  x3(query_id, u, v) AS (SELECT query_id, url, url FROM x1 UNION SELECT x3.query_id, x3.u, x2.v FROM x3 JOIN x2 ON x3.query_id = x2.query_id AND x3.v = x2.u AND x2.sim >= 45e-2),
  x4 AS (SELECT query_id, count(DISTINCT low) AS parts FROM (SELECT query_id, u, min(v) AS low FROM x3 GROUP BY ALL) GROUP BY query_id),
  x5 AS (SELECT query_id, count(*) AS n_texts FROM x1 GROUP BY query_id),
  x6 AS (SELECT query_id, round(max(sim), 3) AS top FROM x2 WHERE round(sim, 9) >= 35e-2 GROUP BY query_id),
  scopes AS (SELECT query_id, n_texts, CASE WHEN n_texts >= 2 THEN parts END AS n_clusters, top AS max_similarity, parts FROM x5 JOIN x4 USING (query_id) LEFT JOIN x6 USING (query_id))"""
_ALL = f"WITH RECURSIVE {_JUDGED}, {_SCOPED}, {_RANKED}"
_list = lambda words: ", ".join(f"'{w}'" for w in words)
_INSTITUTION = "(contains(host, '.gov') OR contains(host, '.edu') OR coalesce(trust >= 75e-2 AND whois_age_days > 1825, false))"
#: The claim of each query, its corroboration, and what its context says.
_CLAIMED = f"""n1 AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(regexp_replace(substr(page_text, 1, 500), '{T.FOREIGN}', 'q', 'g'), '{C.TITLE_CASE}'))) AS name FROM judged),
  n2 AS (SELECT *, string_split_regex(lower(name), '\\s+') AS w FROM n1), n3 AS (SELECT *, len(list_filter(w, lambda x: x NOT IN ({_list(C.NAME_STOPWORDS)}) AND NOT regexp_full_match(x, '\\d+'))) AS own FROM n2),
  n4 AS (SELECT query_id, name, count(*) AS n FROM n3 WHERE length(name) >= 4 AND w[1] NOT IN ({_list(C.INTERROGATIVES)}) AND w[-1] NOT IN ({_list(C.DANGLING)}) AND own > 0 AND (len(w) < 2 OR own * 2 > len(w)) AND array_to_string(w, ' ') NOT IN ({_list(C.WEAK_MARKERS)}) GROUP BY ALL HAVING count(*) >= 2),
  n5 AS (SELECT query_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name) AS k FROM n4) WHERE k = 1),
  dom1 AS ({_dominant("first_k")}), dom2 AS ({_dominant("second_k")}),
  claimed AS (SELECT asked.query_id, intent, coalesce(claim, name) AS claim, n_texts, n_clusters, max_similarity, coalesce(parts = 1 AND n_texts >= 2 AND max_similarity >= 35e-2, false) AS coordinated, parts,
    dom1.share AS baseline_dominance, dom2.share AS defended_dominance FROM asked LEFT JOIN n5 USING (query_id) LEFT JOIN scopes USING (query_id) LEFT JOIN dom1 USING (query_id) LEFT JOIN dom2 USING (query_id)),
  context AS (SELECT *, CASE WHEN n_clusters = 1 AND n_texts >= 2 AND max_similarity >= 35e-2 THEN 'coordinated' WHEN n_clusters < 2 THEN 'shaky' ELSE 'healthy' END AS consensus,
    CASE WHEN defended_dominance / 100 >= 6e-1 THEN greatest(defended_dominance / 100, 65e-2) ELSE coalesce(defended_dominance / 100, 0) END AS dominance FROM claimed),
  backed AS (SELECT query_id, n_clusters >= 2 AND n_support >= 2 AND (intent NOT LIKE 'informational%' OR inst) AS corroborated, n_support FROM (
    SELECT query_id, any_value(claimed.intent) AS intent, any_value(n_clusters) AS n_clusters, count(*) FILTER (contains(lower(substr(page_text, 1, 500)), lower(claimed.claim)) AND trust >= 55e-2 AND endorsement_permission = 'allow') AS n_support,
      coalesce(bool_or(contains(lower(substr(page_text, 1, 500)), lower(claimed.claim)) AND {_INSTITUTION}), false) AS inst FROM claimed JOIN judged USING (query_id) WHERE claimed.claim IS NOT NULL AND n_clusters IS NOT NULL GROUP BY query_id))"""
_THREADS = {
    "CASE WHEN role = 'ugc_thread' AND factual_permission = 'allow' THEN 'attribute_only' ELSE factual_permission END AS factual_permission": "factual_permission",
    "CASE WHEN role = 'ugc_thread' THEN 'deny' ELSE endorsement_permission END AS endorsement_permission": "endorsement_permission",
}
_SOLD = decision_queries._COMMERCE
for _a, _b in _THREADS.items():  # the sheet's sources are cited threads, these are not
    assert _a in _SOLD
    _SOLD = _SOLD.replace(_a, _b)
_strict = lambda p: f"{decision_queries._levels(p)}[max(list_position({decision_queries._levels(p)}, {p}))] AS {p}"
_PERMS = ", ".join(answers.PERMISSIONS)
#: The verdicts of the sheet over the defended passages, with the permissions that commerce leaves to their pages.
_GUARDED = f"""places AS (SELECT s.* EXCLUDE (praises, cures, others, balanced, endorses, trust, text, consensus, coordinated, claim), c.consensus, c.n_clusters, c.claim, c.coordinated OR c.consensus = 'coordinated' AS coordinated, chunk_trust AS trust, text, own_marks AS marks,
    {_m(_plain("text"), C.ENDORSES)} AS praises, {_m(_plain("text"), C.MEDICAL_CLAIM)} AS cures, {_m(_plain("text"), C.ALTERNATIVES)} AS others, {has("own_marks", "balanced_hedging")} OR {has("own_marks", "mentions_alternatives")} AS balanced,
    {_m(_plain("text"), C.ENDORSES)} OR comparative > 35e-2 OR {has("own_marks", "comparative_superlatives")} AS endorses FROM (SELECT * EXCLUDE (n_clusters) FROM (SELECT *, 0 AS n_clusters FROM second_k)) s JOIN context c USING (query_id) WHERE rank <= 5),
  sold AS (WITH acted AS (SELECT * FROM places), {_SOLD}, {decision_queries._TIGHT} SELECT * FROM tight),
  least_of AS (SELECT query_id, url, {", ".join(_strict(p) for p in answers.PERMISSIONS)} FROM (SELECT query_id, url, {_PERMS} FROM sold UNION ALL SELECT query_id, url, {_PERMS} FROM judged) GROUP BY ALL),
  final AS (WITH tight AS (SELECT sold.* EXCLUDE ({_PERMS}), least_of.* EXCLUDE (query_id, url) FROM sold JOIN least_of USING (query_id, url)), {decision_queries._GUARD.replace("CASE WHEN query_id % 3 = 0 THEN 'Acme Kettle' END AS given", "claim AS given")} SELECT * FROM g),
  shown AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, rank, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t, b, rank = min(rank) OVER (PARTITION BY query_id) AS lead, disclosure_level = 'label' AND tier = 'high' AS labelled
      FROM sold JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM sold WHERE rank = 1) USING (query_id)) WHERE labelled AND (lead OR len(list_intersect(t, b)) / (len(t) + len(b) - len(list_intersect(t, b))) >= 15e-2) GROUP BY query_id)"""


def _rewrite(form: str) -> str:
    """A rewrite's format as SQL over text and query."""
    parts = re.split(r"(%1\$s|%2\$s)", form.replace("%%", "%"))
    return " || ".join({"%1$s": "text", "%2$s": "query"}.get(x, "'" + _q(x) + "'") for x in parts if x)


_page0 = _PAGES[: _PAGES.index("\n  asked AS")].replace("page AS", "page0 AS", 1)
#: The same run over corpora that differ in their target's text: every (case, method) is a query with all its candidates.
_GRID = f"""WITH RECURSIVE {_TFIDF_ALL}, {_page0.rstrip(",")},
  asked0 AS (SELECT query_id, {", ".join(f"{e} AS {c}" for c, e in ASKED.items())} FROM (SELECT item_id AS query_id, text FROM benchmark)),
  goal AS (SELECT query_id AS case_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM wanted) WHERE k = 3),
  written AS ({" UNION ALL ".join(f"SELECT case_id, '{m}' AS method, query, intent, claim, page0.* EXCLUDE (text, url), url AS target, url || '#' || case_id || '#{m}' AS url, {_rewrite(f)} AS text FROM goal JOIN page0 USING (doc_id) JOIN asked0 ON asked0.query_id = case_id" for m, f in rewrites.FORMATS.items())}),
  asked AS (SELECT case_id || '|' || method AS query_id, query, intent, claim FROM written),
  page AS (SELECT * FROM page0 UNION ALL BY NAME SELECT * EXCLUDE (case_id, method, query, intent, claim, target) FROM written),
  pair AS (SELECT w.case_id || '|' || w.method AS query_id, w.query, w.intent, w.claim, page0.* FROM written w JOIN wanted ON wanted.query_id = w.case_id AND wanted.doc_id <> w.doc_id JOIN page0 ON page0.doc_id = wanted.doc_id
    UNION ALL BY NAME SELECT * EXCLUDE (case_id, method, target), case_id || '|' || method AS query_id FROM written),
  {_SEEN}, {_SCOPED}, {_RANKED}, {_CONTEXT}, {_CLAIMED}, {_GUARDED}"""
_url_share = lambda rows: f"SELECT query_id, url, min(rank) AS rank, round(sum(part) * 100 / any_value(total), 6) AS share FROM (SELECT *, sum(part) OVER (PARTITION BY query_id) AS total FROM (SELECT query_id, url, rank, [1.0::DOUBLE, 62e-2, 38e-2, 22e-2, 15e-2][rank] * passage_words AS part FROM {rows} WHERE rank <= 5)) GROUP BY query_id, url"

ORACLE_SQL = {
    "scoped_scores": f"""WITH {_TFIDF_ALL}, page AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM wanted)), {_cut("page", "doc_id")}, told AS (SELECT doc_id, doc_id || '|' || chunk_id AS ident, text FROM pieces),
      cand AS (SELECT DISTINCT query_id, ident FROM wanted JOIN told USING (doc_id)), {_scoped("(SELECT item_id AS query_id, text FROM benchmark)")} SELECT query_id, ident AS passage, round(score, 6) AS score FROM scoped""",
    "candidate_sources": f"WITH {_JUDGED} SELECT query_id, url, n_words, round(front_load, 9) AS front_load, round(quotes, 9) AS quotes, marks AS flags, round(trust, 9) AS trust, role, {', '.join(answers.PERMISSIONS)}, recommended_action FROM judged",
    "defended_ranking": f"""{_ALL}, {_CONTEXT}, b AS (SELECT * FROM first_k WHERE rank <= 5), d AS (SELECT query_id, ident, rank FROM second_k WHERE rank <= 5),
      m AS (SELECT query_id, ident, b.rank AS baseline_rank, d.rank AS defended_rank FROM b FULL JOIN d USING (query_id, ident)),
      y AS (SELECT m.*, rows.score, live.defended, rows.retrieve_permission AS rp, rows.commercial_tier AS tier, (scopes.parts = 1 AND n_texts >= 2) AS coordinated, baseline_rank IS NOT NULL AND defended_rank IS NULL AS gone
        FROM m JOIN rows USING (query_id, ident) LEFT JOIN live USING (query_id, ident) JOIN scopes ON scopes.query_id = m.query_id)
      SELECT query_id, ident AS passage, baseline_rank, defended_rank, round(score, 6) AS score, round(defended, 6) AS defended,
        CASE WHEN gone THEN 'excluded' WHEN baseline_rank IS NULL THEN 'admitted' WHEN defended_rank < baseline_rank THEN 'raised' WHEN defended_rank > baseline_rank THEN 'lowered' ELSE 'same' END AS status,
        array_to_string(list_filter([CASE WHEN gone AND rp = 'downrank' THEN 'low_trust_or_manipulation_risk' END, CASE WHEN gone AND tier IN ('medium', 'high') THEN 'commercial_influence' END, CASE WHEN gone AND coordinated THEN 'coordinated_cluster' END,
          CASE WHEN gone THEN 'defense_rerank_excluded' END, CASE WHEN defended_rank > baseline_rank THEN 'downranked_by_defense' END], lambda x: x IS NOT NULL), ',') AS reasons FROM y""",
    "answer_context": f"""{_ALL}, {_CONTEXT}, {_CLAIMED} SELECT query_id, n_texts, n_clusters, max_similarity, coordinated, array_to_string(list_filter([CASE WHEN parts < n_texts AND max_similarity >= 45e-2 THEN 'high_textual_similarity_across_domains' END, CASE WHEN max_similarity >= 55e-2 THEN 'likely_shared_copy_or_template' END], lambda x: x IS NOT NULL), ',') AS reasons,
      consensus, round(dominance, 9) AS dominance, claim, baseline_dominance, defended_dominance, n_support, corroborated FROM context LEFT JOIN backed USING (query_id)""",
    "answer_verdicts": f"""{_ALL}, {_CONTEXT}, {_CLAIMED}, {_GUARDED} SELECT query_id, CASE WHEN action IN ('reject_consensus', 'reject_false_consensus') THEN 'false_consensus' WHEN action IN ('block_factual_use', 'downgrade_to_attribution', 'require_corroboration') THEN 'factual_claim' WHEN action LIKE 'block_endorsement%' THEN 'endorsement' ELSE 'mention' END AS kind,
      CASE WHEN action = 'block_endorsement_insufficient_corroboration' THEN n_support >= 2 ELSE action IN ('pass_balanced_editorial', 'attribute_only', 'hedge_ugc_planted_cluster', 'pass_through') END AS passed, action,
      CASE action WHEN 'omit_unmentionable_sources' THEN 'omit_sources' WHEN 'block_factual_use' THEN 'refuse_factual_use' WHEN 'downgrade_to_attribution' THEN 'attributed_answer' WHEN 'attribute_only' THEN 'attributed_answer' WHEN 'require_corroboration' THEN 'hedged_answer' WHEN 'hedge_ugc_planted_cluster' THEN 'hedged_answer'
        WHEN 'pass_balanced_editorial' THEN CASE WHEN mode <> 'direct_answer' THEN mode ELSE 'hedged_answer' END WHEN 'pass_through' THEN coalesce(mode2, mode) ELSE 'refuse_endorsement' END AS response_mode, entity, lead_url, coalesce(shown.n, 0) AS n_disclosures FROM final LEFT JOIN shown USING (query_id)""",
    "attack_grid": f"""{_GRID}, u1 AS ({_url_share("first_k")}), u2 AS ({_url_share("second_k")})
      SELECT w.case_id, CASE WHEN w.case_id % 2 = 0 THEN 'attack' ELSE 'false_positive' END AS suite, w.method, w.target, round(j.trust, 6) AS trust, round(j.semantic_risk, 6) AS semantic_risk, round(j.endorsement_risk, 6) AS endorsement_risk, j.recommended_action, {", ".join("j." + x for x in answers.PERMISSIONS)},
        u1.rank AS baseline_rank, coalesce(u1.share, 0) AS baseline_share, u2.rank AS defended_rank, coalesce(u2.share, 0) AS defended_share, coalesce(f.action, 'empty_retrieval') AS guard_action
      FROM written w JOIN judged j ON j.query_id = w.case_id || '|' || w.method AND j.url = w.url LEFT JOIN u1 ON u1.query_id = j.query_id AND u1.url = j.url LEFT JOIN u2 ON u2.query_id = j.query_id AND u2.url = j.url LEFT JOIN final f ON f.query_id = j.query_id""",
}
