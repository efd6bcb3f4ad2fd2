"""Queries of URL, fetch and link operators over addresses made from the documents' ids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import fetch
from sourcelens.functions import urls as U
from sourcelens.operators import graph, seeds
from sourcelens.plans import role_sql
from sourcelens.plans.sheet import pick, text
from sourcelens.sources.tables import table

WEB = {
    "host": pick("doc_id * 7", *text("www.acme-shop.com", "acmeshop.net", "health.gov", "forum.kettles.net", "abcnews.go.com", "shop.acme.co.uk", "www.nytimes.com", "cdn.bbc.co.uk", "x.io", "Theo-Grace.com", "theograce.org")),
    "path": pick("doc_id * 5", *text("/Best-Kettles/", "/product/kettle-900", "/2026/03/steam-kettle", "/wiki/Kettle%28boiler%29", "/p/abc", "/en/top-teas/a1b2", "", "/threads/kettle.12", "/shop/the-best-travel-mugs?q=steam+kettle+pro+max+now", "/list?keywords=tea", "/bot/challenge/x", "/directory/", "/gaming_forums/")),
    "other": pick("doc_id * 3", *text("https://acmeshop.com/product/kettle-900/", "https://acme-shop.com/x", "https://theograce.com/", "https://WWW.health.gov/about", "https://kettles.net/threads/kettle.12")),
    "status_code": pick("doc_id", "200", "200", "403", "404", "301", "503", "CAST(NULL AS INT)"),
    "title": pick("doc_id", *text("A kettle", "Just a moment...", "Tea", "Kettles", "Access denied", "Teapots")),
    "body": pick("doc_id * 2", *text(
        "one two three", "subscribe to continue reading this", "can you chip in? please", "checking your browser now", "performing security verification", "under $ 50 or so",
        "see https://acme.com/kettle and http://blog.tea.org/x?y=1, or (https://acme.com/kettle)", "https://forum.kettles.net/t/1", "the theograce necklace", "a theo grace ring", "theo gracious",
    )),
    "error": pick("doc_id", *text("", "Read timed out", "404", "ConnectError: refused", "Server disconnected")),
    "filler": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE repeat('filler ', 40) END",
}
_MADE = ", ".join(f"{e} AS {c}" for c, e in WEB.items())
SQL = f"web AS (SELECT *, 'https://' || host || path AS url, filler || body AS content FROM (SELECT doc_id, {_MADE} FROM documents))"


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", *(f"{e} AS {c}" for c, e in WEB.items()))
    return rows.withColumns({"url": F.concat(F.lit("https://"), "host", "path"), "content": F.concat("filler", "body")})


def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, other, host = F.col("url"), F.col("other"), U.hostname(F.col("url"))
    role = U.page_role(url)
    return web(spark, sf_dir).select(
        "doc_id", host.alias("host"), U.registrable_domain(U.authority(url)).alias("domain"), U.apex(host).alias("apex"), U.is_news(host).alias("news"), role.alias("role"), U.is_ugc(role).alias("ugc"),
        U.is_open_posting(url).alias("open_posting"), U.is_parasitic(url, role, F.col("doc_id") % 2 == 0).alias("parasitic"), U.normalised(url).alias("normalised"), U.category_hint(url).alias("category"),
        U.price_hint(F.col("content"), url).alias("price"), U.product_slug(url).alias("slug"), U.same_brand(url, other).alias("same_brand"), U.related_brand(url, other).alias("related"),
        F.array_join(U.saved_names(url), " ").alias("saved"), U.is_cited(F.array(other, F.lit("https://z.org/q")), url).alias("cited"),
        U.raw_snapshot(F.concat(F.lit("https://archive.example/web/2024"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "id_/").otherwise("/"), url)).alias("snapshot"),
    )


def fetch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, content, url, title = F.col("status_code"), F.col("content"), F.col("url"), F.col("title")
    return web(spark, sf_dir).select(
        "doc_id", fetch.is_wall(status, content, url, title).alias("wall"), fetch.is_ok(status, content, url, title).alias("ok"), fetch.is_transient(F.col("error")).alias("transient"),
        fetch.is_challenge(content, title, url).alias("challenge"), fetch.is_blocked_still(status, content, url, title).alias("blocked"), fetch.is_junk_snapshot(content, title).alias("junk"),
        fetch.is_paywalled(F.lit(None).cast("string"), content).alias("paywalled"),
    )


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's page links to twelve places, some of them twice; whether a place answers follows from its number."""
    rows = web(spark, sf_dir).select(F.concat("url", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), "host", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("position"))
    n = (F.col("doc_id") + F.col("position") * 5) % 9
    links = rows.select("url", "position", F.concat(F.lit("https://"), F.when(n % 4 == 0, "other.org").otherwise(F.col("host")), F.lit("/"), n.cast("string"), F.lit("#a")).alias("target"))
    status = links.select(F.substring_index("target", "#", 1).alias("target")).distinct().withColumn("n", F.substring_index("target", "/", -1).cast("int"))
    status = status.where("n <> 7").select("target", F.when(F.col("n") % 3 == 0, 404).otherwise(200).alias("status_code"))
    return fetch.broken_link_ratio(links, status).withColumn("broken_link_ratio", F.round("broken_link_ratio", 9))


def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses cited by a query, sixteen a query, in order and once each, ten at most."""
    rows = web(spark, sf_dir).withColumn("query_id", F.floor(F.col("doc_id") / 16))
    cited = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "url"))), lambda x: x["url"]).alias("urls"))  # sixteen
    return cited.select("query_id", F.array_join(U.distinct_urls(F.col("urls"), 10), " ").alias("urls"))


def text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.text_edges(web(spark, sf_dir).select("url", F.col("content").alias("text")))


def link_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = web(spark, sf_dir)
    edges = graph.referral_edges(graph.text_edges(rows.select("url", F.col("content").alias("text"))), rows.select(F.col("url").alias("source_url"), F.lit("page").alias("segment"), F.col("other").alias("target_url")))
    return graph.promotion(edges, rows.select("url").distinct().withColumn("role", U.page_role(F.col("url"))))


def referral_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = web(spark, sf_dir).withColumn("names", U.markers(F.col("other"), F.lit("Theo Grace - Name Necklace"), F.lit("Theo Grace"), F.array(F.lit("best gifts"), F.lit("tg jewels"))))
    blob = F.lower(F.concat(F.lit("some text around what is said there to make it long enough for a look: "), "content", F.lit(" and so on, until there is no more of it at all")))
    tie = U.connection(blob, F.col("other"), F.col("names"))
    return rows.select("doc_id", F.array_join("names", ",").alias("names"), tie["kind"].alias("kind"), tie["confidence"].alias("confidence"), tie["marker"].alias("marker"), U.is_near_miss(blob, F.col("names")).alias("near_miss"))


META = {
    "title": pick("doc_id * 3", *text("Steam Kettle | Acme", "The Best Tea", "", "Reviews", "Green Tea - Teahouse")), "site_name": pick("doc_id", *text("", "Acme", "")), "organization": pick("doc_id", *text("", "Bolt", "", "")),
    "brand": pick("doc_id", *text("", "Theo Grace", "Acme", "best", "")), "product": pick("doc_id", *text("", "Steam Kettle", "Acme", "topics", "", "", "Kettle 900")),
}
ROLE = pick("doc_id", *text("commercial_product", "editorial", "institutional", "ugc_thread", "factual_blog", "expert_listicle"))


def seed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = web(spark, sf_dir).drop("title").selectExpr("*", *(f"{e} AS {c}" for c, e in META.items()), f"{ROLE} AS role").withColumn("text", F.col("content"))
    rows = seeds.metadata(rows)
    own = seeds.seeds(F.col("role"))
    return rows.select("doc_id", "entity", "org", "category", "topic", "price", seeds.confidence(F.col("role")).alias("confidence"), F.array_join(own, "|").alias("seeds"), F.array_join(seeds.with_forums(own), "|").alias("forums"), F.array_join(seeds.with_names(own, F.array(F.lit("tg jewels"), F.lit("Acme"))), "|").alias("names"))


QUERIES = {f.__name__: f for f in (seed_queries, url_facts, fetch_verdicts, broken_links, distinct_urls, text_links, link_promotion, referral_ties)}

_q = lambda s: s.replace("'", "''")
_any = lambda t, snippets: "(" + " OR ".join(f"contains({t}, '{_q(s)}')" for s in snippets) + ")"
_in = lambda words: ", ".join(f"'{_q(w)}'" for w in words)
_other = lambda s: s.replace("url", "other")
_DOMAIN, _OTHER = role_sql.domain(role_sql.AUTHORITY), role_sql.domain(_other(role_sql.AUTHORITY))
_RAWPATH = role_sql.PATH.removeprefix("lower(").removesuffix(")")
_WORDS = "len(list_filter(string_split_regex(coalesce(content, ''), '\\s+'), lambda x: x <> ''))"
_FETCH = f"""f AS (SELECT doc_id, status_code, error, url, title, content, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS blob, contains({role_sql.PATH}, '/bot/challenge') AS gate, {_WORDS} AS n FROM web),
  g AS (SELECT *, coalesce(status_code IN ({", ".join(map(str, C.BLOCKED_STATUS))}), false) OR gate OR {_any("blob", C.WALL_SNIPPETS)} OR n < 30 AS wall, gate OR {_any("blob", C.CHALLENGE_SNIPPETS)} AS challenge FROM f),
  h AS (SELECT *, coalesce(status_code BETWEEN 200 AND 399, false) AND NOT wall AS ok FROM g)"""
_SLUG = f"list_filter(list_reverse(string_split(regexp_replace({role_sql.PATH}, '^/+|/+$', '', 'g'), '/')), lambda p: p NOT IN ({_in(C.PATH_SKIP)}) AND length(p) >= 4 AND NOT regexp_matches(p, '{C.PATH_DATE}') AND NOT regexp_matches(p, '^\\d+$') AND NOT regexp_matches(replace(p, '-', ' '), '{C.LISTICLE_PREFIX}') AND (regexp_matches(p, '\\d') OR (contains(p, '-') AND length(p) >= 6)))[1]"
_ASKED = lambda key: f"nullif(array_to_string(list_filter(string_split_regex(replace(regexp_extract(lower({role_sql.QUERY}), '{key}=([^&]+)', 1), '+', ' '), '\\s+'), lambda w: w <> '')[1:4], ' '), '')"
_HOST = role_sql.HOST
_NEWS = "(" + " OR ".join(f"{_HOST} = '{h}' OR ends_with({_HOST}, '.{h}')" for h in C.NEWS_HOSTS) + ")"
_EDGES = f"""t AS (SELECT DISTINCT url AS source_url, regexp_replace(unnest(regexp_extract_all(content, 'https?://[^\\s\\])>"'']+')), '[.,;:!?]+$', '') AS target_url FROM web),
  text_edges AS (SELECT source_url, 'text' AS segment, target_url, {role_sql.domain(role_sql.AUTHORITY.replace("url", "target_url"))} AS target_domain, {role_sql.domain(role_sql.AUTHORITY.replace("url", "source_url"))} AS own FROM t)"""
_MARKERS = f"""base AS (SELECT doc_id, other, content, string_split({_OTHER}, '.')[1] AS pub FROM web),
  m AS (SELECT *, list_filter(list_transform(['Theo Grace', 'Theo Grace - Name Necklace', 'Theo Grace ', ' Name Necklace', 'best gifts', 'tg jewels'], lambda t: trim(lower(t))),
    lambda t: t NOT IN ({_in(C.ORG_STOPWORDS)}) AND t NOT IN ({_in(C.WEAK_MARKERS)}) AND length(t) >= 4 AND NOT regexp_matches(t, '{_q("|".join(C.GENERIC_MARKERS))}')) AS kept FROM base),
  n AS (SELECT *, list_concat(CASE WHEN length(pub) >= 4 AND pub NOT IN ({_in(C.ORG_STOPWORDS)}) THEN [pub] ELSE [] END, flatten(list_transform(kept, lambda t: CASE WHEN length(regexp_replace(t, '[^a-z0-9]', '', 'g')) >= 5 THEN [t, regexp_replace(t, '[^a-z0-9]', '', 'g')] ELSE [t] END))) AS every FROM m),
  k AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS names, lower('some text around what is said there to make it long enough for a look: ' || content || ' and so on, until there is no more of it at all') AS blob,
    {_OTHER} AS domain, lower(regexp_extract(other, '^https?://[^/]+(/[^?]*)?', 1)) AS p, lower(regexp_replace(other, '/+$', '')) AS link, lower(regexp_replace(other, '^https?://', '')) AS host_path FROM n),
  c AS (SELECT *, list_filter(names, lambda x: contains(blob, x))[1] AS named, trim(p, '/') AS bare, list_concat(names, list_filter(flatten(list_transform(names, lambda x: string_split_regex(x, '[\\s_/-]+'))), lambda x: length(x) >= 4)) AS parts FROM k)"""

_CATEGORY = f"""coalesce(trim(replace(replace(list_filter(string_split({role_sql.PATH}, '/'), lambda p: starts_with(p, 'best-') OR starts_with(p, 'the-best-'))[1], '-', ' '), 'the ', '')), {_ASKED("keywords")}, {_ASKED("q")}, {_ASKED("search")}, 'product')"""
_PRICE = f"""coalesce({", ".join(f"nullif(regexp_extract(lower(content[1:500] || ' ' || url), '{p}', 1), '')" for p in C.PRICE_HINTS)}, '1000')"""


def _usable(c: str) -> str:
    w = f"string_split_regex(lower({c}), '\\s+')"
    own = f"len(list_filter({w}, lambda x: x NOT IN ({_in(C.NAME_STOPWORDS)}) AND NOT regexp_full_match(x, '\\d+')))"
    return f"CASE WHEN length({c}) >= 4 AND {w}[1] NOT IN ({_in(C.INTERROGATIVES)}) AND {w}[-1] NOT IN ({_in(C.DANGLING)}) AND {own} > 0 AND (len({w}) < 2 OR {own} * 2 > len({w})) AND lower({c}) NOT IN ({_in(C.WEAK_MARKERS)}) THEN {c} END"


def _fill(templates: list[str], category: str) -> str:
    out = []
    for t in templates:
        e = f"'{t}'"
        for name in ("entity", "category", "topic", "price", "org"):
            if f"{{{name}}}" in t:
                e = f"replace({e}, '{{{name}}}', {category if name == 'category' else name})"
        out.append(f"trim({e})")
    return "[" + ", ".join(out) + "]"


_FIRST = lambda lists, most=12: f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)[1:{most}]"
_SEEDS = f"""m0 AS (SELECT doc_id, url, other, content, {", ".join(f"{e} AS {c}" for c, e in META.items())}, {ROLE} AS role, {_CATEGORY} AS category, {_PRICE} AS price, string_split({_DOMAIN}, '.')[1] AS pub, {_DOMAIN} AS domain FROM web),
  m1 AS (SELECT *, nullif(trim(regexp_replace(title, '\\s*[|-].*$', '')), '') AS short, coalesce(nullif(organization, ''), nullif(site_name, ''), nullif(brand, ''), pub) AS org, CASE WHEN lower(product) <> lower(coalesce(nullif(organization, ''), nullif(site_name, ''), nullif(brand, ''), pub)) AND lower(product) <> lower(brand) THEN nullif(product, '') END AS thing FROM m0),
  m2 AS (SELECT *, coalesce({_usable("thing")}, {_usable("nullif(brand, '')")}, {_usable("short")}, {_usable("org")}, pub) AS entity, coalesce(short, category) AS topic, trim(regexp_replace(category, '^best ', '')) AS cat, trim(regexp_replace(trim(regexp_replace(category, '^best ', '')), '\\s+forums?$', '')) AS fcat FROM m1),
  m3 AS (SELECT *, list_concat(CASE role WHEN 'commercial_product' THEN {_fill(seeds.PRODUCT, "cat")} WHEN 'editorial' THEN {_fill(seeds.EDITORIAL, "cat")} WHEN 'institutional' THEN {_fill(seeds.INSTITUTIONAL, "cat")} ELSE {_fill(seeds.INFORMATIONAL, "cat")} END,
    CASE WHEN role IN ({_in(seeds.DISCUSSED)}) THEN {_fill(seeds.DISCUSSION, "cat")} ELSE [] END) AS raw FROM m2), m4 AS (SELECT *, {_FIRST("raw")} AS own FROM m3),
  m5 AS (SELECT *, list_concat({_fill(seeds.FORUMS, "fcat")}, own) AS f, list_concat([entity, entity || ' reviews', domain], list_filter(['tg jewels', 'Acme'], lambda a: lower(a) <> lower(entity)), own) AS n FROM m4)"""

ORACLE_SQL = {
    "seed_queries": f"WITH {SQL}, {_SEEDS} SELECT doc_id, entity, org, category, topic, price, CASE WHEN role IN ('commercial_product', 'editorial') THEN 'high' WHEN role IN ('institutional', 'factual_blog') THEN 'medium' ELSE 'low' END AS confidence, array_to_string(own, '|') AS seeds, array_to_string({_FIRST('f')}, '|') AS forums, array_to_string({_FIRST('n')}, '|') AS names FROM m5",
    "url_facts": f"""WITH {SQL} SELECT doc_id, {_HOST} AS host, {_DOMAIN} AS domain, CASE WHEN {_HOST} IN ({_in(C.NEWS_HOSTS)}) THEN {_HOST} ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END AS apex, {_NEWS} AS news, {role_sql.page_role()} AS role,
      {role_sql.page_role()} = 'ugc_thread' AS ugc, {role_sql.OPEN_POSTING} AS open_posting, {role_sql.OPEN_POSTING} OR {role_sql.PUBLISH} OR {role_sql.DIRECTORY} OR {role_sql.page_role()} IN ('review_profile', 'ugc_thread') OR ({role_sql.page_role()} = 'factual_blog' AND doc_id % 2 = 0) AS parasitic,
      lower(url_decode(regexp_replace(url, '/+$', ''))) AS normalised,
      coalesce(trim(replace(replace(list_filter(string_split({role_sql.PATH}, '/'), lambda p: starts_with(p, 'best-') OR starts_with(p, 'the-best-'))[1], '-', ' '), 'the ', '')), {_ASKED("keywords")}, {_ASKED("q")}, {_ASKED("search")}, 'product') AS category,
      coalesce({", ".join(f"nullif(regexp_extract(lower(content[1:500] || ' ' || url), '{p}', 1), '')" for p in C.PRICE_HINTS)}, '1000') AS price, coalesce(replace({_SLUG}, '-', ' '), '') AS slug, {_DOMAIN} = {_OTHER} AS same_brand,
      {_DOMAIN} <> {_OTHER} AND length(replace(string_split({_DOMAIN}, '.')[1], '-', '')) >= 4 AND length(replace(string_split({_OTHER}, '.')[1], '-', '')) >= 4 AND replace(string_split({_DOMAIN}, '.')[1], '-', '') = replace(string_split({_OTHER}, '.')[1], '-', '') AS related,
      {_HOST} || '_' || CASE WHEN trim({_RAWPATH}, '/') = '' THEN 'index' ELSE replace(trim({_RAWPATH}, '/'), '/', '_') END || '.html ' || {_HOST} || replace(CASE WHEN rtrim({_RAWPATH}, '/') = '' THEN '/' ELSE rtrim({_RAWPATH}, '/') END, '/', '_') || '.html' AS saved,
      lower(rtrim(other, '/')) = lower(rtrim(url, '/')) OR (rtrim({role_sql.PATH}, '/') <> '' AND (contains(lower(regexp_extract(other, '^https?://[^/]+([^?#]*)', 1)), rtrim({role_sql.PATH}, '/')) OR contains('/q', rtrim({role_sql.PATH}, '/')))) AS cited,
      CASE WHEN doc_id % 3 <> 0 THEN 'https://archive.example/web/2024' || doc_id || 'id_/' || url END AS snapshot FROM web""",
    "fetch_verdicts": f"""WITH {SQL}, {_FETCH} SELECT doc_id, wall, ok, {_any("lower(error)", C.TRANSIENT_ERRORS)} AS transient, challenge, wall OR NOT ok OR challenge AS blocked, {_any("blob", C.SNAPSHOT_JUNK)} OR n < 30 AS junk,
      {_any("lower(content)", C.PAYWALL_SNIPPETS + C.PAYWALL_TOKENS)} AS paywalled FROM h""",
    "broken_links": f"""WITH {SQL}, l AS (SELECT url || '/' || doc_id AS url, host, position, (doc_id + position * 5) % 9 AS n FROM web, range(12) r(position)),
      o AS (SELECT url, n, min(position) AS first FROM l WHERE n % 4 <> 0 GROUP BY url, n, host), k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY first) AS k FROM o)
      SELECT url, round(coalesce(avg(CASE WHEN n = 7 OR n % 3 = 0 THEN 1 ELSE 0 END) FILTER (k <= 8), 0), 9) AS broken_link_ratio FROM (SELECT DISTINCT url FROM l) LEFT JOIN k USING (url) GROUP BY url""",
    "distinct_urls": f"""WITH {SQL}, n AS (SELECT doc_id // 16 AS query_id, doc_id, url, lower(url_decode(regexp_replace(url, '/+$', ''))) AS name FROM web),
      o AS (SELECT query_id, name, arg_min(url, doc_id) AS url, min(doc_id) AS place FROM n GROUP BY query_id, name), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM o)
      SELECT query_id, string_agg(url, ' ' ORDER BY place) AS urls FROM k WHERE k <= 10 GROUP BY query_id""",
    "text_links": f"WITH {SQL}, {_EDGES} SELECT source_url, segment, target_url, target_domain FROM text_edges WHERE target_domain <> own",
    "link_promotion": f"""WITH {SQL}, {_EDGES}, e AS (SELECT source_url, segment, target_url, target_domain, own FROM text_edges WHERE target_domain <> own
        UNION SELECT url, 'page', other, {_OTHER}, {_DOMAIN} FROM web WHERE {_OTHER} <> {_DOMAIN}), roles AS (SELECT DISTINCT url AS source_url, {role_sql.page_role()} AS role FROM web),
      d AS (SELECT DISTINCT source_url, segment, lower(target_url) AS t, target_domain, own FROM e),
      h AS (SELECT target_domain, own AS host, count(*) AS n, bool_or(role IN ('ugc_thread', 'review_profile', 'expert_listicle')) AS crossing FROM d JOIN roles USING (source_url) GROUP BY 1, 2)
      SELECT target_domain, sum(n)::BIGINT AS n_edges, round(sum(n) / sum(sum(n)) OVER (), 9) AS concentration, count(*) AS n_hosts, count(*) >= 3 AS converges, count(*) FILTER (crossing) AS n_cross_platform FROM h GROUP BY target_domain""",
    "referral_ties": f"""WITH {SQL}, {_MARKERS} SELECT doc_id, array_to_string(names, ',') AS names, CASE WHEN contains(blob, link) OR (contains(blob, domain) AND bare <> '' AND contains(blob, bare)) OR contains(blob, host_path) THEN 'url_link' WHEN named IS NOT NULL THEN 'brand_mention' END AS kind,
      CASE WHEN contains(blob, link) OR (contains(blob, domain) AND bare <> '' AND contains(blob, bare)) OR contains(blob, host_path) THEN 'high' WHEN named IS NOT NULL THEN 'weak' END AS confidence,
      CASE WHEN contains(blob, link) THEN link WHEN contains(blob, domain) AND bare <> '' AND contains(blob, bare) THEN domain || '/' || bare WHEN contains(blob, host_path) THEN host_path ELSE named END AS marker,
      length(blob) >= 120 AND len(list_filter(parts, lambda x: contains(blob, x) OR (length(regexp_replace(x, '[^a-z0-9]', '', 'g')) >= 4 AND contains(regexp_replace(blob, '[^a-z0-9]', '', 'g'), regexp_replace(x, '[^a-z0-9]', '', 'g'))))) > 0 AS near_miss FROM c""",
}
