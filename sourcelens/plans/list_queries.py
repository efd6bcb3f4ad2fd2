"""Markers, hosts and profiles against tables of them, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import urls as U
from sourcelens.operators import hosts, ties
from sourcelens.plans import role_sql
from sourcelens.plans.sheet import SOURCE
from sourcelens.sources.tables import table

def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as targets: their names are words that stand together in the item, so documents with passages of it name them."""
    w = F.split(F.col("text"), " ")
    at = lambda k: F.get(w, F.lit(k - 1))
    rows = table(spark, sf_dir, "benchmark").where(F.size(w) >= 7)
    url = F.concat(F.lit("https://www."), F.lower(F.regexp_replace(at(1), "[^A-Za-z]", "")), F.when(F.col("item_id") % 3 == 0, ".com/").otherwise(".co.uk/p/"), F.col("item_id").cast("string"))
    org = F.when(F.col("item_id") % 2 == 0, F.concat_ws(" ", at(4), at(5))).otherwise("")
    return rows.select(F.col("item_id").alias("target_id"), url.alias("url"), F.concat_ws(" ", at(1), at(2), at(3)).alias("entity"), org.alias("org"), F.array(F.concat_ws(" ", at(6), at(7))).alias("aliases"))


def marker_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name benchmark items' targets; every ninth document also links the target of its number."""
    docs = table(spark, sf_dir, "documents")
    targets = _targets(spark, sf_dir)
    linked = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" see https://www.maker"), (F.col("doc_id") % 50).cast("string"), F.lit(".com/item/"), (F.col("doc_id") % 50).cast("string")))
    more = spark.range(50).select((F.col("id") + 1_000_000).alias("target_id"), F.concat(F.lit("https://www.maker"), F.col("id").cast("string"), F.lit(".com/item/"), F.col("id").cast("string"), F.lit("/")).alias("url"), F.lit("Maker Goods").alias("entity"), F.lit("").alias("org"), F.array().cast("array<string>").alias("aliases"))
    own = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.coalesce("text", F.lit("")), F.coalesce(linked, F.lit(""))).alias("blob"))
    return ties.ties(spark, own, targets.unionByName(more)).select(F.col("page_id").alias("doc_id"), "target_id", "kind", "confidence", "marker")


def host_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages and of the sheet: which listed news host each meets, and its registrable domain by a table of public suffixes."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), U.authority(F.col("url")).alias("host"))
    sheet = table(spark, sf_dir, "documents").selectExpr("doc_id + 1000000000 AS id", f"CASE WHEN doc_id % 4 = 0 THEN 'm.' || {SOURCE['host']} ELSE {SOURCE['host']} END AS host")
    listed = lambda values: spark.createDataFrame([(v,) for v in values], "entry string")
    rows = hosts.meets(pages.unionByName(sheet), "host", listed(C.NEWS_HOSTS), "news")
    return hosts.registrable(rows, "host", listed(C.TWO_LABEL_SUFFIXES))


QUERIES = {f.__name__: f for f in (marker_ties, host_lists)}
_list = lambda values: ", ".join(f"('{v}')" for v in values)
_BARE = "regexp_replace(regexp_replace(lower(coalesce(host, '')), ':\\d*$', ''), '^www\\.|^\\.+|\\.+$', '', 'g')"
_in = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_DOMAIN = role_sql.domain(role_sql.AUTHORITY)
_PATH = role_sql.PATH
ORACLE_SQL = {
    "marker_ties": rf"""WITH i AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
      t AS (SELECT item_id AS target_id, 'https://www.' || lower(regexp_replace(w[1], '[^A-Za-z]', '', 'g')) || CASE item_id % 3 WHEN 0 THEN '.com/' ELSE '.co.uk/p/' END || item_id AS url, w[1] || ' ' || w[2] || ' ' || w[3] AS entity,
          CASE WHEN item_id % 2 = 0 THEN w[4] || ' ' || w[5] ELSE '' END AS org, [w[6] || ' ' || w[7]] AS aliases FROM i WHERE len(w) >= 7
        UNION ALL SELECT 1000000 + k, 'https://www.maker' || k || '.com/item/' || k || '/', 'Maker Goods', '', []::VARCHAR[] FROM range(50) r(k)),
      t1 AS (SELECT *, {_DOMAIN} AS domain, trim({_PATH}, '/') AS bare, lower(regexp_replace(url, '/+$', '')) AS link, lower(regexp_replace(url, '^https?://', '')) AS host_path, string_split({_DOMAIN}, '.')[1] AS pub,
        list_filter(list_transform(list_concat([org, entity], string_split_regex(entity, '[|\-–—:]'), aliases), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))),
          lambda x: x NOT IN ({_in(C.ORG_STOPWORDS)}) AND x NOT IN ({_in(C.WEAK_MARKERS)}) AND x NOT IN ({_in(C.NAME_STOPWORDS)}) AND length(x) >= 4 AND NOT regexp_full_match(x, '\d+') AND NOT regexp_matches(x, '{"|".join(C.GENERIC_MARKERS).replace("'", "''")}')) AS kept FROM t),
      t2 AS (SELECT *, list_concat(CASE WHEN length(pub) >= 4 AND pub NOT IN ({_in(C.ORG_STOPWORDS)}) THEN [pub] ELSE [] END, list_filter(flatten(list_transform(kept, lambda x: [CASE WHEN length(x) <= 80 THEN x END, CASE WHEN length(regexp_replace(x, '[^a-z0-9]', '', 'g')) BETWEEN 5 AND 80 THEN regexp_replace(x, '[^a-z0-9]', '', 'g') END])), lambda x: x IS NOT NULL)) AS names FROM t1),
      d AS (SELECT doc_id, lower(coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN ' see https://www.maker' || doc_id % 50 || '.com/item/' || doc_id % 50 ELSE '' END) AS blob FROM documents),
      m AS (SELECT doc_id, target_id, link, domain, bare, host_path, contains(blob, link) AS a, contains(blob, domain) AND bare <> '' AND contains(blob, bare) AS b, contains(blob, host_path) AS c, list_filter(names, lambda x: contains(blob, x))[1] AS named FROM d, t2)
      SELECT doc_id, target_id, CASE WHEN a OR b OR c THEN 'url_link' ELSE 'brand_mention' END AS kind, CASE WHEN a OR b OR c THEN 'high' ELSE 'weak' END AS confidence, CASE WHEN a THEN link WHEN b THEN domain || '/' || bare WHEN c THEN host_path ELSE named END AS marker FROM m WHERE a OR b OR c OR named IS NOT NULL""",
    "host_lists": f"""WITH h AS (SELECT page_id AS id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1) AS host FROM pages UNION ALL SELECT doc_id + 1000000000, CASE WHEN doc_id % 4 = 0 THEN 'm.' || {SOURCE['host']} ELSE {SOURCE['host']} END FROM documents),
      b AS (SELECT *, {_BARE} AS bare FROM h), news(e) AS (VALUES {_list(C.NEWS_HOSTS)}), public(e) AS (VALUES {_list(C.TWO_LABEL_SUFFIXES)}),
      m AS (SELECT bare, (SELECT max_by(e, length(e)) FROM news WHERE bare = e OR ends_with(bare, '.' || e)) AS news, (SELECT max(len(string_split(e, '.'))) FROM public WHERE bare = e OR ends_with(bare, '.' || e)) AS k FROM (SELECT DISTINCT bare FROM b))
      SELECT id, host, news, array_to_string(string_split(bare, '.')[-least(len(string_split(bare, '.')), coalesce(k + 1, 2)):], '.') AS domain FROM b JOIN m USING (bare)""",
}
