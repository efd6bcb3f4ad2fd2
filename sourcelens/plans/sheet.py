"""A sheet of sources made from the documents' ids, so that decision operators meet every case they tell apart.

The driver's texts are invented words, on which English rules hardly ever hold. Each column is one expression that
Spark and the SQL side read alike; lists are comma-joined text on the sheet and split by either side on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.sources.tables import table

#: Sources a query.
EACH = 8


def pick(n: str, *values: str) -> str:
    """One of the values by n modulo their number."""
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def text(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


QUERY = {
    "query": pick("query_id", *text("best kettle for tea", "how to descale a kettle", "is Acme Kettle legit", "reddit forum opinions on the kettle", "what cures cancer symptoms", "should i buy the Acme Kettle", "history of tea")),
    "intent": pick("query_id", *text("informational", "commercial", "informational_high_stakes", "informational", "navigational")),
    "consensus": pick("query_id", *text("healthy", "shaky", "healthy", "coordinated", "healthy", "healthy", "shaky", "healthy", "healthy")),
    "dominance": "(query_id * 13 % 100) / 1e2",
    "n_clusters": pick("query_id", "1", "2", "3", "CAST(NULL AS INT)"),
}
SOURCE = {
    "rank": f"CAST(doc_id % {EACH} + 1 AS INT)",
    "host": pick("doc_id * 7", *text("www.acme.com", "health.gov", "forum.kettles.net", "blog.tea.org", "shop.acme.co.uk", "reviews.example.com", "news.cheap.xyz", "old.uni.edu", "www.nytimes.com", "kettle.io", "a.b.c.deep.net")),
    "path": pick("doc_id * 5", *text("/wiki/kettle", "/product/kettle-9", "/reviews/acme", "/picks/best", "/p/abc", "/pricing", "/threads/kettle.12", "/about", "/guide/tea", "/docs/x", "/posts/1", "/boards/tea/", "/best-forums/")),
    "ok": "doc_id % 13 <> 0",
    "status_code": "CASE WHEN doc_id % 13 <> 0 THEN 200 WHEN doc_id % 2 = 0 THEN 404 ELSE 503 END",
    "fetch_engine": pick("doc_id", *text("httpx", "playwright", "httpx")),
    "n_words": "CAST(doc_id * 17 % 140 AS INT)",
    "trust": "(doc_id * 37 % 101) / 1e2",
    "whois_age_days": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id * 53 % 3000 AS INT) END",
    "commercial_score": "(doc_id * 29 % 100) / 1e2",
    "commercial_tier": pick("doc_id * 3", *text("none", "low", "medium", "high", "none")),
    "list_items": "CAST(doc_id % 12 AS INT)",
    "rhetorical": "(doc_id * 7 % 100) / 1e2",
    "semantic_risk": "(doc_id * 19 % 90) / 1e2",
    "authority": "(doc_id * 23 % 100) / 1e2",
    "comparative": "(doc_id * 11 % 100) / 2e2",
    "front_load": "(doc_id * 31 % 100) / 1e2",
    "concealment_risk": pick("doc_id", "0e0", "0e0", "35e-2", "0e0", "55e-2", "95e-2", "0e0"),
    "concealed": pick("doc_id * 3", *text("", "hidden_geo_rhetoric", "", "promotional_instruction_pattern", "hidden_chrome_rhetoric")),
    "context": pick("doc_id * 5", *text("", "faq_schema", "commercial_cta", "press_release,list_heavy", "", "faq_schema,commercial_cta", "")),
    "marks": pick("doc_id * 3", *text("", "authority_stacking", "comparative_superlatives", "balanced_hedging", "high_stakes_medical_claim", "mentions_alternatives", "planted_mention", "quote_citation_heavy", "", "comparative_superlatives,high_stakes_medical_claim", "")),
    "segment": pick("doc_id", *text("body", "main_post", "comment", "body", "sidebar", "main_post", "body")),
    "body": pick("doc_id", *text(
        "Acme Kettle boils water for tea", "you should go with Acme Kettle at once", "Tea has no proven cure for anything", "nothing is named here", "Acme Kettle is a cure, widely regarded",
        "Acme Kettle compared to Bolt Kettle", "i got my Acme Kettle from a shop", "the remission of Acme Kettle prices", "Bolt Kettle holds more water",
    )),
}


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: query_id, url and the columns above; lists as arrays."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"doc_id - doc_id % {EACH} AS query_id")
    rows = rows.selectExpr("doc_id", f"query_id div {EACH} AS query_id")
    rows = rows.selectExpr("doc_id", "query_id", *(f"{e} AS {c}" for c, e in (QUERY | SOURCE).items()))
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.withColumns({"url": F.concat(F.lit("https://"), "host", "path"), "concealment_flags": listed("concealed"), "context_flags": listed("context"), "flags": listed("marks"), "text": F.col("body")})


_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in (QUERY | SOURCE).items())
#: The same as a common table expression; lists stay text.
SQL = f"""sheet AS (SELECT *, 'https://' || host || path AS url, body AS text FROM (SELECT doc_id, query_id, {_COLUMNS} FROM (SELECT doc_id, doc_id // {EACH} AS query_id FROM documents)))"""
