"""Tables the queries read, in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def citation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, ts, domain: an event cites its type's domain for its user's query."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), "ts", F.col("event_type").alias("domain"))


def answer_log(path_or_df: DataFrame) -> DataFrame:
    """Rows of an append-only answer log with ordered distinct URLs and domains taken from the text where they are missing."""
    url = F.regexp_extract_all("text", F.lit(r"(https?://[^\s\])>\"']+)"), F.lit(1))
    urls = F.array_distinct(F.coalesce("cited_urls", url))
    domain = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    return path_or_df.withColumn("cited_urls", urls).withColumn("cited_domains", F.array_distinct(F.filter(F.coalesce("cited_domains", F.transform(urls, domain)), lambda d: d != "")))


ANSWER_SCHEMA = "run_id string, timestamp string, engine string, query string, paraphrase_of string, text string, cited_domains array<string>, cited_urls array<string>"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines answer log, with line, which grows with the place in a file; lines that don't parse come back as nulls and are dropped."""
    rows = spark.read.schema(ANSWER_SCHEMA).json(path).withColumn("line", F.monotonically_increasing_id())
    return answer_log(rows.where("query is not null"))


def append_answers(records: DataFrame, path: str) -> None:
    """Add records to an append-only JSON-lines log."""
    records.select(*(c.split()[0] for c in ANSWER_SCHEMA.split(", "))).write.mode("append").json(path)


def records(responses: DataFrame, run_id: str, engine: str, at) -> DataFrame:
    """Log records of an engine's responses. responses: query, paraphrase_of, text, cited_urls (null: those of the text)."""
    own = responses.select(F.lit(run_id).alias("run_id"), F.lit(at).cast("string").alias("timestamp"), F.lit(engine).alias("engine"), "query", "paraphrase_of", "text", F.lit(None).cast("array<string>").alias("cited_domains"), "cited_urls")
    return answer_log(own)


CITATIONS = "output array<struct<content array<struct<annotations array<struct<type string, url string>>>>>>, grounding array<struct<url string>>"


def split_citations(responses: DataFrame) -> DataFrame:
    """Adds cited_urls, which an answer names, and pool_urls, which it could draw on, from an engine's raw JSON; each in order and once."""
    raw = F.from_json("raw", CITATIONS)
    notes = F.flatten(F.transform(F.flatten(F.transform(raw["output"], lambda o: F.coalesce(o["content"], F.array()))), lambda c: F.coalesce(c["annotations"], F.array())))
    kept = lambda urls: F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != ""))
    named = F.transform(F.filter(notes, lambda n: n["type"] == "url_citation"), lambda n: n["url"])
    return responses.withColumns({"cited_urls": kept(named), "pool_urls": kept(F.transform(raw["grounding"], lambda g: g["url"]))})


def replay(queries: DataFrame, answers: DataFrame, default_text: str = "") -> DataFrame:
    """Each query with its last replayed answer, by line, else by timestamp; queries without one get the default text and no citations."""
    order = F.col("line") if "line" in answers.columns else F.coalesce("timestamp", F.lit(""))
    last = answers.groupBy("query").agg(F.max_by(F.struct("text", "cited_urls", "cited_domains"), order).alias("a"))
    none = F.array().cast("array<string>")
    return queries.join(last, "query", "left").select("query", F.coalesce("a.text", F.lit(default_text)).alias("text"), F.coalesce("a.cited_urls", none).alias("cited_urls"), F.coalesce("a.cited_domains", none).alias("cited_domains"))


# What a registry calls a creation date, and in which formats it writes it.
CREATED = [r"creation date", r"created(?: on)?", r"registered(?: on)?"]
DATES = [(r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"), (r"\d\d-[A-Za-z]{3}-\d{4}", "dd-MMM-yyyy"), (r"\d{4}\.\d\d\.\d\d", "yyyy.MM.dd"), (r"\d{4}/\d\d/\d\d", "yyyy/MM/dd"), (r"\d\d\.\d\d\.\d{4}", "dd.MM.yyyy")]


def whois_age_days(whois: DataFrame, as_of) -> DataFrame:
    """host, whois_age_days from raw registry texts (host, raw): the creation date in the block that names the host's own apex.

    What a registrar or a top-level domain says of itself before that block doesn't count; without the block the age is unknown.
    """
    named = F.concat(F.lit(r"(?is)domain name:\s*\Q"), U.apex(U.bare_host(F.col("host"))), F.lit(r"\E\b.*"))
    block = F.regexp_substr("raw", named)
    lines = [F.regexp_extract(block, rf"(?im)^\s*{word}\s*:\s*(\S+(?: \S+)?)", 1) for word in CREATED]
    made = F.coalesce(*(F.try_to_timestamp(F.regexp_extract(line, p, 0), F.lit(f)) for line in lines for p, f in DATES))
    return whois.select("host", F.datediff(F.lit(as_of).cast("date"), made).alias("whois_age_days"))
