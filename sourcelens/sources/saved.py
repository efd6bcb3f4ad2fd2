"""Pages saved in a folder, one file a page, named after its address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.sources import html


def saved_pages(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """url, html, status_code of each url (once): its saved copy and 200, or nulls where no file of its names holds anything.

    folder: on any store that Spark reads. A file's name is the join key, so an address is never looked up file by file;
    of the names under which a copy may lie the likelier one counts. Bytes that are no UTF-8 are replaced.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("html")).where(F.col("html").rlike(r"\S"))
    own = urls.select(F.col("url").cast("string").alias("url")).distinct()
    names = own.select("url", F.posexplode(U.saved_names(F.col("url"))).alias("place", "name"))
    copies = names.join(files, "name").groupBy("url").agg(F.min_by("html", "place").alias("html"))
    return own.join(copies, "url", "left").withColumn("status_code", F.when(F.col("html").isNotNull(), 200))


def fetched(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """Parsed pages with how their fetch went, from saved copies: a page without one failed, links of the others are taken to work."""
    pages = saved_pages(spark, folder, urls)
    outcomes = pages.select("url", "status_code", F.when(F.col("status_code").isNotNull(), 0.0).alias("broken_link_ratio"), F.lit("fixture").alias("fetch_engine"))
    return html.fetched(html.parse_pages(pages), outcomes)
