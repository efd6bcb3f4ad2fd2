"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage reads whole texts of any length, carries all columns of documents along whatever their names, and takes an
empty table for an empty result. What it makes of nulls, empty texts and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelens.llm import benchmark, common, lines, near_documents, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts, and every document where labels teach nothing, score least and stay; repeated rows fare alike.
    """
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each set of similar lines the first stays; documents without any text left go.

    Null texts and blank lines stay as they are. Rows that share a doc_id, or have none, are documents of their own in
    order of their texts, so of equal rows one keeps its lines and the others go.
    """
    return lines.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more one stays, that with the least doc_id.

    A null doc_id comes first. Null, empty and blank texts are alike, so one of them stays; of equal rows one stays.
    """
    return near_documents.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths or more of a benchmark item's shingles go.

    Null and empty texts contain nothing. Each row is judged by its own text, so rows of equal text fare alike and those
    that share a doc_id, or have none, need not.
    """
    return benchmark.clean_of(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens: a row for each piece.

    Null and empty texts are the end token alone; repeated rows are packed each on their own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL has no tokenizer and no such classifier; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
