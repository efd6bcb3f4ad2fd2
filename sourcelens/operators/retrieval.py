"""Ranking of passages for many queries at once: sparse TF-IDF, position-adjusted visibility, one passage a host, and
what a defended score does to the ranking."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.operators import similarity

#: Query terms are few (the queries' own words); up to so many rows they are broadcast, beyond that joined by shuffle.
BROADCAST_TERMS = 500_000


#: What one task gets at most, about, whatever spark.sql.shuffle.partitions says: passages, bytes of text to split,
#: postings, and meetings of a query's term with a passage's, which are the more the more queries there are.
TASK_PASSAGES, TASK_BYTES, TASK_POSTINGS, TASK_MET = 8_000, 8 << 20, 1_000_000, 1_000_000


class Corpus(NamedTuple):
    """forward: doc_id, norm2, terms (term, tf, df; those alone that a query asks for). asked: query_id, term, qw, df. n: passages and one. n_asked: rows of asked. n_met: how often a passage has a query's term, of all pairs."""

    forward: DataFrame
    asked: DataFrame
    n: int
    n_asked: int
    n_met: int


def idf(n: int, df: Column) -> Column:
    return F.log(F.lit(1.0 + n) / (df + 1)) + 1


def _dealt(rows: DataFrame, *loads: tuple[int, int], by: str = "doc_id") -> DataFrame:
    """rows by doc_id, so that what is grouped by doc_id and more stays in its task. loads: how much there is, and how much of it a task gets."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, *(-(-n // each) for n, each in loads)), by)


def _counted(postings: DataFrame, df: DataFrame, n_postings: int) -> DataFrame:
    """postings (doc_id, term, tf) with df. df: term, df.

    Frequent terms are broadcast and meet postings where they are; what is left is joined by shuffle, and not at all if
    only terms of one passage are left: their df is known.
    """
    df = df.where("df > 1")
    power = F.floor(F.log2("df")).cast("int")
    least, room = 64, BROADCAST_TERMS
    for x in sorted(df.groupBy(power.alias("power")).count().collect(), reverse=True):
        if x["count"] > room:
            break
        least, room = x["power"], room - x["count"]
    else:
        least = 1
    out = postings.join(F.broadcast(df.where(power >= least)), "term", "left")
    if least > 1:
        rare = _dealt(out.where("df is null").drop("df"), (n_postings, TASK_POSTINGS), by="term").join(df.where(power < least), "term", "left")
        out = out.where("df is not null").unionByName(rare)
    return out.withColumn("df", F.coalesce("df", F.lit(1)))


def corpus(queries: DataFrame, passages: DataFrame) -> Corpus:
    """queries: query_id, text. passages: doc_id, text. A text is split into terms once.

    Texts travel to their doc_id's task, which counts its terms; postings are shuffled for the rarer terms alone.
    """
    n, n_bytes = passages.agg(F.count(F.lit(1)) + 1, F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    terms = _dealt(passages.select("doc_id", "text"), (n, TASK_PASSAGES), (n_bytes, TASK_BYTES)).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg((F.log(F.count(F.lit(1))) + 1).alias("tf"))
    terms = similarity.written(terms, "postings")
    df = similarity.written(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = asked.join(df, "term", "left").select("query_id", "term", ((F.log("qtf") + 1) * idf(n, F.coalesce("df", F.lit(0)) + 1)).alias("qw"), "df")
    asked = similarity.written(asked, "asked")
    n_asked, n_met = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    known = asked.where("df is not null").select("term", "df").distinct()
    own = terms.join(F.broadcast(known) if n_asked <= BROADCAST_TERMS else known, "term")
    weight = F.col("tf") * idf(n, F.col("df"))
    n_postings = terms.count()
    norms = _counted(terms, df, n_postings).groupBy("doc_id").agg(F.sum(weight * weight).alias("norm2"))
    forward = _dealt(own, (n, TASK_PASSAGES), (n_postings, TASK_POSTINGS)).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms")).join(norms, "doc_id")
    return Corpus(similarity.written(forward, "forward"), asked, n, n_asked, n_met)


def exploded(own: Corpus) -> DataFrame:
    """doc_id, norm2, term, tf, df: a passage's rows in one task."""
    return _dealt(own.forward, (own.n, TASK_PASSAGES), (own.n_met, TASK_MET)).select("doc_id", "norm2", F.explode("terms").alias("t")).select("doc_id", "norm2", "t.*")


def tfidf_scores(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id, score: cosines above zero of (1 + ln tf)(ln((1 + N) / (1 + df)) + 1) vectors.

    The query counts as one more document of its own corpus: its terms have a df one higher, and N is passages + 1. So
    a passage's norm depends on the query; it is the norm without the query, corrected at the terms they share.
    """
    own = corpus(queries, passages)
    few = F.broadcast if own.n_asked <= BROADCAST_TERMS else lambda rows: rows
    lengths = own.asked.groupBy("query_id").agg(F.sum(F.col("qw") * F.col("qw")).alias("qnorm2"))
    w1, w0 = F.col("tf") * idf(own.n, F.col("df") + 1), F.col("tf") * idf(own.n, F.col("df"))
    met = exploded(own).join(few(own.asked.drop("df")), "term").groupBy("query_id", "doc_id").agg(F.sum(w1 * F.col("qw")).alias("dot"), F.sum(w1 * w1 - w0 * w0).alias("more"), F.first("norm2").alias("norm2"))
    cosine = F.col("dot") / F.sqrt((F.col("norm2") + F.col("more")) * F.col("qnorm2"))
    return met.join(few(lengths), "query_id").select("query_id", "doc_id", F.round(cosine, 9).alias("score"))


def scoped_scores(queries: DataFrame, candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every candidate, zero without a shared term: each query's candidates are a corpus of their own.

    queries: query_id, text. candidates: query_id, doc_id. texts: doc_id, text, one row each. Frequencies, numbers of
    documents and norms are by query (which counts as one document more), so one text has other weights for each. A
    text is split into terms once, however many queries it is a candidate of.
    """
    postings = texts.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg((F.log(F.count(F.lit(1))) + 1).alias("tf"))
    own = similarity.written(candidates.select("query_id", "doc_id").distinct().join(similarity.written(postings, "postings"), "doc_id"), "scoped")
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg((F.log(F.count(F.lit(1))) + 1).alias("qtf"))
    size = candidates.groupBy("query_id").agg((F.count_distinct("doc_id") + 1).alias("n"))
    df = own.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    both = df.join(asked, ["query_id", "term"], "full").join(size, "query_id")
    idf = F.log((1.0 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)) + F.col("qtf").isNotNull().cast("int"))) + 1
    both = similarity.written(both.select("query_id", "term", idf.alias("idf"), (F.col("qtf") * idf).alias("qw")), "weights")
    lengths = both.groupBy("query_id").agg(F.sum(F.col("qw") * F.col("qw")).alias("qnorm2"))
    w = F.col("tf") * F.col("idf")
    met = own.join(both, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(w * F.col("qw")).alias("dot"), F.sum(w * w).alias("norm2"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("norm2") * F.col("qnorm2"))), F.lit(0.0))
    every = candidates.select("query_id", "doc_id").distinct().join(met, ["query_id", "doc_id"], "left").join(lengths, "query_id", "left")
    return every.select("query_id", "doc_id", F.round(cosine, 9).alias("score"))


def varied_scores(queries: DataFrame, others: DataFrame, variants: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, method, doc_id, score: scoped_scores() of many corpora that differ in one document's passages alone.

    queries: query_id, text. others: query_id, doc_id, the passages that all of a query's corpora have. variants:
    query_id, method, doc_id, the passages that one method's corpus has besides. texts: doc_id, text.

    The weight of a term is L - g, L by the corpus's size and g by the term's frequency. Sums of tf, tf g and tf g g over
    a passage give its norm and product for any L; they are made once, for frequencies without any variant, and a
    method corrects them at the terms of its own passages that a query's other passages or words have. So what the
    others cost doesn't grow with the number of methods but for those corrections.
    """
    postings = texts.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg((F.log(F.count(F.lit(1))) + 1).alias("tf"))
    postings = similarity.written(postings, "postings")
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg((F.log(F.count(F.lit(1))) + 1).alias("qtf"))
    base = others.select("query_id", "doc_id").distinct().join(postings, "doc_id")
    # the query is one more document: both what it counts in frequencies and a row whose norm is the query's own
    rows = base.join(asked, ["query_id", "term"], "left").unionByName(asked.select("query_id", "term", F.lit(None).cast("string").alias("doc_id"), F.col("qtf").alias("tf"), "qtf"))
    df = rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = similarity.written(rows.join(df, ["query_id", "term"]).withColumn("g", F.log(1.0 + F.col("df"))), "base")
    square, product = F.col("tf") * F.col("tf"), F.col("tf") * F.coalesce("qtf", F.lit(0.0))
    powers = lambda w, g, name: [F.sum(w).alias(f"{name}0"), F.sum(w * g).alias(f"{name}1"), F.sum(w * g * g).alias(f"{name}2")]
    sums = rows.groupBy("query_id", "doc_id").agg(*powers(square, F.col("g"), "n"), *powers(product, F.col("g"), "d"))

    own = similarity.written(variants.select("query_id", "method", "doc_id").distinct().join(postings, "doc_id"), "variants")
    more = similarity.written(own.groupBy("query_id", "method", "term").agg(F.count(F.lit(1)).alias("more")), "more")
    size = others.groupBy("query_id").agg((F.count_distinct("doc_id") + 1).alias("n"))
    sizes = variants.groupBy("query_id", "method").agg(F.count_distinct("doc_id").alias("m")).join(size, "query_id", "left")
    sizes = sizes.select("query_id", "method", (F.log(1.0 + F.col("m") + F.coalesce("n", F.lit(1))) + 1).alias("L"))
    changed = rows.join(more, ["query_id", "term"]).withColumn("h", F.log(1.0 + F.col("df") + F.col("more")))
    by = lambda w: [F.sum(w * (F.col("h") - F.col("g"))), F.sum(w * (F.col("h") * F.col("h") - F.col("g") * F.col("g")))]
    shift = changed.groupBy("query_id", "method", "doc_id").agg(*(c.alias(n) for c, n in zip([*by(square), *by(product)], ("sn1", "sn2", "sd1", "sd2"), strict=True)))
    both = sums.join(sizes, "query_id").alias("a").join(shift.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.method") == F.col("b.method")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    z = lambda c: F.coalesce(f"b.{c}", F.lit(0.0))
    at = lambda name: F.col(f"{name}0") * F.col("L") * F.col("L") - 2 * F.col("L") * (F.col(f"{name}1") + z(f"s{name}1")) + F.col(f"{name}2") + z(f"s{name}2")
    told = both.select("a.query_id", "a.method", "a.doc_id", at("n").alias("norm2"), at("d").alias("dot"))

    idf = F.col("L") - F.log(1.0 + F.coalesce("df", F.lit(0)) + F.col("more"))
    fresh = own.join(more, ["query_id", "method", "term"]).join(df, ["query_id", "term"], "left").join(asked, ["query_id", "term"], "left").join(sizes, ["query_id", "method"])
    fresh = fresh.withColumn("idf", idf).groupBy("query_id", "method", "doc_id").agg(F.sum(square * F.col("idf") * F.col("idf")).alias("norm2"), F.sum(product * F.col("idf") * F.col("idf")).alias("dot"))
    every = others.select("query_id", "doc_id").distinct().join(sizes.select("query_id", "method"), "query_id").unionByName(variants.select("query_id", "method", "doc_id").distinct())
    told = similarity.written(told.unionByName(fresh), "varied")
    lengths = told.where("doc_id is null").select("query_id", "method", F.col("norm2").alias("qnorm2"))
    out = every.join(told, ["query_id", "method", "doc_id"], "left").join(lengths, ["query_id", "method"], "left")
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("norm2") * F.col("qnorm2"))), F.lit(0.0))
    return out.select("query_id", "method", "doc_id", F.round(cosine, 9).alias("score"))


def top(scores: DataFrame, k: int, by: str = "score", name: str = "rank") -> DataFrame:
    """The k best of each query, ties by doc_id; Spark keeps k rows of a query in each task before it shuffles."""
    order = W.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def position_weight(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, C.POSITION_WEIGHTS)), rank - 1), F.lit(C.LATER_WEIGHT))


def visibility(ranked: DataFrame) -> DataFrame:
    """query_id, host, share in percent. ranked: query_id, rank, host, n_words."""
    own = ranked.withColumn("part", position_weight(F.col("rank")) * F.col("n_words"))
    by_host = own.groupBy("query_id", "host").agg(F.sum("part").alias("part"))
    total = F.sum("part").over(W.partitionBy("query_id"))
    return by_host.select("query_id", "host", F.round(F.try_divide(F.col("part") * 100, total), 6).alias("share"))


def dominance(shares: DataFrame, alert: float = C.DOMINANCE_ALERT) -> DataFrame:
    """query_id, host with the largest share (ties by name), its share, alert."""
    best = shares.where("share is not null").groupBy("query_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "host")).alias("m"))
    return best.select("query_id", F.col("m.host").alias("dominant_host"), (-F.col("m.s")).alias("dominant_share"), (-F.col("m.s") / 100 >= alert).alias("alert"))


def diversify(scores: DataFrame, k: int) -> DataFrame:
    """First the best passage of each host by score, then, if hosts are too few, the others by score: k places."""
    per_host = W.partitionBy("query_id", "host").orderBy(F.desc("score"), "doc_id")
    few = scores.withColumn("n", F.row_number().over(per_host)).where(F.col("n") <= k)
    order = W.partitionBy("query_id").orderBy((F.col("n") > 1), F.desc("score"), "doc_id")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("n")


def defended(scores: DataFrame) -> DataFrame:
    """Adds defended: score x (1 - L1) x (1 - L2). scores has rhetorical, retrieval_risk, trust and n_words."""
    l1 = F.least(F.lit(0.85), 0.5 * F.col("rhetorical") + 0.35 * F.col("retrieval_risk"))
    trust = F.greatest(F.lit(0.05), F.col("trust") * (1 - F.least(F.lit(0.25), 0.35 * F.col("rhetorical"))))
    l2 = F.least(F.lit(0.85), (1 - trust) * 0.45 + F.when(F.col("n_words") < C.THIN_WORDS, 0.05).otherwise(0.0))
    return scores.withColumn("defended", F.round(F.col("score") * (1 - l1) * (1 - l2), 9))


def rank_changes(scores: DataFrame, k: int) -> DataFrame:
    """Full outer join of the baseline's and the defended top k: query_id, doc_id, baseline_rank, defended_rank, status."""
    a = top(scores, k, "score", "baseline_rank").select("query_id", "doc_id", "baseline_rank")
    b = top(scores, k, "defended", "defended_rank").select("query_id", "doc_id", "defended_rank")
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    status = F.when(F.col("defended_rank").isNull(), "excluded").when(F.col("baseline_rank").isNull(), "admitted").when(F.col("defended_rank") < F.col("baseline_rank"), "raised").when(F.col("defended_rank") > F.col("baseline_rank"), "lowered").otherwise("same")
    return both.withColumn("status", status)


def chunk_scores(rows: DataFrame) -> DataFrame:
    """Chunks that may be retrieved, with chunk_trust, l1, l2 and defended: a chunk's score after all that speaks against it.

    rows: score, segment, role, intent, trust, rhetorical, front_load, comparative, authority, mismatch, ok, n_words (of the
    source) and retrieve_permission. Rejected chunks go, deferred ones too unless their score is high.
    """
    from sourcelens.operators import pages, signals

    segment, role, intent, rhet = F.col("segment"), F.col("role"), F.col("intent"), F.col("rhetorical")
    info, open_part = intent.startswith("informational"), segment.isin("comment", "nested_comment", "sidebar", "footer")
    comment = segment.isin("comment", "nested_comment")
    cap = lambda x: F.least(F.lit(0.85), x)
    trust = F.greatest(F.lit(0.05), F.least("trust", pages.trust_ceiling(segment, role)) * (1 - F.least(F.lit(0.25), rhet * 0.35)))
    style = cap(rhet * 0.5 * F.when(info, 1.0).otherwise(0.8) + signals.retrieval_manipulation(rhet) * 0.35)
    l1 = F.when(intent.isin("commercial", "navigational") & ~open_part, 0.0).otherwise(style)
    l1 = F.when(info, cap(l1 + F.col("mismatch") * 0.3)).otherwise(l1)
    l1 = F.when(comment, cap(l1 + F.when(intent == "commercial", 0.3).otherwise(0.15))).otherwise(l1)
    l1 = F.when((role == "ugc_thread") & (comment | (segment == "sidebar")), cap(l1 + 0.12)).otherwise(l1)
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    l2 = cap((1 - F.col("chunk_trust")) * 0.45 + add(F.col("ok") & (F.col("n_words") < C.THIN_WORDS), 0.05) + add(~F.col("ok"), 0.35) + add(F.col("retrieve_permission") == "downrank", 0.25))
    kept = rows.where((F.col("retrieve_permission") != "reject") & ((F.col("retrieve_permission") != "defer") | (F.col("score") >= 0.35)))
    out = kept.withColumn("chunk_trust", trust).withColumns({"l1": l1, "l2": l2})
    return out.withColumn("defended", F.round(F.col("score") * (1 - F.col("l1")) * (1 - F.col("l2")) * pages.retrieval_multiplier(segment, role, intent), 9))


def reranked(scored: DataFrame, k: int, risky: float = 0.55, penalty: float = 0.45, sources: DataFrame | None = None) -> DataFrame:
    """The k places of each query by defended score, one host first; where one host dominates what is seen and is not trusted, its scores fall and places are dealt anew.

    scored: query_id, doc_id, host, defended, trust, n_words. All scored rows take part in the second round.
    sources: query_id, host, trust of all of a query's sources, also of those with nothing scored.
    """
    ranked = lambda rows: diversify(rows.withColumn("score", F.col("defended")), k)
    seen = dominance(visibility(ranked(scored).withColumn("rank", F.col("place")))).where("alert")
    least = (scored if sources is None else sources).groupBy("query_id", "host").agg(F.min("trust").alias("least"))
    bad = seen.join(least, (seen["query_id"] == least["query_id"]) & (seen["dominant_host"] == least["host"])).where(F.col("least") < risky).select(seen["query_id"], "host", F.lit(1 - penalty).alias("_by"))
    again = scored.join(bad, ["query_id", "host"], "left").withColumn("defended", F.round(F.col("defended") * F.coalesce("_by", F.lit(1.0)), 9)).drop("_by")
    return ranked(again)


def exclusion_reasons(rows: DataFrame) -> Column:
    """Why a passage lost its place. rows: baseline_rank, defended_rank, retrieve_permission, commercial_tier, coordinated."""
    gone = F.col("baseline_rank").isNotNull() & F.col("defended_rank").isNull()
    told = (
        (gone & (F.col("retrieve_permission") == "downrank"), "low_trust_or_manipulation_risk"), (gone & F.col("commercial_tier").isin("medium", "high"), "commercial_influence"), (gone & F.col("coordinated"), "coordinated_cluster"),
        (gone, "defense_rerank_excluded"), (F.col("defended_rank") > F.col("baseline_rank"), "downranked_by_defense"),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in told)))


def by_url(ranked: DataFrame) -> DataFrame:
    """query_id, url, rank (its best place) and share of what is seen, in percent. ranked: query_id, url, rank, n_words."""
    shares = visibility(ranked.withColumn("host", F.col("url"))).withColumnRenamed("host", "url")
    return ranked.groupBy("query_id", "url").agg(F.min("rank").alias("rank")).join(shares, ["query_id", "url"])
