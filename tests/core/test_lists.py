"""Markers and hosts against tables of them, JSON-LD, segments and placed names on hand-written rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import hosts, pages, plants, ties
from sourcelens.sources import html, saved


@pytest.mark.parametrize("shard_chars", [40, 1 << 20])
def test_ties_are_those_of_every_pair(spark, shard_chars):
    targets = [(1, "https://www.theograce.com/p/necklace/", "Theo Grace - Name Necklace", "Theo Grace", ["tg jewels"]), (2, "https://acme.co.uk/kettle", "Acme Kettle", "", []), (3, "https://bolt.com/", "Bolt", "Bolt Works", None), (4, "https://dup.com/kettle", "Acme Kettle", "", [])]
    blobs = [(10, "see HTTPS://www.theograce.com/p/necklace today"), (11, "at theograce.com there is a p/necklace"), (12, "a name necklace"), (13, "acme kettle and theo grace and bolt works"), (14, "www.acme.co.uk/kettle"), (15, None), (16, ""), (17, "kettle"), (18, "boltworks acmekettle")]
    table = spark.createDataFrame(targets, "target_id long, url string, entity string, org string, aliases array<string>")
    got = {(r.page_id, r.target_id): (r.kind, r.confidence, r.marker) for r in ties.ties(spark, spark.createDataFrame(blobs, "page_id long, blob string"), table, shard_chars).collect()}
    pairs = spark.createDataFrame(blobs, "page_id long, blob string").crossJoin(table)
    one = pairs.withColumn("t", U.connection(F.lower(F.coalesce("blob", F.lit(""))), F.col("url"), U.markers(F.col("url"), F.col("entity"), F.col("org"), F.col("aliases")))).where("t is not null")
    assert got == {(r.page_id, r.target_id): tuple(r.t) for r in one.collect()}
    assert got[10, 1] == ("url_link", "high", "https://www.theograce.com/p/necklace") and got[13, 2][0] == "brand_mention" and (13, 4) in got and (17, 2) not in got
    best = {r.target_id: r.page_id for r in ties.promoters(ties.ties(spark, spark.createDataFrame(blobs, "page_id long, blob string"), table), 1).collect()}
    assert best[1] == 10
    assert ties.ties(spark, spark.createDataFrame([], "page_id long, blob string"), table).count() == 0
    assert ties.ties(spark, spark.createDataFrame(blobs, "page_id long, blob string"), table.limit(0)).count() == 0


def test_hosts_meet_the_longest_entry(spark):
    rows = spark.createDataFrame([(h,) for h in ("www.News.example.com:8080", "example.com", "notexample.com", "a.b.go.com", "abcnews.go.com", "", None, "com", "x.co.uk", "co.uk", "shop.acme.co.uk.")], "host string")
    listed = spark.createDataFrame([(e,) for e in ("example.com", "news.example.com", "abcnews.go.com", "", None, "WWW.Example.com")], "entry string")
    got = {r.host: r.news for r in hosts.meets(rows, "host", listed, "news").collect()}
    assert got == {"www.News.example.com:8080": "news.example.com", "example.com": "example.com", "notexample.com": None, "a.b.go.com": None, "abcnews.go.com": "abcnews.go.com", "": None, None: None, "com": None, "x.co.uk": None, "co.uk": None, "shop.acme.co.uk.": None}
    domain = {r.host: r.domain for r in hosts.registrable(rows, "host", spark.createDataFrame([("co.uk",)], "entry string")).collect()}
    assert domain["www.News.example.com:8080"] == "example.com" and domain["x.co.uk"] == "x.co.uk" and domain["shop.acme.co.uk."] == "acme.co.uk" and domain["co.uk"] == "co.uk" and domain["com"] == "com" and domain[""] == ""
    profiles = spark.createDataFrame([(1, "https://x.com/a"), (1, "https://m.x.com/b"), (1, "http://other.org"), (1, "nothing"), (2, "")], "node_id int, url string")
    assert [tuple(r) for r in hosts.counted(profiles, spark.createDataFrame([("x.com",)], "entry string")).collect()] == [(1, 3, 3, 2)]


def ld(*nodes):
    return "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes)


def parsed(spark, **by):
    table = spark.createDataFrame([(f"https://site.com/{k.replace('__', '/')}", v) for k, v in by.items()], "url string, html string")
    return {r.url.removeprefix("https://site.com/").replace("/", "__"): r for r in html.parse_pages(table).collect()}


def test_names_come_from_nodes_that_speak_for_the_page(spark):
    product = {"@type": "Product", "name": "Steam Kettle", "brand": {"@type": "Brand", "name": "Acme"}, "review": {"@type": "Review", "author": {"@type": "Organization", "name": "Review House"}}}
    made = {"@type": "Product", "name": "Steam Kettle", "manufacturer": {"@type": "Organization", "legalName": "Bolt Ltd", "name": "Bolt Works"}, "author": {"@type": "Organization", "name": "Writer"}}
    got = parsed(
        spark, product=ld(product), made=ld(made), graph=ld({"@context": "x", "@graph": [{"@type": ["Organization", "Thing"], "name": "Graph House"}, {"@type": "Article", "publisher": "Daily"}]}),
        plain=ld({"@type": "Product", "name": "K" * 90, "brand": "Acme"}), listed=ld({"@type": "Article", "brand": ["Acme"], "provider": {"legalName": "Provider Ltd"}}), metas='<meta property="og:site_name" content="Site House"><meta name="product:brand" content="Meta Brand">', broken=ld("{not json", "[]", "3"), nothing="",
    )
    name = lambda k: (got[k].named.organization, got[k].named.brand, got[k].named.product)
    assert name("product") == ("", "Acme", "Steam Kettle")
    assert name("made") == ("Bolt Works", "Bolt Works", "Steam Kettle")
    assert name("graph") == ("Graph House", "Graph House", "")
    assert name("plain") == ("", "Acme", "") and name("listed") == ("Provider Ltd", "", "")
    assert (got["metas"].named.site_name, got["metas"].named.brand) == ("Site House", "Meta Brand")
    assert name("broken") == name("nothing") == ("", "", "") and got["nothing"].ld_nodes == []


def test_nodes_that_claim(spark):
    how = {"@type": "HowTo", "name": "How to boil water", "step": [{"@type": "HowToStep", "text": "Fill the kettle first"}, "then wait"], "description": "short"}
    asked = {"@type": "https://schema.org/FAQPage", "mainEntity": [{"@type": "Question", "name": "why", "acceptedAnswer": {"text": "Because  it\nboils"}, "suggestedAnswer": ["Or so", {"name": "maybe"}]}]}
    rated = {"@type": "Product", "aggregateRating": {"ratingValue": " 4.9 ", "reviewCount": "1,200"}, "review": [{"@type": "Review", "reviewBody": "good  one"}], "sameAs": ["https://x.com/a", " ", 3]}
    got = parsed(spark, how=ld(how), asked=ld(asked), rated=ld(rated), own=ld({"@type": "AggregateRating", "ratingValue": 5, "ratingCount": 10**12}))
    assert got["how"].ld_nodes[0].chunks == ["How to boil water", "then wait", "Fill the kettle first"] and got["how"].ld_types[0] == "HowTo"
    assert [n.types for n in got["asked"].ld_nodes][:2] == [["FAQPage"], ["Question"]] and got["asked"].ld_nodes[1].chunks == ["Because it boils", "Or so", "maybe"]
    node = got["rated"].ld_nodes[0]
    assert (node.rating, node.votes, node.same_as) == (4.9, 1200, ["https://x.com/a", "3"]) and [n.review for n in got["rated"].ld_nodes] == ["", "", "good one"]
    assert (got["own"].ld_nodes[0].rating, got["own"].ld_nodes[0].votes) == (5.0, None)


POST = "these are more than eight words of one post that somebody wrote here"


def test_segments_of_threads_and_articles(spark):
    div = lambda kind, text: f'<div class="{kind}">{text} {POST}</div>'
    got = parsed(
        spark, threads__a=div("post", "first") + div("comment", "second") + div("comment reply", "third") + "<div class='comment'>too short</div>" + "<aside>" + POST + "</aside>" * 1,
        threads__b=f"<article>one {POST}{div('comment', 'inside')}</article><article>two {POST}</article><main>three {POST}</main>", page=f"<article>one {POST}</article><article>two {POST}</article>", main=f"<article>one {POST}</article><main>two {POST}</main>",
        asides="".join(f"<aside>{k} {POST}</aside>" for k in range(4)) + f"<footer>f {POST}</footer><footer>g {POST}</footer>", threads__c=div("x", "alone"),
    )
    told = lambda k: [(s.role, s.text.split()[0]) for s in got[k].segments]
    assert told("threads__a") == [("main_post", "first"), ("comment", "second"), ("nested_comment", "third"), ("sidebar", "these")]
    assert told("threads__b") == [("main_post", "one"), ("comment", "inside")] and "inside" in got["threads__b"].segments[0].text
    assert told("page") == [("main_post", "one")] and told("main") == [("main_post", "two")]
    assert told("asides") == [("sidebar", "0"), ("sidebar", "1"), ("footer", "f")] and told("threads__c") == []
    table = spark.createDataFrame([("https://site.com/threads/c", f"<p>First {POST}. Second {POST}. Short one. Third {POST}!</p>"), ("https://site.com/other", f"<p>First {POST}. Second {POST}.</p>")], "url string, html string")
    assert sorted((r.url[-5:], r.segment) for r in pages.segment_chunks(html.parse_pages(table)).collect()) == [("ads/c", "comment"), ("ads/c", "comment"), ("ads/c", "main_post"), ("other", "body")]


def test_whole_texts_where_asked_for(spark):
    long = "word " * 30_000
    table = spark.createDataFrame([("https://site.com/a", f"<article>{long}</article>")], "url string, html string")
    cut, whole = html.parse_pages(table).first(), html.parse_pages(table, None, None).first()
    assert (len(cut.text), len(cut.segments[0].text)) == (html.TEXT_MOST, html.SEGMENT_MOST) and len(whole.text) == len(whole.segments[0].text) == 149_999


def test_placed_names(spark):
    r = random.Random(5)
    far = " ".join(r.choice(["plain", "words", "stand", "here"]) for _ in range(40))
    rows = [
        ("we got it from Theo Grace last week", "Theo Grace", 2), ("theograce makes things", "Theo Grace", 1), ("the o grace", "theograce", 1), ("nothing", "Theo Grace", 0), (f"bought {far} theo-grace {far}", "Theo Grace", 1),
        (f"{far} my theo grace portfolio", "Theo Grace", 2), (f"theo grace {far} and then a purchase on", "Theo Grace", 1), ("anything", "", 0), (None, "x", 0), ("anything", None, 0), ("a.b (x) is with a.b", "a.b", 2), ("axb", "a.b", 0), ("ordered a lovely pair with my acme", "acme", 2), ("Theo\n grace", "theo grace", 1),
    ]
    table = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(rows)], "k int, text string, name string")
    got = {r.k: r.p for r in table.select("k", plants.name_placement(F.col("text"), F.col("name")).alias("p")).collect()}
    assert [got[k] for k in range(len(rows))] == [p for *_, p in rows]


def test_pages_from_a_folder(spark, tmp_path):
    body = "plain words of a page that is long enough to be more than a wall of any kind for readers " * 3
    page = f"<title>T</title><p>{body}</p>".encode()
    for name, content in {"site.com_a_b.html": page, "site.com_index.html": page, "other.com_.html": page, "bad.com_x.html": b"\xff" + page, "blank.com_x.html": b"  \n", "notes.txt": page}.items():
        (tmp_path / name).write_bytes(content)
    urls = ["https://www.site.com/a/b/", "https://site.com", "https://other.com/", "https://bad.com/x", "https://blank.com/x", "https://gone.com/", "https://site.com/a/b?q=1", None]
    table = spark.createDataFrame([(u,) for u in [*urls, urls[0]]], "url string")
    got = {r.url: (r.ok, r.status_code, r.error, r.broken_link_ratio) for r in saved.fetched(spark, str(tmp_path), table).collect()}
    fine, failed = (True, 200, None, 0.0), (False, None, "no response", 1.0)
    assert {u: got[u] for u in urls if u} == dict(zip(urls[:-1], [fine, fine, fine, fine, failed, failed, fine], strict=True))
