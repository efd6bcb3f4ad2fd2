"""Pages that share a url."""

from sourcelens.operators import graph, pages
from sourcelens.sources import html

WORDS = "one two three four five six seven eight nine"


def parsed(spark):
    page = lambda n: f'<article>{WORDS} {n}</article><a href="https://other.com/x">to</a><footer>{WORDS}{" more" * n}</footer>'
    rows = spark.createDataFrame([(n, "https://a.com/p", page(n)) for n in (1, 2)] + [(3, "https://a.com/q", page(3))], "page_id long, url string, html string")
    return html.parse_pages(rows, keep=("page_id",))


def test_each_page_has_its_links(spark):
    edges = graph.link_edges(html.page_links(parsed(spark), "page_id"), "page_id").collect()
    assert sorted((e.page_id, e.source_url) for e in edges) == [(1, "https://a.com/p"), (2, "https://a.com/p"), (3, "https://a.com/q")]


def test_no_two_chunks_share_a_name(spark):
    got = sorted((c.url[-1], c.chunk_id) for c in pages.segment_chunks(parsed(spark), "page_id").collect())
    assert got == [("p", "footer__footer_2_p0"), ("p", "footer__footer_3_p0"), ("p", "main_post__main_post_0_p0"), ("p", "main_post__main_post_1_p0"), ("q", "footer__footer_1_p0"), ("q", "main_post__main_post_0_p0")]
