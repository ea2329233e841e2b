"""What the given tables do not show: verdicts that travel along links, small sites, unspaced scripts, rare languages."""

import numpy as np
from pyspark.sql import functions as F

from evidencelake.llm import language_id, line_dedup, url_graph
from evidencelake.llm.queries import tokenizer_file
from tests.llm.test_brute_force import ROOT

URLS = [*(f"http://good.org/{i}" for i in range(4)), *(f"http://bad.net/{i}" for i in range(4)), "http://fan.com/1", "http://shop.fan.com/1", "http://plain.com/1"]


def verdicts(spark, links: dict[str, str]):
    rows = [(i, u, f"<a href='{links[u]}'>x</a>" if u in links else "<p>x</p>") for i, u in enumerate(URLS)]
    judged = url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), (("allow", "good.org/"), ("block", "bad.net/")))
    return {r.host: r.verdict for r in judged.collect()}


def test_verdicts_change_through_edges(spark):
    alone = verdicts(spark, {})
    assert alone == {"good.org": "allow", "bad.net": "block", "fan.com": "allow", "shop.fan.com": "allow", "plain.com": "allow"}
    linked = verdicts(spark, {"http://fan.com/1": "http://bad.net/0"})
    assert linked == alone | {"fan.com": "block", "shop.fan.com": "block"}  # backwards over the link, then to the host below


def test_parents_without_pages_connect_the_hosts_of_a_site(spark):
    urls = ["http://a.site.com/bad/1", "http://b.site.com/1", "http://c.d.site.com/1", "http://other.com/1", "http://10.0.0.1/1", "http://10.0.0.2:80/1", "http://" + "x." * 200 + "site.com/1", "http://a..com/", None]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.host: r for r in url_graph.judge_urls(pages, (("block", "a.site.com/bad/"),)).collect()}
    reached = {h for h, r in got.items() if r.distrust > 0}
    assert reached == {"a.site.com", "b.site.com", "c.d.site.com"}
    assert got["a.site.com"].distrust > got["b.site.com"].distrust > got["c.d.site.com"].distrust and len(got) == len(urls)


def test_given_pages_are_connected_by_site(spark):
    """Their links are relative, so all edges are between hosts and the parents that have no pages."""
    pages = spark.read.parquet(f"{ROOT}/pages.parquet").select(line_dedup.host_of(F.col("url")).alias("host"), F.regexp_extract_all("html", F.lit(url_graph.LINK), F.lit(1)).alias("links"))
    edges = {(r.src, r.dst) for r in url_graph.host_edges(pages).collect()}
    hosts = {r.host for r in pages.filter("host <> ''").distinct().collect()}
    above = {h.split(".", i)[i] for h in hosts for i in range(1, h.count("."))}
    assert edges == {e for h in hosts | above if "." in (p := h.split(".", 1)[1]) for e in ((h, p), (p, h))} and {"example.com", "example.net", "example.org"} <= above - hosts


def dropped(spark, pages: int, **options) -> int:
    """Lines dropped from a site of so many pages: of a navigation line on all its pages and one of each page's own."""
    rows = [(f"s{pages}", f"nav\nown {i}") for i in range(pages)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "host string, body string"), F.col("host"), line_dedup.text_lines(F.col("body")), **options).collect()
    assert all(r.text == (f"own {r.body[-1]}" if r.n_dropped else r.body) for r in got)
    return sum(r.n_dropped for r in got)


def test_small_sites_lose_their_boilerplate(spark):
    assert [dropped(spark, n) for n in (1, 2, 9, 10)] == [0, 2, 9, 10]
    assert [dropped(spark, n, min_pages=10) for n in (9, 10)] == [0, 10]


def test_expected_counts_of_long_words():
    pieces = language_id.pieces_of(tokenizer_file("piece_bpe_32k.model"))
    probs, out = np.full((pieces.unknown + 1, 2), 1e-9), np.zeros((pieces.unknown + 1, 2))
    cuts = pieces.cuts(["▁" + "zq" * 300])
    language_id.expected(cuts, probs, np.full((1, 2), 3.0), out)
    lengths = np.array([len(n) for n in pieces.names] + [1])
    assert np.allclose((out * lengths[:, None]).sum(axis=0), 3 * 601)  # each segmentation covers all characters


def test_stretches():
    assert language_id.stretches("word", 32) == ["▁word"] and language_id.stretches("x" * 32, 32) == ["▁" + "x" * 32]
    for n in (33, 64, 65, 1000):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        parts = language_id.stretches(word, 32)
        assert "".join(parts) == "▁" + word and max(map(len, parts)) <= 33 and min(map(len, parts)) >= 16


def test_unspaced_script_is_learned(spark):
    """Runs of 60 characters, none of 32 or fewer."""
    zh = ["".join(chr(0x4E00 + (i * 7 + j * j) % 500) for j in range(60)) for i in range(20)]
    en = ["the cat sat on the mat and looked at the dog", "a house by the river with a green door"] * 5
    labelled = spark.createDataFrame([("zh", t) for t in zh] + [("en", t) for t in en], "lang string, text string")
    file = tokenizer_file("piece_bpe_32k.model")
    langs, probs = language_id.fit(labelled, file)
    assert langs == ["en", "zh"]
    docs = spark.createDataFrame([(1, zh[3][5:50]), (2, "the dog sat by the door")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, langs, probs, file).collect()} == {1: "zh", 2: "en"}


def test_rare_language_is_sampled(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "xx").when(F.col("id") < 500, "de").otherwise("en").alias("lang"))
    got = {r.lang: r["count"] for r in language_id.sampled(docs, 200, "doc_id").groupBy("lang").count().collect()}
    assert got["xx"] == 3 and 140 < got["de"] < 260 and 140 < got["en"] < 260
