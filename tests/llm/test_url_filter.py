from __future__ import annotations

from pyspark.sql import functions as F

from starcart.llm import url_filter
from starcart.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org/en/1", "http://a.example.org/en/12",
    "http://badexample.org/en/1", "http://x.com/fr/a/b", "http://x.com/de", "http://x.com/de/", "https://x.com?/de/", "http://org", "http://org/",
    "ftp://a.b.com#frag/de/", "http://exämple.com/de/ü", "http://y.net/p.html", "http://www.y.net/p/", "http://m.y.net/p", "http://y.net/p?q=1",
    "http://y.net/q", "http://a.com/x://b.org/", "http://EXAMPLE.org/ES/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def expected(url, listed):
    host, path = parts(url)
    fits = [
        (len(r), r, v) for v, r in URL_RULES
        for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])]
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    bare = host[4:] if host.startswith("www.") else host[2:] if host.startswith("m.") else host
    trimmed = path[:-5] if path.endswith(".html") else path[:-1] if path.endswith("/") else path
    return host, path, None, "block" if host and bare + trimmed in listed else "allow"


def test_every_url_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, verdict string")
    listed = spark.createDataFrame([("y.net/p",), ("y.net/p",), (None,), ("elsewhere.net/",)], "url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(pages, listed, URL_RULES).collect()}
    assert got == {i: expected(u, {"y.net/p"}) for i, u in enumerate(URLS * 2)}


def test_a_full_filter_changes_nothing(spark):
    """With one block for many URLs nearly all rows are possible hits; the exact join decides."""
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"))
    listed = spark.range(0, 1000, 7).select(F.concat(F.lit("h.net/"), "id").alias("url"))
    for blocks in (1, 1 << 17):
        got = url_filter.filter_urls(pages, listed, [], max_blocks=blocks).where("verdict = 'block'")
        assert sorted(r["page_id"] for r in got.collect()) == list(range(0, 500, 7))


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"))
    blocks = url_filter.block_count(2000, 12, 1 << 17)
    table = {r["block"]: r for r in url_filter.bloom_table(listed, blocks).collect()}
    probe = spark.range(4000).select("id", F.concat(F.lit("u"), "id").alias("url"))
    masks = [m.alias(f"m{i}") for i, m in enumerate(url_filter._masks(F.col("url")))]
    hits = set()
    for r in probe.select("id", url_filter._block(F.col("url"), blocks).alias("b"), *masks).collect():
        row = table.get(r["b"])
        if row and all(row[f"w{i}"] & r[f"m{i}"] == r[f"m{i}"] for i in range(url_filter.WORDS)):
            hits.add(r["id"])
    assert set(range(2000)) <= hits and len(hits) < 2200


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(pages, listed, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(one, listed, URL_RULES).first()["verdict"] == "allow"
