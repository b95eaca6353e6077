import pytest
from conftest import SF

from planar.llm import queries, url_rules

LISTED = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
          ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        host = path = ""
    else:
        rest = url[at + 3 :]
        stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:stop])
        path = rest[stop:]
        path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "x://example.com/en/",
    "http://com/", "http://xcom/", "http://a.net/es/1", "http://a.net/es", "http://é.net/fr/\nline", "a://b://c.com/", "http://u@h.com:80/p",
    "http://...", "http://a.com//x", "http://a.net?x=://b.com/", "http://a.org/en/" + "x" * 5000,
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, host string")


def test_listed_rules(spark, pages):
    for r in url_rules.judge(pages).select("page.url", "host", "path", "rule", "verdict").collect():
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_rules.judge(pages.where("false")).count() == 0


def test_mined_rules_against_brute_force(spark):
    rows = [(f"http://bad{i % 3}.spam.org/buy/{i}?ref=1", "block") for i in range(40)]
    rows += [(f"http://good{i}.spam.org/read/{i}", "allow") for i in range(60)] + [(None, "allow"), ("http://x.org", None)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_rules.tokens("url").alias("t")).collect() if r.url}
    rules = url_rules.mine(labelled, 0.05, 0.9).collect()
    baskets = [(tokens.get(u, set()), v) for u, v in rows if v]
    for r in rules:
        met = [v for t, v in baskets if set(r.tokens) <= t]
        assert r.support == pytest.approx(met.count(r.verdict) / len(baskets))
        assert r.confidence == pytest.approx(met.count(r.verdict) / len(met))
    asked = spark.createDataFrame([(1, "http://new.spam.org/buy/9?ref=2"), (2, "http://new.spam.org/read/9"), (3, "ftp://x.y")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(asked, labelled, min_support=0.05).select("page.page_id", "verdict").collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.queries()["op7_url_rules"](spark, SF).collect()
    assert {r.page_id for r in rows} == set(urls) and all((r.host, r.path, r.rule) == brute(urls[r.page_id])[:3] for r in rows)
