import re

from loreloom.llm.registry import URL_RULES, op3_url_filter
from loreloom.llm.url_filter import Rule, filter_urls, judge_urls


def brute(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_query(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    for r in op3_url_filter(spark, sf).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], URL_RULES)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://a.Example.COM/en/7", "http://a.example.com/en/7199?x#y", "http://example.com/en/", "http://notexample.com/en/7", "x://net/de/", "http://a.net/de", "http://example.net/de/8#t", "http://example.net/de/9", "http://org?/es/", "http://q.org/es/" + "z" * 100_000, "http://b.c//x/", "http://com/en/8", "a://b://com/en/1"]


def test_odd_urls_and_cut_rules(spark):
    rules = [*URL_RULES, Rule("c", "", "block"), Rule("b.c", "//x/", "allow"), Rule("q.org", "/es/", "allow"), Rule("q.org", "/es/", "block")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    for limit in (100, 2, 1):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules, max_rules=limit).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}
    kept = filter_urls(pages, rules)
    assert kept.columns == pages.columns
    assert sorted(r["page_id"] for r in kept.collect()) == [i for i, u in enumerate(URLS) if brute(u, rules)[3] == "allow"]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}
