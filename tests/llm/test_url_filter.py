"""The URL filter against its SQL, a brute-force version, and its edge cases."""

import pytest

from metaloom.llm import entry, url_filter
from tests.compare import assert_same

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b", "", "block"), ("b", "/xy", "allow"), ("a.b", "/x", "allow"), ("twice.net", "/", "allow"), ("twice.net", "/", "block"), ("", "/q", "block")]


def plain(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, default))


URLS = [
    None, "", "no scheme", "://", "http://", "http://Example.ORG", "http://example.org/", "http://www.EXAMPLE.org/es/1?x=/es/", "https://example.org/en/12#top", "http://notexample.org/es/",
    "http://a.b", "http://c.a.b?x", "http://a.b/xyz", "http://a.b.c/xyz", "http://twice.net/", "http://x..org/", "http://org./q", "http://example.org:80/es/", "http://a/b://example.org/es/",
    "http://example.org/ES/", "http://é.example.org/es/ü", "http://x.org/" + "y" * 100_000, "http://" + "l." * 5000 + "org/", "http://example.org/\nes/", "http:///q/1",
]


def test_sql(spark):
    assert assert_same(entry.op11_url_filter(spark, "/root/testdata/sf0.01"), url_filter.ORACLE) > 0


def test_brute_force_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(3, URLS[7], "r"), (None, URLS[8], "r")], "page_id long, url string, rule string")
    got = url_filter.judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r["page_id"], *plain(r["url"], RULES)) for r in pages.collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_no_rules_no_rows_long_rule(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([(None, None, None), ("a.org", "/", None)], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judged(pages, rules, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    some = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judged(pages.limit(0), some).count() == 0
    with pytest.raises(ValueError):
        url_filter.judged(pages, spark.createDataFrame([("a", "/" * 3000, "block")], some.schema))


def test_equal_short_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", 1)
    rules = [(f"h{i}.org", f"/{i}", "block") for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/{i % 7}") for i in range(200)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: plain(f"http://h{i}.org/{i % 7}", rules)[2:] for i in range(200)}
