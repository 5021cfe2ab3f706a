"""URL parsing, rules and boosted trees against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from watchlake.llm import url_filter as U


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.NET/en/", "https://a.example.net/EN/x", "http://example.net", "http://net/",
    "http://x.example.com/de/1?q=1#t", "http://badexample.com/de/1", "ftp://x.org/fr/", "http://x.org/fr", "http://x.org?/fr/",
    "http://a.b.org#x://y/fr/", "HTTP://ÉA.ORG/fr/é", "x://a/b://c/d", "http://example.com\n/de/", "http://xnet/", "://net/a",
    "http://h/" + "a/" * 5000, "http://a.net/\nen",
]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int")
    got = {r.page_id: r for r in U.judge_urls(pages).collect()}
    for i, url in enumerate(URLS):
        host, path = parsed(url)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("block", "allow")


def test_lexical_features(spark):
    url = "http://ab-1.example.com/x/22?a=1&b=2"
    rows = spark.createDataFrame([(url, "ab-1.example.com", "/x/22"), (None, "", "")], "url string, host string, path string")
    row, empty = U.with_lexical(rows).collect()
    shares = [url.count(c) / len(url) for c in set(url)]
    assert row.entropy == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert (row.depth, row.labels, row.hyphens, row.parameters) == (2, 3, 1, 2)
    assert row.digit_ratio == pytest.approx(5 / len(url))
    assert (row.suffix, row.domain) == ("com", "example.com")
    assert empty.entropy == 0 and empty.url_length == 0


def test_trees_learn_a_lexical_rule(spark):
    draw = random.Random(2)
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        host = f"{'x-y-' if bad else ''}{draw.choice('abcdef')}{draw.randrange(100)}.example.com"
        rows.append((f"http://{host}/{'a/' * draw.randrange(4)}p", int(bad)))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    model = U.train(labelled.where("crc32(url) % 4 != 0"), trees=4)
    host, path = U.host_and_path(F.col("url"))
    held = labelled.where("crc32(url) % 4 = 0").select("*", host.alias("host"), path.alias("path"))
    scored = model.with_probability(held).select("blocked", "block_probability").collect()
    assert sum((r.block_probability >= 0.5) == bool(r.blocked) for r in scored) >= 0.98 * len(scored)


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").repartition(1)
    plan = U.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_kind_of_label_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, blocked int")
    assert U.judge_urls(pages, none).count() == 2
    only = spark.createDataFrame([("http://b.com/", 1)] * 5, "url string, blocked int")
    assert [r.verdict for r in U.judge_urls(pages, only).collect()] == ["block"] * 2
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
