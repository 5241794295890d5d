"""URL rules against a loop over all rules."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import url_filter

PAGES = "page_id long, url string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_verdict(url, rules, default="allow"):
    host, path = brute_parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judged(spark, urls, rules):
    rows = spark.createDataFrame(list(enumerate(urls)), PAGES)
    got = url_filter.judge_urls(rows, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return [tuple(r)[2:] for r in got.orderBy("page_id").collect()]


ODD = [
    None, "", "no scheme", "://", "http://", "http:///en/1", "http://ORG/", "http://org", "http://org?x=/en/1", "http://example.org/en/1", "http://notexample.org/en/1",
    "http://www.EXAMPLE.org/en/123/x?y#z", "http://example.org/en/", "http://a.b.example.org/es/", "http://example.org:80/es/", "http://example.org./es/", "http://x.com/fr/#", "http://x.com/de/1",
    "http://com/de/", "http://x.com/FR/", "http://x.com//fr/", "http://..org/", "http://u@x.org/", "a://b://c.org/", "http://É.org/é/", "http://x.org/\n/y", "http://x.net/",
    "http://" + "a." * 30_000 + "org/" + "x/" * 30_000,
]


def test_query_rules(spark):
    assert judged(spark, ODD, url_filter.RULES) == [brute_verdict(u, url_filter.RULES) for u in ODD]


def test_random(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "aa", "org", "com", ""], ["", "a", "ab", "b", "1", "12"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join("/" + rng.choice(parts) for _ in range(rng.randrange(0, 4)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(*k, v) for k, v in rules.items()]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?a/b', '#a'])}" for _ in range(1500)] + ODD
    urls += urls[:200]
    assert judged(spark, urls, rules) == [brute_verdict(u, rules) for u in urls]


def test_rules_that_cannot_be(spark):
    urls = ["http://a.org/x", None]
    assert judged(spark, urls, []) == [("a.org", "/x", None, "allow"), ("", "", None, "allow")]
    odd = [(None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("ORG", "/", "allow"), ("org", "/", "block"), ("", "", "block")]
    # Of two verdicts for one rule, block; an empty host and path fits the URL that has none.
    assert judged(spark, urls, odd) == [("a.org", "/x", "org/", "block"), ("", "", "", "block")]


def test_clashes_and_empty(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, None)], PAGES)
    more = rows.withColumns({c: F.lit(c) for c in ("HOST", "rule", "verdict", "digest", "n", "suffix", "_host", "best", "full")})
    got = url_filter.judge_urls(more, rules)
    assert got.columns == ["page_id", "url", "digest", "n", "suffix", "_host", "best", "full", "host", "path", "rule", "verdict"]
    assert sorted(str((r.page_id, r.n, r.host, r.rule, r.verdict)) for r in got.collect()) == sorted([str((1, "n", "x.org", "org/", "allow"))] * 2 + [str((None, "n", "", None, "allow"))])
    assert url_filter.judge_urls(rows.limit(0), rules).count() == 0


def test_hot_folder_makes_one_expression_per_length(spark):
    """Many rules in one folder do not multiply with its URLs."""
    rules = [("example.org", f"/en/{i:04}", "block") for i in range(3000)]
    urls = [f"http://example.org/en/{i:04}x" for i in range(2990, 3010)]
    assert judged(spark, urls, rules) == [brute_verdict(u, rules) for u in urls]
    table = url_filter.rule_table(spark.createDataFrame(rules, "host string, path string, verdict string"))
    pages = spark.createDataFrame([("example.org", "/en/0001")] * 50, "host string, path string")
    assert url_filter.fitting_rules(pages, table).count() == 1


def test_no_python_in_plan(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], PAGES)
    rules = spark.range(1).select(F.lit("org").alias("host"), F.lit("/").alias("path"), F.lit("allow").alias("verdict"))
    for df in (url_filter.judge_urls(pages, rules), url_filter.rule_table(rules)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
