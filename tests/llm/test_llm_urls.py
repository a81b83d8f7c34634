"""URL filter: hosts, paths and rules against plain code, features, held-out accuracy."""

import math
import re
from collections import Counter

from llm_tables import none_of, table
from pyspark.sql import functions as F

from kinfold.llm import url_filter
from kinfold.llm.queries import QUERIES

URLS = ["http://A.Example.NET/en/x?y#z", "https://example.com/de/1", "http://www.example.org/fr/", "ftp://x.org/FR/", "no scheme", None, "", "://",
        "http://net", "http://net/", "http://xnet/", "a://b://c/d", "http://É.net/p?q=1&r=2&&s", "http://h.com?x/de/", "http://h.com#/de/",
        "http://example.com/de/?utm=1", "http://sub.example.com/de", "http://m.example.net/EN/", "http://x.net\n/a\nb", "http://" + "a" * 3000 + ".com/" + "p/" * 2000,
        "http://user@example.net:80/en/", "//host/p"]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in url_filter.RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "h", "r", "v", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string, label double")


def test_hosts_paths_and_rules(spark):
    rows = url_filter.report(pages(spark)).collect()
    assert len(rows) == len(URLS)
    verdicts = dict(url_filter.RULES)
    for r in rows:
        assert (r.host, r.path, r.rule) == plain(URLS[r.page_id])
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_query_covers_all_pages(spark):
    want = {r.page_id: plain(r.url) for r in table(spark, "pages").select("page_id", "url").collect()}
    got = {r.page_id: (r.host, r.path, r.rule) for r in QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_features(spark):
    rows = pages(spark).withColumns({"host": url_filter.host_of(), "path": url_filter.path_of()})
    for r in url_filter.lexical(rows).collect():
        url = r.url or ""
        n = len(url)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
        assert (r.url_length, r.path_length, r.hyphens) == (n, len(r.path), url.count("-"))
        assert abs(r.entropy - entropy) < 1e-9
        assert abs(r.digit_share - (sum(c in "0123456789" for c in url) / n if n else 0.0)) < 1e-12
        assert r.depth == sum(bool(x) for x in r.path.split("/"))
        query = re.search(r"^[^?#]*\?([^#]*)", url, re.S)
        assert r.parameters == sum(bool(x) for x in (query[1] if query else "").split("&"))


def test_held_out_accuracy_on_labelled_urls(spark):
    """Labels by a lexical habit that no rule knows: many digits and parameters are blocked."""
    urls = [(f"http://host{i % 50}.example/{'7' * (i % 9)}{'a/' * (i % 4)}x{'?a=1&b=2' if i % 3 == 0 else ''}",) for i in range(2000)]
    df = spark.createDataFrame(urls, "url string").withColumn("page_id", F.monotonically_increasing_id()) \
        .withColumn("verdict", F.when((F.length(F.regexp_replace("url", "[^0-9]", "")) > 6) | F.col("url").contains("&"), "block").otherwise("allow"))
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    got = url_filter.report(df.where(held).select("page_id", "url"), (), df.where(~held).select("url", "verdict")).alias("g") \
        .join(df.alias("d"), "page_id").select((F.col("g.verdict") == F.col("d.verdict")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.95


def test_no_rule_one_class_and_empty(spark):
    assert {r.verdict for r in url_filter.report(pages(spark, ["http://a.com/", None])).collect()} == {"allow"}
    blocked = spark.createDataFrame([("http://x/", "block")], "url string, verdict string")
    assert {r.verdict for r in url_filter.report(pages(spark, ["http://a.com/", None, None]), (), blocked).collect()} == {"block"}
    assert url_filter.report(none_of(pages(spark))).collect() == []


def test_no_python_on_the_path(spark):
    plan = url_filter.report(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("PythonUDF|MapInArrow|MapInPandas|ArrowEval|BatchEvalPython", plan)
