import pytest
from pyspark.sql import functions as F

from probeline.llm import urls

CASES = [
    (None, "", ""), ("no scheme/x", "", ""), ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x"), ("https://x.org", "x.org", ""),
    ("ftp://h?x=/y", "h", ""), ("http://h#/a", "h", ""), ("a://b://c/d", "b:", "//c/d"), ("http:///p", "", "/p"), ("http://É.NET/a\nb", "É.net", "/a\nb"),
]


@pytest.mark.parametrize(("url", "host", "path"), CASES)
def test_host_and_path(spark, url, host, path):
    found = spark.createDataFrame([(url,)], "url string").select(*urls.host_and_path(F.col("url"))).collect()[0]
    assert tuple(found) == (host, path)


def test_longest_rule_wins(spark):
    rows = [("example.net", "/en/a"), ("x.example.net", "/de/"), ("badexample.net", "/en/"), ("a.org", "/fr/x"), ("a.org", "/f"), ("example.com", "/de"), ("net", "")]
    found = spark.createDataFrame(rows, "h string, p string").select(urls.best_rule(F.col("h"), F.col("p"), urls.RULES).alias("r")).select("r.*").collect()
    assert [r["rule"] for r in found] == ["example.net/en/", "net/", "net/", "org/fr/", None, None, None]
    assert [r["verdict"] for r in found][:4] == ["allow", "block", "block", "allow"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: " ".join(f"<a href='http://{h}/p'>x</a>" for h in hosts)
    rows = [
        ("http://good.org/fr/1", link("friend.test.io")), ("http://friend.test.io/a", ""),
        ("http://spam.net/x", ""), ("http://farm.test.info/a", link("spam.net", "SPAM.net")), ("http://alone.test.dev/a", None), (None, None),
    ]
    found = {r["page_id"]: r for r in urls.judge(pages(spark, rows)).collect()}
    assert [found[i]["verdict"] for i in range(6)] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert found[1]["trust"] > 0 and found[3]["distrust"] > 0 and found[4]["trust"] == 0
    assert found[0]["rule"] == "org/fr/" and found[1]["rule"] is None


def test_empty_and_repeated_rows(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [("http://a.org/fr/x", ""), ("http://a.org/fr/x", ""), ("http://a.org/x", "")]
    assert [r["verdict"] for r in urls.judge(pages(spark, rows)).collect()] == ["allow"] * 3


def test_scores_go_as_far_as_links_do(spark):
    """A chain of hosts that ends at a blocked one, and a hub of many links before it."""
    chain = [f"c{i}.test" for i in range(30)] + ["end.net"]
    edges = [("block", b, a) for a, b in zip(chain, chain[1:])]
    edges += [("block", "end.net", "hub.test")] + [("block", "hub.test", f"leaf{i}.test") for i in range(200)] + [("block", "leaf7.test", "far.test")]
    seeds = spark.createDataFrame([("block", "end.net", 3)], "kind string, host string, weight long")
    found = {r["host"]: int(r["score"]) for r in urls.spread(spark.createDataFrame(edges, "kind string, src string, dst string"), seeds, 3).collect()}
    assert all(found[x] > 0 for x in chain) and found["far.test"] > 0
    share = {}
    for _, a, _ in edges:
        share[a] = share.get(a, 0) + 1
    score = {"end.net": urls.MASS}
    for _ in range(31):
        fresh = {"end.net": urls.MASS * 15 // 100}
        for _, a, b in edges:
            if a in score:
                fresh[b] = fresh.get(b, 0) + score[a] * 85 // 100 // share[a]
        score = fresh
    assert {h: s for h, s in found.items() if s} == {h: s for h, s in score.items() if s}
