from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from fathom.llm import url_filter

SCHEMA = "page_id long, url string"


def parts(url):
    """(hosts, paths) of a URL as the docstring says, or None."""
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)", url or "")
    if not m:
        return None
    labels = m.group(1).lower().strip(".").split(".")
    alone = labels[0].startswith("[") or re.fullmatch("[0-9]+", labels[-1])
    hosts = [".".join(labels[i:]) for i in range(1 if alone else max(1, len(labels) - 1))]
    rest = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", url).group(1)
    rest = rest if rest.startswith("/") else "/" + rest
    path, query = re.match(r"([^?]*)(.*)", rest).groups()
    path = re.sub(r"/(\.?/)+", "/", path)
    rest = path + query
    steps = path.split("/")
    paths = {"/".join(steps[: i + 1]) + "/" for i in range(max(1, len(steps) - 1))} | {path, rest}
    return hosts, paths


def judge(url, rules):
    found = parts(url)
    best = None
    for h in found[0] if found else ():
        for p in found[1]:
            for i, e, a, k in rules:
                if e == h + p and a in ("allow", "block"):
                    mine = (len(h.split(".")), len(p), a == "allow", -i)
                    if best is None or mine > best[0]:
                        best = (mine, (a, i))
    return best[1] if best else ("none", None)


RULES = [
    (1, "b.example/", "block", "x"), (2, "a.b.example/", "allow", "x"), (3, "b.example/p/", "allow", "x"), (4, "b.example/p/q?z=1", "block", "x"),
    (12, "0.1/", "block", "x"), (13, "10.9.0.1/", "block", "x"), (14, "[::1]/p/", "block", "x"), (15, "a.b.example/p/q/r/s/", "allow", "x"), (5, "a.b.example/p/", "block", "x"), (6, "a.b.example/p/", "allow", "x"), (7, "b.example/P/", "block", "x"), (8, "c.example/", "other", "x"), (9, "b.example/p/q", "block", "x"),
]


def test_against_brute_force(spark):
    rng = random.Random(1)
    urls = [
        f"{rng.choice(['http', 'HTTPS', 'ftp'])}://{rng.choice(['', 'u:p@'])}{rng.choice(['b.example', 'a.b.example', 'x.a.B.Example', 'c.example', 'example', 'bb.example', '.b.example.', '10.9.0.1', '9.0.1', 'x.0.1', '[::1]', '[::2]'])}"
        f"{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/', '/p/q', '/P/q', '/p/q/r.html', '//p/./q//', '/p/q/r/s/t', '/../p/', '?z=1'])}{rng.choice(['', '?z=1', '?z=1/2'])}{rng.choice(['', '#top', '#/a'])}"
        for _ in range(900)
    ]
    df = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    rules = spark.createDataFrame(RULES, "rule_id long, expression string, action string, category string")
    got = {r["page_id"]: (r["verdict"], r["rule_id"]) for r in url_filter.url_filter(df, rules).collect()}
    assert got == {i: judge(u, RULES) for i, u in enumerate(urls)}
    assert len({v for v, _ in got.values()}) == 3


def test_short_prefixes_alone_decide_nothing(spark, monkeypatch):
    """All prefixes made equal, full digests must still tell expressions apart."""
    real = F.substring
    monkeypatch.setattr(F, "substring", lambda c, a, b: F.lit("00000000") if b == 8 else real(c, a, b))
    df = spark.createDataFrame([(1, "http://b.example/x"), (2, "http://z.example/")], SCHEMA)
    rules = spark.createDataFrame(RULES, "rule_id long, expression string, action string, category string")
    assert {r["page_id"]: r["rule_id"] for r in url_filter.url_filter(df, rules).collect()} == {1: 1, 2: None}


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_pages(spark, clashing):
    data = [(1, None), (2, ""), (3, "no url"), (4, "http://b.example"), (4, "http://b.example"), (None, "http://b.example/p/"), (5, "http://b.example/" + "x/" * 3000), (6, "http:///p")]
    df = spark.createDataFrame(data, SCHEMA)
    if clashing:
        df = df.withColumns({c: F.lit("clash") for c in ("u", "e", "prefix", "digest", "full", "labels", "length", "b", "x", "verdict", "rule_id", "category", "expression")})
    bad = [(None, "b.example/", "block", "x"), (10, None, "block", "x"), (11, "b.example/", None, "x"), *RULES, RULES[0]]
    rules = spark.createDataFrame(bad, "rule_id long, expression string, action string, category string")
    got = sorted(((r["page_id"], r["verdict"], r["rule_id"]) for r in url_filter.url_filter(df, rules).collect()), key=repr)
    want = [(1, "none", None), (2, "none", None), (3, "none", None), (4, "block", 1), (4, "block", 1), (5, "block", 1), (6, "none", None), (None, "allow", 3)]
    assert got == sorted(want, key=repr)


def test_very_long_urls_take_little(spark):
    long = [(1, "http://b.example/" + "x/" * 50_000), (2, "http://a.b.example/" + "y" * 100_000), (3, "http://" + "l." * 50_000 + "b.example/"), (4, "http://b.example/p/" + "?q/" * 30_000), (5, "http://b.example" + "/" * 100_000 + "p/")]
    rules = spark.createDataFrame(RULES, "rule_id long, expression string, action string, category string")
    begun = time.perf_counter()
    got = {r["page_id"]: r["rule_id"] for r in url_filter.url_filter(spark.createDataFrame(long, SCHEMA), rules).collect()}
    assert time.perf_counter() - begun < 10
    assert got == {1: 1, 2: 2, 3: 1, 4: 3, 5: 3}


def test_no_rules_and_no_pages(spark):
    df = spark.createDataFrame([(1, "http://b.example/")], SCHEMA)
    none = spark.createDataFrame([], "rule_id long, expression string, action string, category string")
    assert [r["verdict"] for r in url_filter.url_filter(df, none).collect()] == ["none"]
    assert url_filter.url_filter(df.where("false"), url_filter.rules_table(spark)).count() == 0
