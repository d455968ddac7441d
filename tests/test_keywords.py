from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from fathom import catalog
from fathom.operators import keywords
from fathom.operators.keywords import TopTerms, more_like_all
from fathom.sources.index import Index


def test_more_than_fifty_copies_find_each_other(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PART_DOCS", 7)
    docs = [(i, "mountain rivers flowing westward") for i in range(60)] + [(i, f"nothing{i}") for i in range(60, 70)]
    index = Index.build(spark.createDataFrame(docs, "doc_id long, text string"), {"body": F.col("text")})
    found = more_like_all(index, TopTerms(index, ["body"]).extract_all(20, catalog._accept), 100).collect()
    assert {(r["src"], r["doc_id"]) for r in found} == {(a, b) for a in range(60) for b in range(60)} and len(found) == 3600
    assert len({r["score"] for r in found}) == 1


def _mixed(spark):
    rng = random.Random(7)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 27), k=rng.randint(1, 30)) + [f"only{i % 17}"])) for i in range(80)]
    return Index.build(spark.createDataFrame(docs, "doc_id long, text string"), {"body": F.col("text")})


def test_pairs_are_not_shuffled_and_sums_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PART_DOCS", 9)
    monkeypatch.setattr(keywords, "PART_KEYWORDS", 100)
    index = _mixed(spark)
    found = TopTerms(index, ["body"]).extract_all(6)
    kws, postings = found.collect(), index.postings.collect()
    stats = {r["term"]: r["df"] for r in index.term_stats.collect()}
    average = sum(r["tf"] for r in postings) / 80
    by_term = {}
    for p in postings:
        weight = math.log(1 + (80 - stats[p["term"]] + 0.5) / (stats[p["term"]] + 0.5))
        by_term.setdefault(p["term"], []).append((p["doc_id"], weight * 2.2 * p["tf"] / (p["tf"] + 1.2 * (0.25 + 0.75 * p["dl"] / average))))
    for boosted in (False, True):
        best = {d: max(k["score"] for k in kws if k["doc_id"] == d) for d in range(80)}
        sums = {}
        for k in kws:
            for d, s in by_term[k["term"]]:
                sums[k["doc_id"], d] = sums.get((k["doc_id"], d), 0.0) + s * (k["score"] / best[k["doc_id"]] if boosted else 1.0)
        want = {(a, b, n) for a in range(80) for n, (_, b) in enumerate(sorted((-round(s, 6), d) for (x, d), s in sums.items() if x == a)[:7], 1)}
        got = more_like_all(index, found, 7, boosted)
        assert {(r["src"], r["doc_id"], r["rank"]) for r in got.collect()} == want
        plan = got._jdf.queryExecution().toString()
        assert "hashpartitioning(src#" in plan and not any("hashpartitioning(src#" in x and "doc_id#" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.split("\n"))


def test_only_rare_terms_and_possible_bests_leave_their_documents(spark, monkeypatch):
    monkeypatch.setattr(keywords, "FREQUENT_TERMS", 26)
    index = _mixed(spark)
    rows = {}
    n = {r["term"]: r["df"] for r in index.term_stats.collect()}
    for p in index.postings.collect():
        if p["term"] != "wordb":
            rows.setdefault(p["doc_id"], []).append((-round(p["tf"] * math.log(1 + (80 - n[p["term"]] + 0.5) / (n[p["term"]] + 0.5)), 6), p["term"]))
    want = {(d, t, k) for d, xs in rows.items() for k, (_, t) in enumerate(sorted(xs)[:3], 1)}
    found = TopTerms(index, ["body"]).extract_all(3, lambda term, tf, df, n: term != "wordb")
    assert {(r["doc_id"], r["term"], r["rank"]) for r in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().toString()
