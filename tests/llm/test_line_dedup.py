from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

import corpus_pipeline
from fathom.llm import line_dedup
from tests.llm.hostile import empty, hostile


def brute_force(docs, most, least):
    import re

    norm = lambda x: re.sub(r"[ \t\r]+", " ", x).lower().strip(" ")
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(norm(x)) >= least:
                seen[norm(x)].add(i)
    bad = {x for x, ids in seen.items() if len(ids) > most}
    out = []
    for i, t in docs:
        lines = None if t is None else t.split("\n")
        kept = None if t is None else [x for x in lines if norm(x) not in bad]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [f"Line {i}  of\ttext" for i in range(12)] + ["", "  ", "ab", "LINE 3 of text", " line 3   of text\r"]
    docs = [(rng.choice([None, *range(30)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for _ in range(60)] + [(1, None), (2, "")]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), max_documents=6, min_chars=5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, 6, 5)


def test_distinct_documents_are_counted_not_rows(spark):
    docs = [(1, "a shared line\na shared line"), (1, "a shared line"), (2, "a shared line\nother")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sum(r["lines_dropped"] for r in line_dedup.line_dedup(df, max_documents=2).collect()) == 0
    assert sorted(r["text"] for r in line_dedup.line_dedup(df, max_documents=1).collect()) == ["", "", "other"]


def test_one_text_keeps_a_frequent_line(spark):
    copies = [(i, "a text of\nmany copies") for i in range(20, 35)]
    shared = [(i, f"own line {i}\na licence line") for i in (None, *range(40, 55))]
    twice = [(60, f"version {i} of one document\nonly here") for i in range(15)]
    docs = spark.createDataFrame(copies + shared + twice, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs, keep_one=True).collect()), key=repr)
    assert got == sorted(copies + [(i, t if i == 40 else f"own line {i}") for i, t in shared] + twice, key=repr)


def test_the_pipeline_s_stages_leave_one_of_many_copies(spark):
    text = "\n".join(f"line {k} tells of things {k * 7} that no other line {k * 13} tells" for k in range(6))
    docs = spark.createDataFrame([(i, text, "en", "a", len(text)) for i in range(25)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_frequent_lines(spark, docs, ""), "")
    assert [(r["doc_id"], r["text"]) for r in kept.collect()] == [(0, text)]


def test_long_texts_of_frequent_lines_take_time_in_proportion(spark):
    lines = [f"a line number {i}" for i in range(20_000)]
    docs = [(d, "\n".join(f"{x}\nown {d} {i}" if i % 5_000 == 0 else x for i, x in enumerate(lines))) for d in range(12)]
    begun = time.perf_counter()
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert time.perf_counter() - begun < 30
    assert {(r["doc_id"], r["text"], r["lines_dropped"]) for r in got} == {(d, "\n".join(f"own {d} {i}" for i in range(0, 20_000, 5_000)), 20_000) for d in range(12)}


def test_short_lines_count_like_others_and_empty_ones_do_not(spark):
    docs = spark.createDataFrame([(i, f"}}\n\n \nown {i}\n}}") for i in range(12)], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.line_dedup(docs).collect()} == {f"\n \nown {i}" for i in range(12)}


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, clashing):
    df = hostile(spark, clashing)
    got = line_dedup.line_dedup(df, max_documents=1)
    assert got.columns[: len(df.columns)] == df.columns and len(set(got.columns)) == len(df.columns) + 2
    texts = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    want = sorted(((r["doc_id"], "" if r["doc_id"] in (8, 9) else r["text"]) for r in df.collect()), key=repr)
    assert texts == want


def test_empty_table(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0
