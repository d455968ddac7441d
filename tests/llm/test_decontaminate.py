from __future__ import annotations

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import decontaminate as D
from fathom.llm.common import words
from tests.llm.hostile import LONG, empty, hostile, rows

ITEMS = "item_id long, text string"


def brute_force(items, texts, n, least):
    phrases = {}
    for i, t in items:
        w = words(t)
        if i is not None and len(w) >= max(1, least):
            m = min(n, len(w))
            for j in range(len(w) - m + 1):
                phrases.setdefault(tuple(w[j : j + m]), set()).add(i)
    out = []
    for t in texts:
        w = words(t)
        out.append(sorted((j, j + len(p), sorted(ids)) for p, ids in phrases.items() for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_occurrences_against_brute_force(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(rng.choice([2, 6, 40]))]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 14)))) for i in range(6)]
    texts = [None, "", "..."] + [" ".join(rng.choice([*v, "other"]) for _ in range(rng.randint(0, 300))) for _ in range(8)] + [f"{items[3][1]}. {items[4][1]}"] * 2 + [" ".join(v[:1] * 400)]
    index = pickle.loads(pickle.dumps(D.ShardIndex(pa.array(texts))))  # as it's stored
    for n, least in ((6, 3), (1, 1), (8, 1)):
        assert [sorted(x) for x in index.occurrences(D.Phrases(items, n, least))] == brute_force(items, texts, n, least)


def test_parts_of_the_index_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(0, rng.choice([2, 5, 60]), int(rng.integers(1, 200))).astype(np.int64)
        s[-1] = 0
        zeros = np.flatnonzero(s == 0)
        # separators differ: the earlier is the smaller
        key = lambda i: [(0, j) if s[j] == 0 else (1, int(s[j])) for j in range(i, zeros[zeros >= i][0] + 1)]  # noqa: B023, E731
        assert D.suffix_array(s).tolist() == sorted(range(len(s)), key=key)
        w = D.Wavelet(s, 60)
        i = rng.integers(0, len(s) + 1, 50)
        c = rng.integers(0, 60, 50)
        assert w.rank(c, i).tolist() == [int((s[:k] == x).sum()) for k, x in zip(i, c)]
        at = np.arange(len(s))
        symbol, rank = w.access(at)
        assert symbol.tolist() == s.tolist() and rank.tolist() == [int((s[:k] == s[k]).sum()) for k in at]
        f = D.FMIndex(s, 60, sample=3)
        inner = np.flatnonzero(s[D.suffix_array(s)] > 0)
        assert f.locate(inner).tolist() == D.suffix_array(s)[inner].tolist()


def test_spans_cut_from_documents(spark):
    item = "Which of these seven rivers crosses the old border twice before noon?"
    text = f"Before it. {item.upper()} After it, and again: which of THESE seven rivers crosses the old border! End."
    docs = spark.createDataFrame([(1, text), (2, "Nothing of the kind."), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (4, item + " Really?")], ITEMS)
    spans = {(r["doc_id"], r["start_word"], r["end_word"]): r for r in D.contaminated_spans(docs, bench).collect()}
    assert set(spans) == {(1, 2, 14), (1, 18, 27), (3, 0, 12)} and spans[3, 0, 12]["items"] == [4, 5]
    got = {r["doc_id"]: (r["text"], r["contaminated"]) for r in D.decontaminate(docs, bench).collect()}
    assert got == {1: ("Before it. ? After it, and again: ! End.", True), 2: ("Nothing of the kind.", False), 3: ("?", True)}


def test_large_benchmarks_take_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    v = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(v) for _ in range(12))) for i in range(20)]
    texts = [(i, " ".join(rng.choice(v) for _ in range(20)) + " " + items[i][1] + " end") for i in range(20)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    once = rows(D.decontaminate(docs, bench))
    monkeypatch.setattr(D, "PASS_WORDS", 60)
    assert D.passes(bench, 8, 5)[0] == 4
    assert rows(D.decontaminate(docs, bench)) == once and all(r[2] for r in once)


@pytest.mark.parametrize("seed", range(4))
def test_passes_agree_with_one_pass_where_their_items_overlap(spark, monkeypatch, seed):
    rng = random.Random(seed)
    w = [f"w{i}" for i in range(60)]
    starts = [rng.randrange(50) for _ in range(12)]
    # overlapping items, and one whose words meet only when another's are cut from between them
    items = [(rng.randrange(10**9), " ".join(w[a : a + 10])) for a in starts] + [(rng.randrange(10**9), " ".join(w[8:12] + w[22:26]))]
    texts = [(i, " ".join(w[rng.randrange(20) :])) for i in range(6)] + [(7, None), (7, " ".join(w[8:26])), (7, " ".join(w[8:26]))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    once = [rows(f(docs, bench)) for f in (D.contaminated_spans, D.decontaminate)]
    monkeypatch.setattr(D, "PASS_WORDS", 30)
    assert D.passes(bench, 8, 5)[0] > 3
    assert [rows(f(docs, bench)) for f in (D.contaminated_spans, D.decontaminate)] == once


@pytest.mark.parametrize("words", [1_000_000, 5])
def test_shards_of_several_batches_and_small_ones(spark, monkeypatch, words):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(i, f"x{i} {item} y") for i in range(50)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item), (2, "x7 one two"), (3, "zzz")], ITEMS)
    monkeypatch.setattr(D, "PASS_WORDS", words)
    want = [(i, 0 if i == 7 else 1, 10, [1, 2] if i == 7 else [1]) for i in range(50)]
    for size in (1, 700, 16 << 20):  # a shard a batch, several batches a shard, one shard a task
        monkeypatch.setattr(D, "SHARD_BYTES", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
        try:
            assert rows(D.contaminated_spans(docs, bench).select("doc_id", "start_word", "end_word", "items")) == sorted(want, key=repr)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_shard_is_bounded_whatever_the_batches_are(monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 5, 90, 700]) for _ in range(900)]
    texts[400:402] = [None, "y" * 50_000]  # longer than a shard
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], ["d", "t"])
    for batches in ([batch], [batch.slice(0, 3), batch.slice(3, 0), batch.slice(3, 20), batch.slice(23)], [batch.slice(i, 1) for i in range(900)]):
        found = list(D.shards(iter(batches)))
        assert pa.concat_tables(found).equals(pa.Table.from_batches([batch]))
        assert all(x.nbytes <= 2000 or x.num_rows == 1 for x in found) and sum(x.nbytes > 2000 for x in found) == 1
        assert len(found) < 300  # small rows still share a shard


def test_what_an_index_takes_to_make():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{i}" for i in rng.zipf(1.3, 400) % 20_000) for _ in range(1000)])
    D.ShardIndex(texts.slice(0, 2))
    tracemalloc.start()
    try:
        index = D.ShardIndex(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # besides what splitting one part of the texts into words takes, whatever the shard's size
    assert index.fm.n == 401_000 and peak < 30e6 + 50 * index.fm.n, peak / index.fm.n


def test_stored_indexes_answer_another_benchmark_without_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c d e f{i % 3} g") for i in range(30)] + [(None, "c d e"), (40, None)], "doc_id long, text string")
    D.shard_indexes(docs.repartition(2)).write.parquet(str(tmp_path / "indexes"))
    stored = spark.read.parquet(str(tmp_path / "indexes"))
    one, two = spark.createDataFrame([(1, "c d e f2")], ITEMS), spark.createDataFrame([(2, "B4 c"), (3, "zzz c")], ITEMS)
    assert sorted(r["id"] for r in D.search_indexes(stored, one).collect()) == list(range(2, 30, 3))
    assert [(r["id"], r["start_word"], r["end_word"], r["items"]) for r in D.search_indexes(stored, two).collect()] == [(4, 1, 3, [2])]


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, clashing):
    bench = spark.createDataFrame([(1, "Plain text about nothing much, in one line."), (2, None), (None, "a document without an id at all here now"), (3, "shortest"), (4, ""), (9, LONG)], ITEMS)
    df = hostile(spark, clashing)
    found = sorted({(r["doc_id"], r["start_word"], r["end_word"]) for r in D.contaminated_spans(df, bench).collect()}, key=repr)
    assert found == [(1, 0, 8), (5, 0, 120_000)]
    got = D.decontaminate(df, bench)
    assert got.columns[: len(df.columns)] == df.columns and got.count() == 11
    assert sorted(r["text"] for r in got.where("doc_id in (1, 5)").collect()) == ["", ".", "."]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], ITEMS)
    assert D.contaminated_spans(empty(spark), bench).count() == 0 and D.decontaminate(empty(spark), bench).count() == 0
    assert D.contaminated_spans(hostile(spark), bench.where("false")).count() == 0
    assert not any(r[-1] for r in D.decontaminate(hostile(spark), bench.where("false")).collect())
