from __future__ import annotations

import random
import re
import tracemalloc
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import minhash
from tests.llm.hostile import ROWS, SCHEMA, empty, hostile, rows


def grams(text, n=3):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_force(docs, threshold=minhash.THRESHOLD):
    sets = {i: g for i, t in docs if (g := grams(t or ""))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= threshold]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return pairs, {i: r for r, own in groups.items() if len(own) > 1 for i in own}


def edited(words, rng, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.random()}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, i = [], 0
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 200, 400]))]
        for c in range(rng.choice([1, 1, 2, 5])):
            docs.append((i, " ".join(edited(base, rng, 0.03 if c else 0))))
            i += 1
    hot = [rng.choice(vocabulary) for _ in range(150)]  # a large group, some members of which only meet through others
    for c in range(120):
        docs.append((i, " ".join(edited(hot, rng, rng.choice([0, 0.02, 0.06])))))
        i += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs, want = brute_force(docs)
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs)
    assert found >= 0.98 * len(pairs)
    assert all(got[i] == want.get(i) for i in got if want.get(i) == i)  # no group that isn't one
    assert set(got) <= set(want)


@pytest.mark.parametrize(("sf", "missed"), [("sf0.001", 0), ("sf0.01", 0.01)])
def test_the_tables_against_all_pairs_by_sql(spark, sf, missed):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = {d: g for d, g, _ in con.execute(minhash.SQL).fetchall()}
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in minhash.near_duplicate_groups(spark.read.parquet(path)).collect()}
    assert all(want[d] == g and k == (d == g) for d, (g, k) in got.items()) and len(got) >= (1 - missed) * len(want)


def test_buckets_of_several_components_are_verified_pairwise(spark, monkeypatch):
    """With one coordinate a band nearly everything shares buckets; the components must still be those of all pairs."""
    docs = corpus(3)[:90]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"), bands=64, rows=1).collect()}
    assert got == brute_force(docs)[1]


def test_sets_are_made_without_permutations():
    """The stage that stores sets needs none, and its workers share the executor's memory with the largest join's texts."""

    class Plan:
        dtypes = [("d", "bigint")]
        join = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    texts = ["one two three four five six", "two words", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["d", "t"])
    run = minhash.gram_sets(Plan(), None, 3)
    want = [g.view(np.int32).tolist() for g in minhash.Sketcher().grams(texts)]  # letters' numbers are drawn here
    tracemalloc.start()
    try:
        (got,) = run(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.column(0).to_pylist() == [1, 2, 3, 4] and got.column(1).to_pylist() == want
    assert peak < 4 << minhash.LOG_D  # one permutation


def test_a_sketcher_takes_two_permutations_of_memory():
    """The permutation and the one with its beginning behind it; drawn in place, and the same as ever."""
    tracemalloc.start()
    try:
        s = minhash.Sketcher()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2.5 * (4 << minhash.LOG_D)
    assert np.array_equal(s.shifts[: 1 << minhash.LOG_D, 0], np.random.Generator(np.random.PCG64(minhash.SEED)).permutation(1 << minhash.LOG_D))


def test_signatures_are_circulant_minima():
    s = minhash.Sketcher(3, 4, 2, seed=5)
    (g,) = s.grams(["one two three four five six seven"])
    d = 1 << minhash.LOG_D
    places = [(int(x) * int(s.factor) + int(s.offset)) % d for x in g]
    pi = s.shifts[:, 0]
    assert s.signature(g).tolist() == [min(int(pi[(p + k) % d]) if (p + k) < len(pi) else int(s.shifts[p, k]) for p in places) for k in range(8)]
    assert len(np.unique(pi[:d])) == d  # a permutation


def test_signatures_estimate_jaccard():
    rng = random.Random(4)
    s = minhash.Sketcher(3, 50, 5)
    for share in (0.02, 0.1, 0.2):
        base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        a, b = " ".join(base), " ".join(edited(base, rng, share))
        x, y = (s.signature(g) for g in s.grams([a, b]))
        assert abs((x == y).mean() - jaccard(grams(a), grams(b))) < 0.12


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, clashing):
    got = rows(minhash.near_duplicate_groups(hostile(spark, clashing)))
    assert got == [(8, 8, True), (9, 8, False)]
    kept = minhash.drop_near_duplicates(hostile(spark, clashing))
    assert kept.columns == hostile(spark, clashing).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 2, 3, 4, None, 5, 6, 7, 8], key=repr)  # the repeated row once, of the tie the smaller id


def test_the_stage_drops_no_text_that_is_unlike_all_others(spark):
    """Of rows that share an id, or have no words, only copies go."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, near, "b"), (1, near, "a"), (1, "something else altogether, by the same id", "c"), (2, f"{near} fifteen", "d"), (3, "words of its own", "e"), (3, None, "f"), (3, None, "f"), (4, "", "g"), (4, "", "g"), (4, "...", "h"), (None, near, "i"), (None, near, "i")]
    df = spark.createDataFrame(docs, "doc_id long, text string, more string").withColumns({"day": F.lit("2020-01-01").cast("date"), "many": F.array(F.col("more"))})
    got = sorted((r[:3] for r in minhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted((d for d in docs if d not in ((1, near, "b"), (2, f"{near} fifteen", "d"))), key=repr)


def test_a_node_of_very_many_neighbours(spark):
    edges = spark.range(1, 100_001).selectExpr("0 as a", "id as b").unionByName(spark.range(1, 100_000).where("id % 10 = 0").selectExpr("id as a", "id + 1 as b"))
    got = minhash.components(edges)
    assert got.count() == 100_001 and got.where("comp <> 0").count() == 0


def test_empty_table(spark):
    assert rows(minhash.near_duplicate_groups(empty(spark))) == []
    assert rows(minhash.drop_near_duplicates(empty(spark))) == []


def test_rows_that_share_an_id_are_one_node(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "epsilon zeta eta theta"), (3, "epsilon zeta eta theta")]
    assert rows(minhash.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == [(1, 1, True), (2, 1, False), (3, 1, False)]


@pytest.mark.parametrize("n", [2, 3, 40, 257])
def test_components_of_chains_and_stars(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(10_000), n)
    chain = list(zip(ids, ids[1:]))
    star = [(20_000, 20_000 + i) for i in range(1, n)]
    got = {r["d"]: r["comp"] for r in minhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: min(ids) for i in ids}, **{20_000 + i: 20_000 for i in range(n)}}


def test_schema_of_hostile_rows_holds():
    assert len(ROWS[0]) == len(SCHEMA.split(","))
