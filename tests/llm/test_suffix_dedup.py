from __future__ import annotations

import random
import re

import numpy as np
import pytest

from fathom.llm import suffix_dedup as S
from fathom.llm.common import tokens, words
from tests.llm.hostile import LONG, empty, hostile, rows


def brute_force(docs, length):
    seen = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        for j in range(len(w) - length + 1):
            if i is not None:
                seen.setdefault(tuple(w[j : j + length]), set()).add((i, j))
    marks = {}
    for places in seen.values():
        ids = sorted({i for i, _ in places})
        if len(ids) > 1:
            for i, j in places:
                o = ids[0] if i != ids[0] else ids[-1]
                marks[i, j] = min(o, marks.get((i, j), o))
    out = []
    for i, j in sorted(marks):
        if out and out[-1][0] == i and j <= out[-1][2]:
            out[-1] = (i, out[-1][1], j + length, min(out[-1][3], marks[i, j]))
        else:
            out.append((i, j, j + length, marks[i, j]))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_family_against_brute_force(seed):
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    length = rng.choice([4, 5, 8, 9, 12])
    family, windows = S.Family(length), []
    base = np_rng.integers(0, 3, 30).astype(np.uint32)
    batches, count = rng.randint(1, 9), 0
    for _ in range(batches):
        batch = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(1, 6), rng.randint(0, 12)
            w = base[k : k + n + length - 1] if rng.random() < 0.6 else np_rng.integers(0, 3, n + length - 1).astype(np.uint32)
            low = rng.randint(0, 5)
            high = low if rng.random() < 0.7 else low + rng.randint(0, 2)
            batch.append((count, low, high, w))
            windows += [(count, i, low, high, tuple(w[i : i + length].tolist())) for i in range(n)]
            count += 1
        family.add(S.level_of(batch, length))
    assert [x.rank for x in family.levels] == [b for b in range(9, -1, -1) if batches >> b & 1]  # as the bits of a counter
    for x in family.levels:  # each level is sorted
        ordered = [x.text[a : a + length].tolist() for a in x.at]
        assert ordered == sorted(ordered) and len(set(map(tuple, ordered))) == len(ordered)
    owners = {}
    for _, _, low, high, w in windows:
        owners.setdefault(w, set()).update((low, high))
    want = sorted((o, i, min(owners[w]), max(owners[w])) for o, i, _, _, w in windows if len(owners[w]) > 1)
    got = [(int(o), k, int(low), int(high)) for x in family.levels for o, a, b, low, high in zip(*S.repeats(x)) for k in range(a, b + 1)]
    assert sorted(got) == want


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(6)] + [None]
        t = tokens(texts)
        key, text, first, last = S.anchors(t, 10, 3)
        cover = sorted((int(x), i) for x, a, b in zip(text, first, last) for i in range(a, b + 1))
        assert cover == sorted((k, int(t.first[k]) + i) for k, x in enumerate(texts) for i in range(max(0, len(words(x)) - 9)))
        seen = {}
        for k, a, b in zip(key, first, last):
            for i in range(a, b + 1):
                assert seen.setdefault(tuple(t.hashes[i : i + 10].tolist()), k) == k


@pytest.mark.parametrize(("batch_words", "hot"), [(50, 10**9), (300_000, 10**9), (300_000, 0), (50, 4)])
def test_against_all_windows(spark, batch_words, hot):
    rng = random.Random(7)
    v = [f"w{i}" for i in range(200)]
    passages = [[rng.choice(v) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = [rng.choice(v) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = rng.choice(passages)
        docs.append((i % 55 if i % 13 else None, " ".join(w)))
    docs = [(i, t) for i, t in docs if i is None or i > 4] + [(2, " ".join(passages[0] * 2)), (3, None), (4, "")]
    # rows that share an id would need their spans united, which the brute force doesn't do
    got = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), length=12, gram=3, batch_words=batch_words, hot=hot)
    assert sorted(map(tuple, got.collect())) == brute_force(docs, 12)
    assert got.count() > 20


def test_batches_meet_stored_levels(spark, tmp_path):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(100)]
    passages = [[rng.choice(v) for _ in range(rng.randint(12, 40))] for _ in range(5)]
    family, known = S.StoredFamily(spark, str(tmp_path / "family"), length=12, gram=3, buckets=5), []
    for k in range(6):
        batch = []
        for i in range(8):
            w = [rng.choice(v) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages[: k + 1])
            batch.append((100 * rng.randrange(1000) + 10 * k + i, " ".join(w)))
        got = family.add(spark.createDataFrame([*batch, (None, "x"), (7, None)], "doc_id long, text string"))
        known += batch
        want = [r for r in brute_force(known, 12) if r[0] in {i for i, _ in batch}]
        assert sorted(map(tuple, got.collect())) == want
        assert [r for r, _ in family.levels()] == [b for b in range(4, -1, -1) if (k + 1) >> b & 1]
    assert [r for r, _ in S.StoredFamily(spark, str(tmp_path / "family"), 12, 3, 5).levels()] == [2, 1]  # as another session finds it
    assert family.add(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_stays_in_one_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"A, {passage}."), (2, f"B: {passage}! {passage}? End"), (3, passage), (3, "x"), (4, None), (None, passage), (5, "")]
    got = rows(S.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted([(1, docs[0][1]), (2, "B: ? End"), (3, ""), (3, "x"), (4, None), (None, passage), (5, "")], key=repr)
    again = S.repeated_passages(spark.createDataFrame([r for r in got if r[0]], "doc_id long, text string"))
    assert rows(again) == []


def test_many_copies_are_indexed_once(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('own', id, ' ', '{passage}', if(id % 3 = 0, ' tail', concat(' tail', id))) as text")
    for hot in (100, 10**9):
        got = S.repeated_passages(df, hot=hot)
        assert got.count() == got.where("start_word = 1 and end_word = if(doc_id % 3 = 0, 72, 71) and other_doc = if(doc_id = 0, 2997, 0)").count() == 3000


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents_keep_their_columns(spark, clashing):
    got = S.drop_repeated(hostile(spark, clashing), length=3, gram=2)
    assert got.columns == hostile(spark, clashing).columns and got.count() == 11
    assert sorted((r["doc_id"], r["text"]) for r in got.where("doc_id in (8, 9)").collect()) == [(8, "same words here and there"), (9, "")]


def test_repeats_within_one_document_are_none_across_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{passage} x {passage}"), (1, passage), (2, "other")], "doc_id long, text string")
    assert rows(S.repeated_passages(df)) == []
    more = df.union(spark.createDataFrame([(3, f"a b {passage[3:]}")], "doc_id long, text string"))
    assert [r[:3] for r in rows(S.repeated_passages(more))] == [(1, 1, 60), (1, 62, 121), (3, 2, 61)]


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, clashing):
    assert rows(S.repeated_passages(hostile(spark, clashing))) == []
    twice = hostile(spark, clashing).unionByName(hostile(spark, clashing).where("doc_id = 5").replace(5, 50, "doc_id"))
    n = len(words(LONG))
    assert rows(S.repeated_passages(twice)) == [(5, 0, n, 50), (50, 0, n, 5)]


def test_empty_table(spark):
    assert rows(S.repeated_passages(empty(spark))) == []
