from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import toxicity
from fathom.llm.common import tokens
from tests.llm.hostile import empty, hostile, rows

DATA = "/root/testdata/sf0.1"


def labelled(n, seed):
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(300)]
    bad = [f"vilgar{x}" for x in "abcdefghij"]  # insults nobody has listed
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rng.choice(common) for _ in range(rng.choice([20, 80, 300]))]
        for _ in range(rng.randint(3, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = labelled(1600, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = spark.createDataFrame(labels[:1200], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, train).collect()}
    held = labels[1200:]
    assert sum(got[i]["toxic"] == bool(y) for i, y in held) >= 0.97 * len(held)
    assert sum(got[i]["toxic"] for i, y in held if not y) <= 2


def test_held_out_documents_of_the_tables(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = toxicity.fit(docs, labels.where(fold != 0))
    held = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where(fold == 0), "doc_id")
    n = {(r["toxic"], r["said"]): r["count"] for r in held.groupBy("toxic", "said").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]


def test_probabilities_are_calibrated(spark):
    docs, labels = labelled(2000, 2)
    rng = random.Random(3)
    noisy = [(i, int(y if rng.random() > 0.1 else not y)) for i, y in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["probability"] for r in toxicity.toxicity(df, spark.createDataFrame(noisy[:1500], "doc_id long, toxic int")).collect()}
    held = noisy[1500:]
    high = [y for i, y in held if got[i] > 0.5]
    low = [y for i, y in held if got[i] <= 0.5]
    assert np.mean(high) > 0.75 and np.mean(low) < 0.2


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        x, y = rng.integers(0, 8, n).astype(float), rng.integers(0, 2, n).astype(float)
        xs, ys = toxicity.isotonic(x, y)
        assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()
        # min-max formula of isotonic regression at each score
        for v in np.unique(x):
            want = max(min(y[(x >= a) & (x <= b)].mean() for b in np.unique(x) if b >= v) for a in np.unique(x) if a <= v)
            assert np.interp(v, xs, ys) == pytest.approx(want)


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = toxicity.fit_trees(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def by_hand(text, learned):
    """The features of one text, word by word."""
    text = text or ""
    ws = re.findall(r"\w+", text.lower())
    if not ws:
        return [0.0] * len(toxicity.FEATURES)
    n, chars = len(ws), len(text)

    def weight(w):
        if w in learned:
            return learned[w]
        return next((learned[w[:k] + "*"] for k in (7, 6, 5, 4) if len(w) > k and w[:k] + "*" in learned), 0.0)

    v = [weight(w) for w in ws]
    insult, second = [w in toxicity.INSULTS for w in ws], [w in toxicity.SECOND for w in ws]
    at = [i for i in range(n) if insult[i] or v[i] > 0]
    you = [i for i in range(n) if second[i]]
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return [
        sum(insult) / n, np.log1p(sum(insult)), sum(x > 0 for x in v) / n, np.log1p(sum(x > 0 for x in v)), sum(v) / n, max(v), np.log1p(len({w for w, x in zip(ws, v) if x > 0})),
        max((1 / (1 + abs(i - j)) for i in at for j in you), default=0), sum(second) / n, upper / max(1, upper + lower), len(re.findall(r"\b[A-Z]{3,}\b", text)) / n,
        text.count("!") / chars, len(re.findall(r"[!-/:-@\[-`{-~]", text)) / chars, len(re.findall(r"(?<=[^\W\d_])[0-9@$!*]+(?=[^\W\d_])", text)) / n, np.log1p(n),
        max((sum(i <= j < i + 50 for j in at) for i in at), default=0),
    ]


def test_features_against_a_count_by_hand():
    rng = random.Random(8)
    learned = {"vile": 2.0, "vilesta*": 1.5, "grub*": 3.0, "grubbi*": 0.5, "éclat": 1.25}
    pieces = "vile Vilestann grub grubby GRUBBIEST éclat idiot YOU you tú the of a THE st0pid a$$hat 12 x_y! ... d'un 数学 ABC ABc \n e! İ".split(" ")
    texts = [None, "", "...", "you", "a1b c2 3d e4\nf"] + [" ".join(rng.choice(pieces) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(60)]
    hashed = {(len(u) - 1 if u.endswith("*") else 0, int(tokens([u.strip("*")]).hashes[0])): w for u, w in learned.items()}
    got = toxicity.feature_rows(texts, toxicity.Lexicon(hashed))
    for t, row in zip(texts, got):
        assert row.tolist() == pytest.approx(by_hand(t, learned)), t
    assert toxicity.feature_rows([], toxicity.Lexicon({})).shape == (0, len(toxicity.FEATURES))
    assert toxicity.feature_rows(["idiot"], toxicity.Lexicon({}))[0, 1] == np.log(2)


def trees_by_hand(x, y, n_trees=60, depth=3, rate=0.2):
    """Boosted trees with every split of every leaf tried on the rows themselves; (base, trees), a tree being a function."""
    cuts = [sorted({*np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]).tolist(), 0.0}) for j in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, trees = np.full(len(y), base), []

    def grown(own, g, h, deep):
        G, H = g[own].sum(), h[own].sum()
        if deep == 0:
            value = rate * min(4, max(-4, G / (H + 1)))
            return lambda row: value
        best, gain = None, 1e-6
        for j in range(x.shape[1]) if len(own) >= 4 else ():
            scored = []
            for cut in cuts[j]:
                left = own[x[own, j] <= cut]
                if 2 <= len(left) <= len(own) - 2:
                    gl, hl = g[left].sum(), h[left].sum()
                    scored.append((gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1), cut))
            most = max((v for v, _ in scored), default=-1)
            if most > gain + toxicity.TIE:
                best, gain = (j, min(cut for v, cut in scored if v >= most - toxicity.TIE)), most
        if best is None:
            leaf = grown(own, g, h, 0)
            return leaf
        j, cut = best
        left, right = grown(own[x[own, j] <= cut], g, h, deep - 1), grown(own[x[own, j] > cut], g, h, deep - 1)
        return lambda row: left(row) if row[j] <= cut else right(row)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        tree = grown(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-9), depth)
        raw = raw + np.array([tree(row) for row in x])
        trees.append(tree)
    return lambda row: base + sum(t(row) for t in trees)


def whole_by_hand(spark, docs, labels):
    """{id: (score, probability)} of the operator, with plain words, counts and loops."""
    toxic = {}
    for i, y in labels:
        if i is not None and y is not None and any(i == d for d, _ in docs):
            toxic[i] = max(toxic.get(i, 0), int(y > 0))
    ids = spark.createDataFrame([(i,) for i in toxic], "id long").selectExpr("id", "pmod(xxhash64(id, 12), 10) as fold").collect()
    fold = {r["id"]: r["fold"] for r in ids}
    texts = {i: min(t for d, t in docs if d == i) for i in toxic}
    first = [i for i in toxic if fold[i] < 5]
    n = [sum(toxic[i] == y for i in first) for y in (0, 1)]
    seen = ({}, {})
    for i in first:
        ws = set(re.findall(r"\w+", texts[i].lower()))
        for unit in ws | {w[:k] + "*" for w in ws for k in toxicity.PREFIXES if len(w) > k}:
            seen[toxic[i]][unit] = seen[toxic[i]].get(unit, 0) + 1
    weigh = lambda u: np.log((seen[1][u] + 0.5) / (n[1] + 1)) - np.log((seen[0].get(u, 0) + 0.5) / (n[0] + 1))
    learned = {u: weigh(u) for u, k in seen[1].items() if k >= 3 and weigh(u) >= np.log(12)}
    rows_ = lambda own: (np.array([by_hand(texts[i], learned) for i in own]), np.array([float(toxic[i]) for i in own]))
    score = trees_by_hand(*rows_([i for i in toxic if 5 <= fold[i] < 8]))
    x, y = rows_([i for i in toxic if fold[i] >= 8])
    raw = [score(r) for r in x]
    xs, ys = toxicity.isotonic(np.array(raw), y, sum(toxic.values()) / len(toxic), 4.0)  # held to its own brute force above
    return {i: (s := score(by_hand(t, learned)), float(np.interp(s, xs, ys))) for i, t in docs}


def test_the_whole_operator_against_one_by_hand(spark):
    docs, labels = labelled(400, 11)
    labels = [*labels[:300], (3, None), (None, 1), (5, 0), (10_000, 1)]
    want = whole_by_hand(spark, docs, labels)
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and {r["toxic"] for r in got} == {True, False}
    for r in got:
        assert (r["score"], r["probability"]) == pytest.approx(want[r["doc_id"]], abs=1e-7)
        assert r["toxic"] == (r["probability"] >= 0.5)


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    docs, labels = labelled(300, 6)
    many = labels + [(1_000_000 + i, i % 2) for i in range(20_000)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(many, "doc_id long, toxic int"), max_positive=1_000, max_negative=1_000)
    assert model.n_train == 300


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, clashing):
    labels = spark.createDataFrame([(1, 0), (None, 1), (8, None), (8, 1), (8, 0), (5, 0), (77, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(hostile(spark, clashing), labels)
    assert got.columns == ["doc_id", "score", "probability", "toxic"]
    assert got.count() == hostile(spark).count()
    kept = toxicity.drop_toxic(hostile(spark, clashing), labels)
    assert kept.columns == hostile(spark, clashing).columns and 1 <= kept.count() <= 11


def test_without_labels_nothing_is_toxic(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in toxicity.toxicity(hostile(spark), none).collect())
    assert toxicity.drop_toxic(hostile(spark), none).count() == 11
    clean = spark.createDataFrame([(1, 0), (8, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(hostile(spark), clean).count() == 11
    assert rows(toxicity.toxicity(empty(spark), clean)) == []


def test_the_sample_of_labels_is_bounded(spark):
    docs, labels = labelled(400, 5)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), max_positive=30, max_negative=60)
    assert model.n_train == 90
