"""The pipeline against a chain of plain loops, and over odd tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import decontaminate, line_dedup
from tests.llm import test_decontaminate, test_minhash, test_mixing, test_toxicity
from tests.llm.hostile import CLASHING, empty, hostile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    rng = random.Random(seed)
    docs, labels = test_toxicity.labelled(260, seed)
    items = [(i, " ".join(f"question{rng.randrange(10_000)}" for _ in range(rng.randint(8, 20)))) for i in range(12)]
    texts = []
    for i, t in docs:
        w = t.split(" ")
        lines = [" ".join(w[k : k + 25]) for k in range(0, len(w), 25)]
        if i % 4 == 1:
            lines.insert(rng.randrange(len(lines) + 1), "A line   that very many\tdocuments have.")
        if i % 9 == 2:
            lines.append(f"Before. {rng.choice(items)[1].upper()}! After.")
        texts.append("\n".join(lines))
    for k in range(60):  # copies, exact ones and near ones
        t = rng.choice(texts[:30])
        texts.append(t if k % 2 else f"{t} and one more {k}")
    return [(i, t, "en", rng.choice("aab"), len(t)) for i, t in enumerate(texts)], labels, items


def without_frequent_lines(docs):
    norm = lambda x: re.sub("[ \t\r]+", " ", x).lower().strip(" ")
    owner = {}
    for i, t, *_ in docs:
        owner[t] = min(i, owner.get(t, i))
    having = {}
    for t, i in owner.items():
        for x in {norm(x) for x in t.split("\n")} - {""}:
            having.setdefault(x, {})[i] = t
    keeper = {x: own[min(own)] for x, own in having.items() if len(own) > line_dedup.MAX_DOCUMENTS}
    return [(i, "\n".join(x for x in t.split("\n") if keeper.get(norm(x), t) == t), *rest) for i, t, *rest in docs]


def without_passages(text, items):
    (found,) = test_decontaminate.brute_force(items, [text], decontaminate.N, decontaminate.LEAST)
    place = [m.span() for m in re.finditer(r"\w+", text.lower())]
    return decontaminate.remove_spans(text, [(place[a][0], place[b - 1][1]) for a, b, _ in decontaminate.merged(found)])


def by_hand(spark, docs, labels, items):
    p = test_toxicity.whole_by_hand(spark, [(i, t) for i, t, *_ in docs], labels)
    docs = without_frequent_lines([d for d in docs if p[d[0]][1] < 0.5])
    _, groups = test_minhash.brute_force([d[:2] for d in docs])
    docs = [d for d in docs if groups.get(d[0], d[0]) == d[0]]
    docs = [(i, without_passages(t, items), *rest) for i, t, *rest in docs]
    copies = test_mixing.sequential(spark, [(i, s, t) for i, t, _, s, _ in docs], 1, 64, key="xxhash64(doc_id, source, text)")
    return sorted((i, t, lang, s, len(t), copies[i]) for i, t, lang, s, _ in docs if copies[i])


def tables(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_the_whole_pipeline_against_plain_loops(spark, tmp_path):
    docs, labels, items = corpus(5)
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, spark.createDataFrame(docs, SCHEMA).repartition(3), labels, items))
    want = by_hand(spark, docs, labels, items)
    assert sorted(map(tuple, got.collect())) == want
    assert 100 < len(want) < 260 and not any("QUESTION" in r[1] for r in want) and sum("very many" in r[1] for r in want) <= 1


@pytest.mark.parametrize("clashing", [False, True])
def test_hostile_documents(spark, tmp_path, clashing):
    df = hostile(spark, clashing)
    kept = [c for c in CLASHING if clashing]
    sf = tables(spark, tmp_path, df, [(1, 0), (8, 0), (None, 1), (5, None)], [(1, "a b c d e f g h"), (None, "x"), (2, None)])
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:-1] == df.columns and out.columns[-1].startswith("copies")
    assert all(set(r) == {"clash"} for r in out.select(*kept).collect()) if kept else True
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = stage(spark, before, sf)
        assert before.schema.names == df.columns
    # of the repeated row and of the tie one stays each; nothing else goes
    ids = sorted((r["doc_id"] for r in before.select("doc_id").collect()), key=repr)
    assert ids == sorted([1, 2, 3, 4, None, 5, 6, 7, 8], key=repr)
    assert before.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_empty_tables(spark, tmp_path, clashing):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, empty(spark, clashing), [], []))
    assert out.count() == 0 and out.columns[:-1] == empty(spark, clashing).columns


def test_only_the_last_result_stays_in_the_shared_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} of a few", "en", "a", 5) for i in range(5)], SCHEMA)
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs, [], []))
    folder = out.select(F.input_file_name()).first()[0].split("/pipeline-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder[0]}/pipeline-{folder[1].split('/')[0]}")
    assert [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)] == ["4"]
