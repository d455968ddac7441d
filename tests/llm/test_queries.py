from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from fathom.llm import queries
from fathom.llm.common import lowered, ngrams, tokens, words

DATA, MORE = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, str(DATA))
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(got.columns) == order
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_tokens_agree_with_the_expression():
    texts = ["Eins, zwei_drei 4!", None, "", "İstanbul ΑΣ \U0001f600x\U00010400 数学", "a\x00b\ud800c", "ǅ ﬁ" * 50]
    t = tokens(texts)
    seen = {}
    for i, x in enumerate(texts):
        ws = words(x)
        assert t.first[i + 1] - t.first[i] == len(ws)
        for k, w in enumerate(ws):
            j = t.first[i] + k
            assert lowered(x)[t.start[j] : t.end[j]] == w
            assert seen.setdefault(w, t.hashes[j]) == t.hashes[j]
    assert len(set(seen.values())) == len(seen)
    h, text, at = ngrams(t, 2)
    assert [(int(a), int(b)) for a, b in zip(text, at)] == [(i, j) for i in range(len(texts)) for j in range(t.first[i], t.first[i + 1] - 1)]


def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions take effect on what its predecessor kept."""
    from fathom.llm import decontaminate, line_dedup, minhash

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "mixing"]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], str(MORE)).cache()
        if k < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
            assert out.where("n_chars <> length(text)").count() == 0
        kept.append(out)
    clean, lines, near, cut, mixed = kept[1:]
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    assert clean.join(labels.where("toxic = 0"), "doc_id").count() >= 0.97 * docs.join(labels.where("toxic = 0"), "doc_id").count()
    assert lines.count() == clean.count()
    assert line_dedup.kept_lines(line_dedup.line_hashes(lines), 1).join(line_dedup.kept_lines(line_dedup.line_hashes(clean)), "h", "left_semi").count() == 0  # one text has each
    groups = minhash.near_duplicate_groups(lines)
    assert near.count() == lines.count() - groups.where("not keep").count()
    assert decontaminate.contaminated_spans(cut, spark.read.parquet(f"{MORE}/benchmark.parquet")).count() == 0
    assert cut.count() == near.count()
    assert mixed.columns == [*docs.columns, "copies"] and mixed.where("copies < 1").count() == 0
    assert mixed.join(cut, "doc_id", "left_anti").count() == 0


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.count() > 50 and len({r["doc_id"] for r in out.select("doc_id").collect()}) == out.count()
