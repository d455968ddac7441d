from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.operators.topk import after, collect_page, counts, merge_pages, sort_key, top_feature, top_k, tuple_cursor

S = I = None


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    global S, I
    S, I = F.col("score"), F.col("id")


def frame(spark, rows):
    return spark.createDataFrame(rows, "score double, id long")


def scored(spark, **scores):
    """``i7=0.5``: the row 7 with score 0.5."""
    return frame(spark, [(float(v), int(k[1:])) for k, v in scores.items()])


def pairs(df):
    return [(r["score"], r["id"]) for r in df.orderBy("rank").collect()]


def order(df):
    return " ".join(str(i) for _, i in pairs(df))


def test_fewer_rows_than_k(spark):
    df = scored(spark, i11=8, i13=2, i14=5, i15=3)
    assert order(top_k(df, S, I, 4, ascending=True)) == "13 15 14 11"
    assert order(top_k(df, S, I, 9)) == "11 14 15 13"


def test_more_rows_than_k(spark):
    df = scored(spark, i11=8, i13=2, i15=3, i17=9, i19=-2)
    assert order(top_k(df, S, I, 3, ascending=True)) == "19 13 15"
    assert order(top_k(df, S, I, 3)) == "17 11 15"


def test_ties_go_to_the_lowest_id_both_ways(spark):
    df = scored(spark, i13=1, i11=1, i16=1, i15=5, i14=5, i12=1)
    assert order(top_k(df, S, I, 5, ascending=True)) == "11 12 13 16 14"
    assert order(top_k(df, S, I, 5)) == "14 15 11 12 13"


def test_tuple_cursor(spark):
    df = scored(spark, i17=6, i15=7, i13=5, i12=5, i14=5, i11=0, i16=5)
    assert order(top_k(df, S, I, 9, condition=tuple_cursor(S, I, 5, 14, False))) == "16 11"
    assert order(top_k(df, S, I, 9, True, tuple_cursor(S, I, 5, 14, True))) == "12 13 17 15"


def test_second_page_equals_the_rest_of_a_longer_one(spark):
    df = spark.range(100).select(F.col("id"), (-F.col("id")).cast("double").alias("score"))
    assert [i for _, i in pairs(top_k(df, S, I, 3, ascending=True))] == [99, 98, 97]
    assert [s for s, _ in pairs(top_k(df, S, I, 3, ascending=True))] == [-99, -98, -97]
    both = pairs(top_k(df, S, I, 20))
    last = both[9]
    assert pairs(top_k(df, S, I, 10, condition=after(S, I, *last, False))) == both[10:]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.booleans(), st.integers(1, 7))
def test_pages_cover_everything_once(spark, scores, ascending, k):
    df = frame(spark, [(float(s), i) for i, s in enumerate(scores)]).cache()
    seen, condition = [], None
    while True:
        page = pairs(top_k(df, S, I, k, ascending, condition))
        if not page:
            break
        seen += page
        condition = after(S, I, *page[-1], ascending)
    assert seen == sorted(((float(s), i) for i, s in enumerate(scores)), key=lambda x: (x[0] if ascending else -x[0], x[1]))
    df.unpersist()


def test_counts_and_pages(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("score"))
    row = counts(df, S < 30, 10).first()
    assert (row["total"], row["visited"], row["has_next"]) == (100, 30, True)
    page = collect_page(df, S, I, 30, condition=S < 30)
    assert (page.total, page.visited, page.has_next, page.items.count()) == (100, 30, False, 30)
    halves = [collect_page(df.where(c), S, I, 5) for c in ("id < 50", "id >= 50")]
    merged = merge_pages(halves, S, I)
    assert [i for _, i in pairs(merged.items)] == [99, 98, 97, 96, 95]
    assert (merged.total, merged.has_next) == (100, True)


def test_limits_types_and_missing_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, float("nan"), "y"), (3, -1.0, "z")], "id long, v double, s string")
    with pytest.raises(ValueError):
        top_k(df, F.col("v"), F.col("id"), 0)
    with pytest.raises(TypeError):
        top_feature(df, "s", F.col("id"), 3)
    assert [r["id"] for r in top_feature(df, "v", F.col("id"), 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["id"] for r in df.orderBy(sort_key(F.col("v"), True), "id").collect()] == [3, 1, 2]


def test_top_k_is_a_bounded_sort(spark, capsys):
    top_k(spark.range(10), F.col("id"), F.col("id"), 3).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
