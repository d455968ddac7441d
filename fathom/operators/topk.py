"""Top-k in both directions, keyset pages, and counts of what was seen.

Ties go to the lowest id, whichever the direction, and cursors agree with that, so pages neither repeat nor skip rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _positive(limit: int) -> int:
    if limit <= 0:
        raise ValueError("a limit must be positive")
    return limit


def sort_key(key: Column, is_float: bool = False) -> Column:
    """A feature as a sort key: what is missing counts as 0, and so does NaN."""
    key = F.coalesce(key, F.lit(0))
    return F.nanvl(key, F.lit(0.0)) if is_float else key


def after(key: Column, id_: Column, value: float, last_id: int, ascending: bool) -> Column:
    """What comes after the row (value, last_id)."""
    beyond = key > value if ascending else key < value
    return beyond | ((key == value) & (id_ > last_id))


def tuple_cursor(key: Column, address: Column, value: float, last: int, ascending: bool) -> Column:
    """The pivot condition on (score, address) as such: addresses break ties in the direction of the sort. On ascending
    sorts that doesn't agree with ties going to the lowest address: pages may repeat rows. Use ``after`` to paginate."""
    if ascending:
        return (key > value) | ((key == value) & (address < last))
    return (key < value) | ((key == value) & (address > last))


def top_k(df: DataFrame, key: Column, id_: Column, k: int, ascending: bool = False, condition: Column | None = None) -> DataFrame:
    """The k first rows, each with its rank from 1. The sort never sees more than k rows a task."""
    rows = df if condition is None else df.where(condition)
    order = [key.asc() if ascending else key.desc(), id_.asc()]
    page = rows.orderBy(*order).limit(_positive(k))
    # a window without partitions, over k rows
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_feature(df: DataFrame, feature: str, id_: Column, k: int, ascending: bool = False) -> DataFrame:
    """By a numeric column; anything else is a TypeError."""
    kind = df.schema[feature].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{feature} is {kind.simpleString()}")
    return top_k(df, sort_key(F.col(feature), isinstance(kind, (T.FloatType, T.DoubleType))), id_, k, ascending)


def counts(df: DataFrame, condition: Column, k: int) -> DataFrame:
    """One row: total (before the condition), visited (after it), has_next (more than a page)."""
    seen = df.agg(F.count("*").alias("total"), F.count_if(condition).alias("visited"))
    return seen.select("total", "visited", (F.col("visited") > _positive(k)).alias("has_next"))


@dataclass
class Page:
    """What a collector found: items is a DataFrame of at most k ranked rows."""

    items: DataFrame
    total: int
    visited: int
    k: int

    @property
    def has_next(self) -> bool:
        return self.visited > self.k


def collect_page(df: DataFrame, key: Column, id_: Column, k: int, ascending: bool = False, condition: Column | None = None) -> Page:
    row = counts(df, F.lit(True) if condition is None else condition, k).first()
    return Page(top_k(df, key, id_, k, ascending, condition), row["total"], row["visited"], k)


def merge_pages(pages: list[Page], key: Column, id_: Column, ascending: bool = False) -> Page:
    """Pages of disjoint parts as one, by the sizes of the first."""
    items = pages[0].items
    for p in pages[1:]:
        items = items.unionByName(p.items)
    return Page(top_k(items.drop("rank"), key, id_, pages[0].k, ascending), sum(p.total for p in pages), sum(p.visited for p in pages), pages[0].k)
