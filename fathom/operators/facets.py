"""Count, least and greatest value of features within ranges, which may overlap: all of them in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathom.plans.features import FeatureSet, UnknownFeature

Ranges = Mapping[str, Sequence[tuple[float, float]]]


class Aggregator(Protocol):
    """An aggregation of one's own: what to compute over the matching rows. Partial and final steps are Spark's."""

    def columns(self) -> list[Column]: ...


def aggregate(df: DataFrame, aggregator: Aggregator) -> DataFrame:
    return df.agg(*aggregator.columns())


def _checked(df: DataFrame, ranges: Ranges) -> list[tuple[str, int, float, float]]:
    for name in ranges:
        if name not in df.columns:
            raise UnknownFeature(name)
    return [(name, i, low, high) for name, rs in ranges.items() for i, (low, high) in enumerate(rs)]


def stats_columns(ranges: Ranges) -> list[Column]:
    """For one aggregation: of each range in turn its least and greatest value and its count."""
    out = []
    for k, (name, low, high) in enumerate((n, a, b) for n, rs in ranges.items() for a, b in rs):
        x = F.col(name).cast("double")
        own = F.when((x >= low) & (x < high), x)
        out += [F.min(own).alias(f"min{k}"), F.max(own).alias(f"max{k}"), F.count(own).alias(f"n{k}")]
    return out


def stats_rows(row: Row, ranges: Ranges) -> list[dict]:
    """What ``stats_columns`` gave, as the rows of ``range_stats``."""
    wanted = [(n, i, a, b) for n, rs in ranges.items() for i, (a, b) in enumerate(rs)]
    either = lambda x, other: float(other) if x is None else x
    return [{"feature": n, "bucket": i, "min": either(row[f"min{k}"], b), "max": either(row[f"max{k}"], a), "count": row[f"n{k}"]} for k, (n, i, a, b) in enumerate(wanted)]


def range_stats(df: DataFrame, ranges: Ranges) -> DataFrame:
    """(feature, bucket, lo, hi, min, max, count), one row a range, in double precision. A range without values has the
    end of the range for min and its start for max."""
    wanted = _checked(df, ranges)
    spark = df.sparkSession
    if not wanted:
        return spark.createDataFrame([], "feature string, bucket int, lo double, hi double, min double, max double, count long")
    wide = df.agg(*stats_columns(ranges))
    rows = [
        F.struct(
            F.lit(name).alias("feature"), F.lit(i).alias("bucket"), F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"),
            F.coalesce(f"min{k}", F.lit(float(high))).alias("min"), F.coalesce(f"max{k}", F.lit(float(low))).alias("max"), F.col(f"n{k}").alias("count"),
        )
        for k, (name, i, low, high) in enumerate(wanted)
    ]
    return wide.select(F.inline(F.array(*rows)))


def filtered_stats(df: DataFrame, matches: DataFrame, ranges: Ranges, key: str = "doc_id") -> DataFrame:
    """Over those rows whose key is among the matches."""
    return range_stats(df.join(matches.select(key), key, "left_semi"), ranges)


def full_ranges(features: FeatureSet) -> dict[str, list[tuple[float, float]]]:
    return {s.name: [s.full_range] for s in features.specs}


def as_lists(stats: list) -> dict[str, list[dict]]:
    """Collected rows as {feature: [{min, max, count}, ...]}; features without ranges don't appear."""
    out: dict[str, list[dict]] = {}
    for r in sorted(stats, key=lambda r: (r["feature"], r["bucket"])):
        out.setdefault(r["feature"], []).append({"min": r["min"], "max": r["max"], "count": r["count"]})
    return out
