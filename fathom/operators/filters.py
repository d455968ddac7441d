"""Half-open range filters over features, as plain predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.features import FeatureSet, UnknownFeature


def range_predicate(ranges: Mapping[str, tuple[float, float] | None], features: FeatureSet | None = None) -> Column:
    """All of the ranges; a feature without one isn't constrained, a missing value never matches. Bounds of declared features
    must be of their type."""
    out = F.lit(True)
    for name, bounds in ranges.items():
        if features is not None:
            features[name]  # unknown names are errors
        if bounds is None:
            continue
        low, high = bounds if features is None else features[name].checked_range(bounds)
        x = F.col(name)
        # single precision is compared as double, like its bounds
        if features is not None and features[name].kind == "f32":
            x = x.cast("double")
        out = out & (x >= low) & (x < high)
    return out


def range_filter(df: DataFrame, ranges: Mapping[str, tuple[float, float] | None], features: FeatureSet | None = None) -> DataFrame:
    for name in ranges:
        if name not in df.columns:
            raise UnknownFeature(name)
    return df.where(range_predicate(ranges, features))
