"""Typed numeric features: declaration, validation against a schema, and full ranges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_F32 = float.fromhex("0x1.fffffep+127")
_F64 = float.fromhex("0x1.fffffffffffffp+1023")
#: logical type -> (Spark type, least value, greatest value)
TYPES: dict[str, tuple[T.DataType, float, float]] = {
    "u8": (T.ShortType(), 0, 2**8 - 1),
    "u16": (T.IntegerType(), 0, 2**16 - 1),
    "u32": (T.LongType(), 0, 2**32 - 1),
    "u64": (T.LongType(), 0, 2**63 - 1),
    "i8": (T.ByteType(), -(2**7), 2**7 - 1),
    "i16": (T.ShortType(), -(2**15), 2**15 - 1),
    "i32": (T.IntegerType(), -(2**31), 2**31 - 1),
    "i64": (T.LongType(), -(2**63), 2**63 - 1),
    "f32": (T.FloatType(), -_F32, _F32),
    "f64": (T.DoubleType(), -_F64, _F64),
}
_READS = {  # a column of one of these may stand for the logical type
    "f32": (T.FloatType, T.DoubleType),
    "f64": (T.FloatType, T.DoubleType),
}


class UnsupportedFeatureType(TypeError):
    """Only integers and floating-point numbers can be features."""


class MissingFeature(LookupError):
    """A declared feature has no column."""


class UnknownFeature(LookupError):
    """A request names what isn't declared."""


class InvalidRange(ValueError):
    """A range isn't two values of its feature's type."""


def all_hold(checks: list[tuple[Column, str]]) -> Column:
    """True; or an error that says which check failed, for a filter."""
    out = F.lit(True)
    for holds, message in checks:
        out = out & F.isnull(F.assert_true(holds, F.lit(message)))
    return out


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    optional: bool = False

    def __post_init__(self) -> None:
        if self.kind not in TYPES:
            raise UnsupportedFeatureType(f"{self.name}: {self.kind}")

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.kind][0], self.optional)

    @property
    def full_range(self) -> tuple[float, float]:
        """Half-open, so the greatest value itself isn't within."""
        return TYPES[self.kind][1:]

    @property
    def is_float(self) -> bool:
        return self.kind in ("f32", "f64")

    def checked_range(self, bounds: object) -> tuple[float, float]:
        """The two bounds, if they are values of the type: whole numbers within its domain, or finite ones."""
        if not isinstance(bounds, (tuple, list)) or len(bounds) != 2:
            raise InvalidRange(f"{self.name}: a range has a start and an end, not {bounds!r}")
        _, least, most = TYPES[self.kind]
        for x in bounds:
            if isinstance(x, bool) or not isinstance(x, (int, float) if self.is_float else int) or not math.isfinite(x) or not least <= x <= most:
                raise InvalidRange(f"{self.name}: {x!r} is no {self.kind}")
        return bounds[0], bounds[1]

    def valid(self, x: Column) -> Column:
        """Whether a column's value may stand for the feature: within the domain, and there unless it's optional."""
        _, least, most = TYPES[self.kind]
        low, high = (F.lit(float(v)) if self.is_float else F.lit(v).cast("long") for v in (least, most))
        # what is no finite number is stored, as a number's text can't spell it, but never counted
        within = F.lit(True) if self.is_float else x.cast("long").between(low, high)
        return F.coalesce(within, F.lit(True)) if self.optional else x.isNotNull() & F.coalesce(within, F.lit(False))


@dataclass(frozen=True)
class FeatureSet:
    specs: tuple[FeatureSpec, ...]

    def __post_init__(self) -> None:
        if not self.specs:
            raise ValueError("a feature set needs features")
        if len({s.name for s in self.specs}) != len(self.specs):
            raise ValueError("features must have different names")

    @staticmethod
    def of(**kinds: str) -> FeatureSet:
        """``FeatureSet.of(a="u64", b="i16?")``: a question mark makes a feature optional."""
        return FeatureSet(tuple(FeatureSpec(n, k.rstrip("?"), k.endswith("?")) for n, k in kinds.items()))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([s.field for s in self.specs])

    def __getitem__(self, name: str) -> FeatureSpec:
        for s in self.specs:
            if s.name == name:
                return s
        raise UnknownFeature(name)

    def checked(self, df: DataFrame, at: str = "") -> DataFrame:
        """df, but a value that isn't of its feature's type, or is missing though required, fails the job. ``at`` is the
        struct column that holds the features, if one does."""
        column = lambda s: F.col(f"{at}.{s.name}" if at else s.name)
        return df.where(all_hold([(s.valid(column(s)), f"{s.name} isn't of type {s.kind}") for s in self.specs]))

    def widened(self, df: DataFrame) -> DataFrame:
        """df with features as they are compared: whole numbers as 64 bits, the others in double precision."""
        return df.withColumns({s.name: F.col(s.name).cast("double" if s.is_float else "long") for s in self.specs})

    def validate(self, schema: T.StructType) -> None:
        """Every feature has a column of a type that holds it."""
        for s in self.specs:
            if s.name not in schema.names:
                raise MissingFeature(s.name)
            kind = schema[s.name].dataType
            fits = isinstance(kind, _READS[s.kind]) if s.is_float else isinstance(kind, T.IntegralType)
            if not fits:
                raise UnsupportedFeatureType(f"{s.name}: {kind.simpleString()} for {s.kind}")
