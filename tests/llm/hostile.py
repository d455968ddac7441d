"""Documents with everything that may be wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} number{i % 131}" for i in range(60_000))
ROWS = [
    (1, "Plain text about nothing much, in one line.", "en", "a", 43),
    (1, "Plain text about nothing much, in one line.", "en", "a", 43),  # a repeated row
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "\n\n \t\n", "en", "b", 5),
    (None, "A document without an id.", "en", "b", 25),
    (5, LONG, "en", "a", len(LONG)),
    (6, "İstanbul ǅ ﬁ 数学 \U0001f600 é \x00 end", "tr", "c", 20),
    (7, "x", None, "c", 1),
    (8, "same words here and there", "en", "a", 25),
    (9, "same words here and there", "en", "b", 25),  # a tie
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASHING = "d t id h k key keys bad_ kept_ lines_ line lines_in lines_dropped gone_ rn_ copies contaminated s e o f block level group_id keep comp leader text_ toxic score unit w l n rank".split()


def hostile(spark: SparkSession, clashing: bool = False) -> DataFrame:
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clashing else df


def empty(spark: SparkSession, clashing: bool = False) -> DataFrame:
    return hostile(spark, clashing).where("false")


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
