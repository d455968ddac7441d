"""Sources and sinks: JSON lines in, CSV and JSON out, fixed-width logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.features import FeatureSet, all_hold
from fathom.sources.shared import cut, exists

FEATURES = FeatureSet.of(
    num_ingredients="u8", instructions_length="u32", prep_time="u32?", total_time="u32?", cook_time="u32?", calories="u32?", fat_content="f32?", carb_content="f32?",
    protein_content="f32?", diet_lowcarb="f32?", diet_vegetarian="f32?", diet_vegan="f32?", diet_keto="f32?", diet_paleo="f32?",
)
TEXT_FIELDS = ("name", "ingredients", "instructions")
_strings = T.ArrayType(T.StringType())
RECIPE = T.StructType(
    [
        T.StructField("uuid", T.StringType(), False), T.StructField("recipe_id", T.LongType(), False), T.StructField("name", T.StringType(), False),
        T.StructField("crawl_url", T.StringType(), False), T.StructField("ingredients", _strings, False), T.StructField("instructions", _strings, False),
        T.StructField("images", _strings, False), T.StructField("similar_recipe_ids", T.ArrayType(T.LongType()), False), T.StructField("features", FEATURES.schema, False),
    ]
)


class InvalidData(ValueError):
    """A file that isn't what it should be."""


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECIPE) -> DataFrame:
    """One JSON object a line; anything else fails the job, and so does a record without a field that the schema requires, or
    with a feature beyond its type's domain."""
    read = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    required = read.where(all_hold([(F.col(f"`{f.name}`").isNotNull(), f"{f.name} is required") for f in schema if not f.nullable]))
    return FEATURES.checked(required, "features") if schema is RECIPE else required


def flattened(records: DataFrame) -> DataFrame:
    """Features as columns beside the others."""
    return records.select(*[c for c in records.columns if c != "features"], "features.*")


def card(records: DataFrame) -> DataFrame:
    """What lists show of a record (with its features as columns): its first image only."""
    return records.select("name", "uuid", "crawl_url", "num_ingredients", "instructions_length", F.get("images", F.lit(0)).alias("image"), "total_time", "calories")


def info(records: DataFrame) -> DataFrame:
    """What a record's own page shows."""
    return records.select("uuid", "name", "crawl_url", "num_ingredients", "ingredients", "instructions", "images", "total_time", "calories")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row (json); null fields and empty arrays are left out."""
    columns = []
    for f in df.schema:
        own = F.col(f"`{f.name}`")
        columns.append((F.when(F.size(own) > 0, own) if isinstance(f.dataType, T.ArrayType) else own).alias(f.name))
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


class FixedLog:
    """An append-only log of entries of one width, in the order of their appends: (number, entry: binary)."""

    def __init__(self, spark: SparkSession, path: str, width: int) -> None:
        """Opens a log, or begins one where there is none; a log of another width is an error."""
        if width <= 0:
            raise InvalidData("an entry has at least one byte")
        self.spark, self.path, self.width = spark, path, width
        if exists(spark, path) and not self.entries().where(F.length("entry") != width).isEmpty():
            raise InvalidData(f"{path} has entries that aren't of {width} bytes")

    def entries(self) -> DataFrame:
        return self.spark.read.schema("number long, entry binary").parquet(self.path)

    def append(self, df: DataFrame, order: list[str | Column], entry: Column) -> None:
        """Appends an entry for each row, by that order; entries of another width fail the job, and none is appended."""
        first = len(self)
        checked = df.select(entry.alias("entry"), *[F.col(x).alias(f"o{i}") if isinstance(x, str) else x.alias(f"o{i}") for i, x in enumerate(order)])
        checked = checked.where(all_hold([(F.coalesce(F.length("entry") == self.width, F.lit(False)), f"an entry isn't of {self.width} bytes")]))
        keys = [f"o{i}" for i in range(len(order))]
        # numbers by ranges of the order: each range counts its own, and begins where those before it end
        ranged = checked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p", F.spark_partition_id())
        held = cut(ranged.withColumn("i", F.monotonically_increasing_id() % (1 << 33)))
        before = held.groupBy("p").agg((F.max("i") + 1).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n"))
        numbered = held.join(F.broadcast(before), "p").select((F.col("before") + F.col("i") + first).alias("number"), "entry")  # as many rows as ranges
        numbered.write.mode("append").parquet(self.path)

    def __len__(self) -> int:
        return self.entries().count() if exists(self.spark, self.path) else 0


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, Callable[[Column], Column]]], entry: int) -> DataFrame:
    """The entries of append-only logs of fixed-width entries: (path, number, one column a field). fields are
    (name, width, decoder of a binary column); a file whose size isn't a multiple of an entry is an error."""
    files = spark.read.format("binaryFile").load(path)
    bad = files.where(F.col("length") % entry != 0).select("path").limit(1).collect()
    if bad:
        raise InvalidData(f"{bad[0][0]} isn't a multiple of {entry} bytes")
    numbered = files.where("length > 0").select("path", "content", F.explode(F.sequence(F.lit(0), (F.col("length") / entry).cast("int") - 1)).alias("number"))
    columns, at = [], 1
    for name, width, decode in fields:
        columns.append(decode(F.substring("content", F.col("number") * entry + at, F.lit(width))).alias(name))
        at += width
    return numbered.select("path", "number", *columns)


def unsigned(raw: Column) -> Column:
    """A big-endian integer of up to 8 bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("long")
