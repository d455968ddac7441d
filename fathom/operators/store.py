"""Record store: whole records by id or uuid, and pages of ids turned into records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.plans.features import all_hold


class MissingRecord(LookupError):
    """An id without a record."""


def last_wins(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of rows with equal keys the one that came last."""
    by = Window.partitionBy(key).orderBy(F.desc(sequence))
    return df.withColumn("rn_", F.row_number().over(by)).where("rn_ = 1").drop("rn_")


def hydrate(page: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """The records of a page (key, rank, ...) in its order; a record that isn't there fails the job. The page is the small
    side, whatever the store's size; a join strategy by size is Spark's choice."""
    there = "there_"
    while there in (*page.columns, *records.columns):
        there += "_"
    met = page.join(records.withColumn(there, F.lit(True)), key, "left")
    return met.where(all_hold([(F.col(there).isNotNull(), "a page names a record that is missing")])).drop(there).orderBy("rank")


def hydrate_all(page: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same, but what is missing is looked for first, and named."""
    lost = page.join(records, key, "left_anti").select(key).limit(3).collect()
    if lost:
        raise MissingRecord(", ".join(str(r[0]) for r in lost))
    return hydrate(page, records, key)


class RecordStore:
    """Records in Parquet files, with a number of the load that brought them; the last of a key wins."""

    SEQUENCE = "load_seq"

    def __init__(self, spark: SparkSession, path: str, key: str = "recipe_id", uuid: str = "uuid") -> None:
        self.spark, self.path, self.key, self.uuid = spark, path, key, uuid

    @staticmethod
    def create(df: DataFrame, path: str, key: str = "recipe_id", uuid: str = "uuid") -> RecordStore:
        """A store mustn't be there already."""
        df.withColumn(RecordStore.SEQUENCE, F.lit(0).cast("long")).write.mode("errorifexists").parquet(path)
        return RecordStore(df.sparkSession, path, key, uuid)

    def append(self, df: DataFrame, sequence: int) -> None:
        df.withColumn(self.SEQUENCE, F.lit(sequence).cast("long")).write.mode("append").parquet(self.path)

    def records(self) -> DataFrame:
        return last_wins(self.spark.read.parquet(self.path), self.key, self.SEQUENCE).drop(self.SEQUENCE)

    def find_by_id(self, id_: int) -> DataFrame:
        # the condition reaches the scan, as it's on the window's partition
        return self.records().where(F.col(self.key) == id_)

    def find_by_uuid(self, uuid: str) -> DataFrame:
        # first the few ids that ever had it, then what is last of those: the store itself isn't shuffled
        raw = self.spark.read.parquet(self.path)
        ids = raw.where(F.col(self.uuid) == str(uuid)).select(self.key).distinct()
        return last_wins(raw.join(ids, self.key, "left_semi"), self.key, self.SEQUENCE).drop(self.SEQUENCE).where(F.col(self.uuid) == str(uuid))

    def id_for_uuid(self, uuid: str) -> int | None:
        row = self.find_by_uuid(uuid).select(self.key).first()
        return None if row is None else row[0]

    def ids(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select(self.key).distinct()

    def __len__(self) -> int:
        return self.ids().count()
