"""The inverted index: plain tables, built by Spark and stored as Parquet.

forward (doc_id, field, dl, terms, tfs, positions) has a row for each document's field, as the documents came.
postings (doc_id, field, term, tf, dl, positions) is the same by term, sorted, so that a lookup's pushed-down filter skips
nearly all row groups; dl, the length of the document's field, is kept with each posting and saves a join per query.
term_stats (field, term, df), field_stats (field, total_length), corpus (n_docs), docs (all other columns).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import inverted
from fathom.sources.shared import exists

TABLES = {
    "docs": ("doc_id",), "forward": ("doc_id", "field", "dl", "terms", "tfs", "positions"), "postings": ("doc_id", "field", "term", "tf", "dl", "positions"),
    "term_stats": ("field", "term", "df"), "field_stats": ("field", "total_length"), "corpus": ("n_docs",),
}


class MissingTable(LookupError):
    """A stored index lacks a table or a column."""


class IndexExists(FileExistsError):
    """A folder to store an index in is there already."""


def postings_of(forward: DataFrame) -> DataFrame:
    pairs = forward.select("doc_id", "field", "dl", "tfs", "positions", F.posexplode("terms").alias("i", "term"))
    return pairs.select("doc_id", "field", "term", F.get("tfs", F.col("i")).alias("tf"), "dl", F.get("positions", F.col("i")).alias("positions"))


def term_stats_of(forward: DataFrame) -> DataFrame:
    return forward.select("field", F.explode("terms").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))


def field_stats_of(forward: DataFrame) -> DataFrame:
    return forward.groupBy("field").agg(F.sum("dl").alias("total_length"))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    fields: list[str]
    forward: DataFrame
    corpus: DataFrame

    @staticmethod
    def build(docs: DataFrame, fields: dict[str, Column], key: str = "doc_id") -> Index:
        """Over docs, whose key names each document once; fields are full-text columns."""
        return Index.over(docs.withColumnRenamed(key, "doc_id"), inverted(docs, key, fields).withColumnRenamed(key, "doc_id"), list(fields))

    @staticmethod
    def over(docs: DataFrame, forward: DataFrame, fields: list[str]) -> Index:
        """All other tables follow from these two."""
        return Index(docs, postings_of(forward), term_stats_of(forward), field_stats_of(forward), fields, forward, docs.agg(F.count("*").alias("n_docs")))

    def write(self, path: str, overwrite: bool = False, rows_per_file: int = 0) -> Index:
        """Stores the tables; a folder that is there already is an error, before anything is computed, unless it's to be
        replaced. rows_per_file bounds files (0: one for each task), as a commit interval would."""
        spark = self.docs.sparkSession
        if not overwrite and exists(spark, path):
            raise IndexExists(f"{path} already exists")

        def store(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        # texts are taken apart once; all that follows is read from what that gave
        forward = store(self.forward, "forward")
        # ranges of (term, document): the postings of a frequent term lie in as many files as they need
        postings = store(postings_of(forward).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "field", "doc_id"), "postings")
        # sorted by term, they count up within each task; hardly anything is left to shuffle
        stats = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
        store(stats.repartitionByRange("term").sortWithinPartitions("term", "field"), "term_stats")
        store(field_stats_of(forward).coalesce(1), "field_stats")
        docs = store(self.docs, "docs")
        store(docs.agg(F.count("*").alias("n_docs")), "corpus")
        return Index.open(spark, path, self.fields)

    @staticmethod
    def open(spark: SparkSession, path: str, fields: list[str]) -> Index:
        """A stored index, its columns resolved by name."""
        t = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}
        for n, wanted in TABLES.items():
            for w in wanted:
                if w not in t[n].columns:
                    raise MissingTable(f"{n}.{w}")
        return Index(t["docs"], t["postings"], t["term_stats"], t["field_stats"], fields, t["forward"], t["corpus"])

    def num_docs(self) -> DataFrame:
        """One row: n_docs."""
        return self.corpus.select("n_docs")

    def doc_freq(self, field: str, term: str) -> DataFrame:
        return self.term_stats.where((F.col("field") == field) & (F.col("term") == term))

    def doc_terms(self, doc_id: int, field: str | None = None) -> DataFrame:
        """(field, term, tf) of one document, from its own rows."""
        own = self.forward.where(F.col("doc_id") == doc_id)
        own = own if field is None else own.where(F.col("field") == field)
        return own.select("field", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("field", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
