"""A corpus pipeline: five training-data operators, one after another.

Each stage takes what its predecessor kept, as written and read again, and its decisions take effect: toxic documents go,
lines that many different texts share go from all but one of them, one document of each group of near copies stays, passages of the
benchmark are cut out, and the sources are mixed. All stages but the last return the columns of documents; the last adds
``copies``, how often a document is to be seen, and leaves out those that aren't drawn.

Defined results
- null or empty text: never toxic unless labels say so, without lines, copies or spans; it goes through all stages.
- null id: goes through; it counts for no line's documents and is never a copy. Null source: a source of its own.
- very long texts: whole in every stage. Ties: of copies the smallest id stays.
- repeated rows, and rows of one id with similar texts: one of them stays after near-dedup. Empty tables: an empty result.
- further columns of documents, whatever their names, stay as they are; ``n_chars`` is the text's new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from fathom.llm.common import delete, scratch, table


def _as_documents(edited: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as the text now is."""
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if x == "n_chars" else F.col(f"`{x}`") for x in docs.columns]
    return edited.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(line_dedup.line_dedup(docs, keep_one=True), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_frequent_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
]

#: Trees, MinHash groups, spans within texts and random rounding aren't SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again. What the next stage has
    read goes at once, the last result when the driver ends."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
