"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate as _decontaminate
from fathom.llm import line_dedup as _line
from fathom.llm import minhash as _minhash
from fathom.llm import mixing as _mixing
from fathom.llm import quality as _quality
from fathom.llm import secrets as _secrets
from fathom.llm import suffix_dedup as _suffix
from fathom.llm import toxicity as _toxicity
from fathom.llm import url_filter as _url
from fathom.llm import warc as _warc
from fathom.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url.url_filter(table(spark, sf_dir, "pages"), _url.rules_table(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.apply_policies(_quality.ledger(table(spark, sf_dir, "documents")))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.ablations(_quality.ledger(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return spans.withColumns({"items": F.array_join("items", ","), "n_items": F.size("items").cast("long")})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.round_trip(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_mixing draws, held against each source's expected copies."""
    return _mixing.totals(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_toxicity, op3_quality_rules, quality_ablations, op4_decontaminate, op5_warc, op6_secret_scan, op7_minhash,
        op8_suffix_dedup, op9_mixing, mixing_totals, op10_line_dedup,
    )
}
SQL: dict[str, str] = {
    "op1_url_filter": _url.sql(),
    "op3_quality_rules": _quality.SQL,
    "quality_ablations": _quality.ABLATION_SQL,
    "op4_decontaminate": _decontaminate.SQL,
    "op5_warc": _warc.SQL,
    "op6_secret_scan": _secrets.SQL,
    "op8_suffix_dedup": _suffix.SQL,
    "mixing_totals": _mixing.TOTALS_SQL,
    "op10_line_dedup": _line.SQL,
}
