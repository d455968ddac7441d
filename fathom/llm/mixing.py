"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of the target size; a document's expected number of copies is its source's share over its
source's size. The whole part is certain. The fractions are rounded by the pivotal method: two documents pass mass from
one to the other at random, keeping each one's expectation, until one of them has 0 or 1; the other goes on. So the
copies of a source add up to its expected total but for a fraction of one copy, which independent draws wouldn't give.

Blocks of documents (by a hash of the id) are rounded in parallel; each leaves at most one undecided document per source.
Those meet in a reduction tree: ``FAN_IN`` blocks at a time, until one is left per source, which a last draw decides.
All draws are fixed by the seed, so a task that runs again decides the same.

Copies aren't bounded: a source of few characters and a large share is repeated as often as its share takes. A caller that
gives ``max_copies`` bounds a document's expected copies; what that cuts from a source isn't given to others, so the
source then misses its weight and the whole falls short of the target by as much.

Defined results
- null source: a source of its own, whose weight is that of the key None. Null or empty text: size 0, the same copies as
  others of the source. Very long texts: their whole length counts, and they are drawn like others.
- null id, repeated rows: units like others, one result row each. Ties (equal fractions, equal hashes) go by id.
- sources without a weight: 0 copies. A source of total size 0: each of its documents stands once, weight or not.
- weights that are negative, null or not finite: ValueError. Empty table: empty result. Extra columns: kept by the stage.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import c, cut, fresh

TEMPERATURE, MAX_COPIES, SEED = 0.7, math.inf, 17
BLOCK_ROWS, FAN_IN = 20_000, 64
_EPS = 1e-9


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds fractions to 0 and 1 until at most one is left between; keeps their sum and each one's expectation."""
    out = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    live, draws = np.flatnonzero((out > 0) & (out < 1)), rng.random(len(out))
    if not len(live):
        return out
    i, a = int(live[0]), float(out[live[0]])
    for j, u in zip(live[1:].tolist(), draws.tolist()):
        if not 0 < a < 1:
            out[i] = a
            i, a = j, float(out[j])
            continue
        b = float(out[j])
        s = a + b
        if s < 1:
            if u * s < b:  # j takes all
                out[i] = 0.0
                i = j
            else:
                out[j] = 0.0
            a = s
        else:
            if u * (2 - s) < 1 - b:  # i gets its copy
                out[i] = 1.0
                i = j
            else:
                out[j] = 1.0
            a = s - 1
        a = 0.0 if a < _EPS else 1.0 if a > 1 - _EPS else a
    out[i] = a
    return out


def expected_copies(units: DataFrame, weights: dict[str | None, float] | None, temperature: float, target_size: float | None, max_copies: float) -> DataFrame:
    """(source, total, n, copies): one row a source, from sums over all units."""
    totals = units.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    if weights is None:
        share: Column = F.pow(F.col("total"), F.lit(temperature))
    else:
        if any(v is None or not math.isfinite(v) or v < 0 for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
        share = F.when(F.col("source").isNull(), float(weights.get(None, 0.0))).otherwise(share)
        share = F.when(F.col("total") > 0, share).otherwise(0.0)
    all_ = totals.withColumn("share", share)
    whole = all_.agg(F.sum("share").alias("shares"), F.sum("total").alias("everything"))
    target = F.lit(float(target_size)) if target_size is not None else F.col("everything").cast("double")
    copies = F.when(F.col("total") <= 0, 1.0).when(F.col("shares") <= 0, 0.0).otherwise(F.least(F.lit(float(max_copies)), target * F.col("share") / F.col("shares") / F.col("total")))
    return all_.crossJoin(whole).select("source", "total", "n", copies.alias("copies"))


def _rounded(df: DataFrame, seed: int, level: int) -> DataFrame:
    """Pivotal rounding within each (source, block)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "id", "f"], kind="stable")
        block, first = int(pdf["block"].iloc[0]), int(pdf["s"].iloc[0])
        rng = np.random.Generator(np.random.PCG64([seed, level, block, first & 0xFFFFFFFFFFFFFFFF]))
        return pdf.assign(f=pivotal(pdf["f"].to_numpy(np.float64), rng))

    return df.groupBy("s", "block").applyInPandas(one, df.schema)


def copies_of(units: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, target_size: float | None = None, max_copies: float = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """(k, id, source, copies) of units (k, id, source, size): k orders the units and spreads them over blocks."""
    plan = expected_copies(units, weights, temperature, target_size, max_copies)
    n = units.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    joined = units.alias("u").join(plan.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source")))
    start = joined.select(
        "u.k", "u.id", "u.source", F.xxhash64(F.coalesce("u.source", F.lit("")), F.col("u.source").isNull()).alias("s"),
        F.floor("p.copies").alias("whole"), (F.col("p.copies") - F.floor("p.copies")).alias("f"), F.pmod(F.xxhash64("u.k", F.lit(seed)), F.lit(blocks)).alias("block"),
    )
    level, decided = 0, None
    now = cut(_rounded(start, seed, level))
    while True:
        done = now.where("f = 0 or f = 1")
        decided = done if decided is None else decided.unionByName(done)
        left = now.where("f > 0 and f < 1")
        if blocks == 1:
            break
        blocks, level = math.ceil(blocks / FAN_IN), level + 1
        now = cut(_rounded(left.withColumn("block", F.floor(F.col("block") / FAN_IN)), seed, level))
    # one undecided document a source: its own draw, by its hash
    draw = (F.pmod(F.xxhash64("k", "s", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)) < F.col("f")
    decided = decided.unionByName(left.withColumn("f", draw.cast("double")))
    return decided.select("k", "id", "source", (F.col("whole") + F.col("f").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """(id, source, copies) for each row; size is the number of characters of the whole text."""
    own = docs.select(
        F.xxhash64(c(id_col), c(source_col)).alias("k"), c(id_col).alias("id"), c(source_col).cast("string").alias("source"), F.coalesce(F.length(c(text_col)), F.lit(0)).cast("long").alias("size")
    )
    return copies_of(own, **options).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents drawn at least once, with one more column, copies. Rows that agree in id, source and text come as one
    row with the sum of their copies."""
    key, copies, i, s = (fresh(docs, x) for x in ("key_", "copies", "id_", "source_"))
    keyed = docs.withColumn(key, F.xxhash64(c(id_col), c(source_col), c(text_col)))
    own = keyed.select(c(key).alias("k"), c(id_col).alias("id"), c(source_col).cast("string").alias("source"), F.coalesce(F.length(c(text_col)), F.lit(0)).cast("long").alias("size"))
    drawn = copies_of(own, **options).groupBy("k", "id", "source").agg(F.sum("copies").alias(copies)).where(c(copies) > 0)
    drawn = drawn.select(F.col("k").alias(key), F.col("id").alias(i), F.col("source").alias(s), copies)
    # rows meet by the hash alone, so that texts are shuffled once; that ids and sources agree too is asked of those that met
    same = lambda a, b: F.coalesce(a == b, a.isNull() & b.isNull())
    met = keyed.join(drawn, key).where(same(c(id_col), c(i)) & same(c(source_col).cast("string"), c(s)))
    return met.dropDuplicates([key, id_col, source_col]).select(*[c(x) for x in docs.columns], c(copies))


def totals(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """(source, documents, characters, expected, kept): of each source what its documents' copies should add up to, and
    whether they do but for less than one copy."""
    own = docs.select(c(source_col).cast("string").alias("source"), F.coalesce(F.length(c(text_col)), F.lit(0)).cast("long").alias("size"))
    o = {"weights": None, "temperature": TEMPERATURE, "target_size": None, "max_copies": MAX_COPIES} | {k: v for k, v in options.items() if k != "seed"}
    plan = expected_copies(own, **o)
    drawn = mix(docs, id_col, source_col, text_col, **options).groupBy(c(source_col).alias("s")).agg(F.sum("copies").alias("drawn"))
    expected = F.col("n") * F.col("copies")
    return plan.join(drawn, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias(source_col), F.col("n").alias("documents"), F.col("total").alias("characters"), F.round(expected, 6).alias("expected"), (F.abs(F.col("drawn") - expected) < 1 + 1e-6).alias("kept")
    )


#: What ``totals`` gives over documents.
TOTALS_SQL = f"""
with t as (select source, count(*) as documents, sum(length(coalesce(text, '')))::bigint as characters from documents group by source),
w as (select sum(power(characters, {TEMPERATURE})) as shares, sum(characters) as everything from t)
select source, documents, characters, round(case when characters > 0 then everything * power(characters, {TEMPERATURE}) / shares / characters * documents else documents end, 6) as expected, true as kept
from t, w
"""
