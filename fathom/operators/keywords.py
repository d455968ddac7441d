"""Keywords by tf * idf, and queries for more documents like one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import bm25, idf, term_frequencies
from fathom.plans.query import Boolean, Boost, Nothing, Occur, Query, Term, any_of
from fathom.sources.index import Index
from fathom.sources.shared import cut

#: (term, tf, df, number of documents) -> whether to accept; a column expression, so that the optimiser sees it
Acceptor = Callable[[Column, Column, Column, Column], Column]

#: Documents in one part, about, where batch similarity looks for the best.
PART_DOCS = 50_000
#: Keywords that a part is compared with at once, about.
PART_KEYWORDS = 2_000_000
#: The most frequent terms, whose document frequencies are sent to where documents are read.
FREQUENT_TERMS = 250_000
#: Asked terms are sent to where postings are read as long as they are no more than this.
SENT_TERMS = 1_000_000


@dataclass
class Keywords:
    """Ranked keywords: a DataFrame (field, term, score, rank) of at most ``limit`` rows."""

    ranked: DataFrame

    def terms(self) -> list[tuple[str, str, float]]:
        return [(r["field"], r["term"], r["score"]) for r in self.ranked.orderBy("rank").collect()]

    def __len__(self) -> int:
        return self.ranked.count()

    @property
    def is_empty(self) -> bool:
        return self.ranked.isEmpty()

    def into_query(self) -> Query:
        """Any of the keywords."""
        return any_of(Term(f, t) for f, t, _ in self.terms())

    def into_boosted_query(self, factor: float) -> Query:
        """Any of the keywords, the best with this factor, others by their share of its score."""
        found = self.terms()
        if not found:
            return Nothing()
        best = max(s for _, _, s in found)
        return Boolean(tuple((Occur.SHOULD, Boost(Term(f, t), factor * (s / best))) for f, t, s in found))


class TopTerms:
    """Extracts keywords with regard to some fields of an index."""

    def __init__(self, index: Index, fields: list[str]) -> None:
        unknown = set(fields) - set(index.fields)
        if unknown:
            raise LookupError(f"no full-text field: {', '.join(sorted(unknown))}")
        self.index, self.fields = index, fields

    def _scored(self, tf: DataFrame, accept: Acceptor | None) -> DataFrame:
        """tf: (..., field, term, tf)"""
        known = tf.join(self.index.term_stats, ["field", "term"]).crossJoin(self.index.num_docs())
        if accept is not None:
            known = known.where(accept(F.col("term"), F.col("tf"), F.col("df"), F.col("n_docs")))
        return known.withColumn("score", F.round(F.col("tf") * idf(F.col("df"), F.col("n_docs")), 6))

    def _ranked(self, scored: DataFrame, limit: int) -> Keywords:
        order = [F.desc("score"), F.asc("field"), F.asc("term")]
        top = scored.select("field", "term", "score").orderBy(*order).limit(limit)
        return Keywords(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))

    def extract(self, limit: int, text: str, accept: Acceptor | None = None) -> Keywords:
        """Of a text; each of its terms counts once for each field."""
        spark = self.index.docs.sparkSession
        tf = term_frequencies(spark.createDataFrame([(text,)], "text string"), F.col("text"))
        fields = spark.createDataFrame([(f,) for f in self.fields], "field string")
        return self._ranked(self._scored(tf.crossJoin(fields), accept), limit)

    def extract_from_doc(self, limit: int, doc_id: int, accept: Acceptor | None = None) -> Keywords:
        own = self.index.doc_terms(doc_id).where(F.col("field").isin(self.fields))
        return self._ranked(self._scored(own, accept), limit)

    def extract_all(self, limit: int, accept: Acceptor | None = None, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, field, term, score, rank) of all documents at once, or of those whose ids docs has.

        Where a document is read, of its frequent terms only those that may be among its best go on; all others go on to
        where their document frequency is."""
        own = self.index.forward.where(F.col("field").isin(self.fields))
        if docs is not None:
            own = own.join(docs.select("doc_id"), "doc_id", "left_semi")
        own = own.select("doc_id", "field", "tfs", F.posexplode("terms").alias("i", "term")).select("doc_id", "field", "term", F.get("tfs", F.col("i")).alias("tf"))
        frequent = self.index.term_stats.where(F.col("field").isin(self.fields)).orderBy(F.desc("df"), "field", "term").limit(FREQUENT_TERMS).select("field", "term", "df")
        met = own.join(F.broadcast(frequent), ["field", "term"], "left").crossJoin(self.index.num_docs())
        if accept is not None:
            met = met.where(F.col("df").isNull() | accept(F.col("term"), F.col("tf"), F.col("df"), F.col("n_docs")))
        met = met.select("doc_id", "field", "term", "tf", (F.col("tf") * idf(F.col("df"), F.col("n_docs"))).alias("raw"))
        id_type = met.schema["doc_id"].dataType.simpleString()
        may = met.mapInArrow(_perhaps_best(limit), f"doc_id {id_type}, field string, term string, tf bigint")
        by = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("field"), F.asc("term"))
        return self._scored(may, accept).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("doc_id", "field", "term", "score", "rank")


def _perhaps_best(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops the rows (doc_id, field, term, tf, raw) that can't be among the limit best of their document, rounded to six
    places and with any order of ties; what has no raw score stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = b.column(4).to_numpy(zero_copy_only=False).astype(float)
                doc = pc.dictionary_encode(b.column(0)).indices.to_numpy()
                order = np.lexsort((-raw, doc))  # those without a score last
                own = doc[order]
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                size = np.diff(np.r_[start, len(own)])
                last = np.empty(len(start))
                last[own[start]] = raw[order[start + np.minimum(size, limit) - 1]]
                # rounding moves each of two scores by half a unit of the sixth place at most
                b = b.filter(pa.array(~(raw < last[doc] - 2e-6)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], ["doc_id", "field", "term", "tf"])

    return run


def more_like_all(index: Index, keywords: DataFrame, limit: int, boosted: bool = False) -> DataFrame:
    """(src, doc_id, score, rank): for each document of keywords (doc_id, field, term, score) the best matches of a query
    of its keywords, itself among them."""
    return more_like_both(index, keywords, limit, (boosted,)).drop("boosted")


def more_like_both(index: Index, keywords: DataFrame, limit: int, kinds: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(src, doc_id, score, rank, boosted): the same of plain and of weighted queries, from one pass.

    Documents lie in parts of about PART_DOCS. Each part has the postings of the asked terms, adds up all pairs of its
    documents and the queries in memory, and returns its best for each query; pairs are never shuffled."""
    spark = index.docs.sparkSession
    boost = F.col("score") / F.max("score").over(Window.partitionBy("doc_id")) if True in kinds else F.lit(1.0)
    asked = cut(keywords.select(F.col("doc_id").alias("src"), "field", "term", boost.alias("boost")))
    known = asked.select("field", "term").distinct().join(index.term_stats, ["field", "term"]).join(index.field_stats, "field").crossJoin(index.num_docs())
    terms = cut(known.select("field", "term", idf(F.col("df"), F.col("n_docs")).alias("weight"), (F.col("total_length") / F.col("n_docs")).alias("avg_dl"), F.monotonically_increasing_id().alias("number")))
    n_docs = index.num_docs().first()[0]
    parts = max(-(-n_docs // PART_DOCS), min(n_docs, spark.sparkContext.defaultParallelism), 1)
    groups = max(-(-asked.count() // PART_KEYWORDS), 1)

    score = bm25(F.col("tf").cast("double"), F.col("weight"), F.col("dl"), F.col("avg_dl"))
    sent = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    spread = index.postings.drop("positions").join(sent, ["field", "term"])
    spread = spread.select("doc_id", "number", score.alias("s"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    queries = asked.join(terms.select("field", "term", "number"), ["field", "term"]).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("number", "boost"))).alias("x"))
    queries = queries.select("src", F.col("x.number").alias("numbers"), F.col("x.boost").alias("boosts"), F.pmod(F.xxhash64("src"), F.lit(groups)).cast("int").alias("group"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    id_type = index.postings.schema["doc_id"].dataType.simpleString()
    best = spread.groupBy("part", "group").cogroup(queries.groupBy("part", "group")).applyInArrow(_compared(limit, kinds), f"src {id_type}, doc_id {id_type}, score double, boosted boolean")
    by = Window.partitionBy("src", "boosted").orderBy(F.desc("score"), F.asc("doc_id"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("src", "doc_id", "score", "rank", "boosted")


def _compared(limit: int, kinds: tuple[bool, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """postings (doc_id, number, s) of a part and queries (src, numbers, boosts) -> (src, doc_id, score, boosted), at most
    limit rows of each query and kind, ties to the lowest id."""

    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        src_type, id_type = queries.schema.field("src").type, postings.schema.field("doc_id").type
        srcs, docs, scores, boosted = [], [], [], []
        if postings.num_rows and queries.num_rows:
            ids, at = np.unique(postings["doc_id"].to_numpy(), return_inverse=True)
            number, s = postings["number"].to_numpy(), postings["s"].to_numpy()
            order = np.argsort(number, kind="stable")
            at, s, number = at[order], s[order], number[order]
            numbers, boosts = queries["numbers"].combine_chunks(), queries["boosts"].combine_chunks()
            wanted, boost = numbers.flatten().to_numpy(), boosts.flatten().to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(number, wanted, "left"), np.searchsorted(number, wanted, "right")
            ends = np.cumsum(pc.list_value_length(numbers).to_numpy())
            begin = 0
            for row, end in enumerate(ends):
                mine = [(a, b, w) for a, b, w in zip(first[begin:end].tolist(), last[begin:end].tolist(), boost[begin:end].tolist()) if a < b]
                begin = end
                if not mine:
                    continue
                place = np.concatenate([at[a:b] for a, b, _ in mine])
                if len(place) * 8 < len(ids):
                    near, place = np.unique(place, return_inverse=True)
                    held = slice(None)
                else:
                    near = held = np.flatnonzero(np.bincount(place, minlength=len(ids)))
                for kind in kinds:
                    sums = np.bincount(place, weights=np.concatenate([s[a:b] * w if kind else s[a:b] for a, b, w in mine]))[held]
                    rounded = _rounded(sums)
                    chosen = _first(rounded, limit)
                    srcs.append(np.full(len(chosen), row))
                    docs.append(ids[near[chosen]])
                    scores.append(rounded[chosen])
                    boosted.append(np.full(len(chosen), kind))
        of = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        return pa.table(
            {
                "src": queries["src"].take(pa.array(of(srcs, np.int64))) if srcs else pa.array([], src_type), "doc_id": pa.array(of(docs, np.int64), id_type),
                "score": pa.array(of(scores, float)), "boosted": pa.array(of(boosted, bool)),
            }
        )

    return run


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up; nothing here is negative."""
    y = x * 1e6
    whole = np.floor(y)
    return (whole + (y - whole >= 0.5)) / 1e6


def _first(x: np.ndarray, limit: int) -> np.ndarray:
    """Where the limit greatest are; of equal ones the first."""
    if len(x) <= limit:
        return np.arange(len(x))
    last = -np.partition(-x, limit - 1)[limit - 1]
    above = np.flatnonzero(x > last)
    return np.concatenate([above, np.flatnonzero(x == last)[: limit - len(above)]])


def similarity_report(keywords: DataFrame, simple: DataFrame, weighted: DataFrame, similar: DataFrame) -> DataFrame:
    """(recipe_id, len, top5, simple_weighted_found_delta, simple_pos, weighted_pos, simple_recall, weighted_recall): how a
    document's plain query of its keywords does against the weighted one. keywords (doc_id, term, rank), results
    (src, doc_id, rank), similar (src, similar: array of ids) of all documents to report."""
    terms = keywords.groupBy(F.col("doc_id").alias("src")).agg(F.count("*").alias("len"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "term")))).alias("t"))
    found = [x.groupBy("src").agg(F.count("*").alias(f"{n}_found")) for n, x in (("simple", simple), ("weighted", weighted))]
    rated = [recall(x, similar).select("src", F.col("self_position").alias(f"{n}_pos"), F.col("recall").alias(f"{n}_recall")) for n, x in (("simple", simple), ("weighted", weighted))]
    out = similar.select("src").join(terms, "src", "left")
    for x in (*found, *rated):
        out = out.join(x, "src", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select(
        F.col("src").alias("recipe_id"), n(F.col("len")).alias("len"), F.coalesce(F.array_join(F.transform("t", lambda x: x["term"]), ";"), F.lit("")).alias("top5"),
        (n(F.col("simple_found")) - n(F.col("weighted_found"))).alias("simple_weighted_found_delta"), "simple_pos", "weighted_pos", "simple_recall", "weighted_recall",
    )


def recall(found: DataFrame, similar: DataFrame) -> DataFrame:
    """(src, n_similar, hits, recall, self_position) of result lists (src, doc_id, rank) against lists of what should be
    found (src, similar: array of ids). recall is null where nothing should be; self_position is -1 where it isn't there."""
    lists = found.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
    both = similar.join(lists, "src", "left").withColumn("ids", F.coalesce(F.transform("l", lambda x: x["doc_id"]), F.array().cast("array<long>")))
    hits = F.size(F.filter("similar", lambda x: F.array_contains("ids", x))).cast("long")
    n = F.size("similar").cast("long")
    return both.select("src", n.alias("n_similar"), hits.alias("hits"), F.try_divide(hits, n).alias("recall"), (F.array_position("ids", F.col("src")) - 1).cast("long").alias("self_position"))


def overlap(a: Column, b: Column) -> Column:
    """How many entries of a are in b, repeated ones repeatedly."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x))).cast("long")
