"""The registered queries of the search engine, and the SQL that gives the same rows.

Text queries run over an index of ``documents`` with two fields, head (the first line) and body (the whole text), stored
once per session and folder in the shared scratch space; labels are its optional features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.engine import Engine
from fathom.functions.text import idf, term_frequencies
from fathom.operators.facets import filtered_stats, range_stats
from fathom.operators.filters import range_filter
from fathom.operators.keywords import Acceptor, TopTerms, more_like_all, more_like_both, overlap, recall
from fathom.operators.store import hydrate, last_wins
from fathom.operators.topk import after, collect_page, counts, merge_pages, sort_key, top_k, tuple_cursor
from fathom.plans.compiler import explained, search
from fathom.plans.features import FeatureSet
from fathom.plans.grammar import Occur
from fathom.plans.query import All, Boolean, Boost, DisMax, Phrase, Query, QueryParser, Range, Term, any_of
from fathom.sources.index import Index
from fathom.sources.shared import cut, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_INDEXES: dict[tuple[str, str], Index] = {}
LABELS = FeatureSet.of(quality="i32?", toxic="i32?")
PARTS = FeatureSet.of(p_size="i32", p_retailprice="f64")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        built = Index.build(labelled(spark, sf_dir), {"head": F.substring_index("text", "\n", 1), "body": F.col("text")})
        # texts stay in their table; nothing reads them from the index
        _INDEXES[key] = replace(built, docs=built.docs.drop("text")).write(f"{scratch(spark, 'index')}/stored")
    return _INDEXES[key]


def ranked(found: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, score, rank) of the k best."""
    rounded = found.select("doc_id", F.round("score", 6).alias("score"))
    return top_k(rounded, F.col("score"), F.col("doc_id"), k).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


# SQL pieces ------------------------------------------------------------------------------------------------------

_TOKENS = r"""list_transform(list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) < 40), lambda x: lower(x))"""
_INDEX = f"""
with src as (select doc_id, 'body' as field, text as t from documents union all select doc_id, 'head', string_split(text, chr(10))[1] from documents),
tk as (select doc_id, field, {_TOKENS.format('t')} as w from src),
tok as (select doc_id, field, unnest(w) as term, generate_subscripts(w, 1) as pos from tk),
post as (select doc_id, field, term, count(*) as tf from tok group by all),
dl as (select doc_id, field, count(*) as dl from tok group by all),
st as (select field, term, count(*) as df from post group by all),
nd as (select count(*) as n from documents),
av as (select field, sum(dl) / (select n from nd) as avg_dl from dl group by field),
sc as (
  select doc_id, field, term, tf, df, dl, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf,
    ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) as s
  from post join st using (field, term) join dl using (doc_id, field) join av using (field), nd
)"""


def _top(hits: str, k: int = 10) -> str:
    return f"select doc_id, score, row_number() over (order by score desc, doc_id) as rank from ({hits}) order by score desc, doc_id limit {k}"


def _is(field: str, *terms: str) -> str:
    return f"field = '{field}' and term in ({', '.join(repr(t) for t in terms)})"


# full text -------------------------------------------------------------------------------------------------------


@query(_INDEX + _top(f"select doc_id, round(s, 6) as score from sc where {_is('body', 'the')}"))
def term_bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), Term("body", "the")))


@query(_INDEX + _top(f"select doc_id, round(sum(s), 6) as score from sc where {_is('body', 'the', 'nicht', 'para')} group by doc_id"))
def multi_or_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), any_of(Term("body", t) for t in ("the", "nicht", "para"))))


@query(
    _INDEX
    + _top(
        f"select doc_id, round(sum(s), 6) as score from sc where {_is('body', 'and', 'that', 'with')} group by doc_id having count(*) filter (term in ('and', 'that')) = 2"
    )
)
def must_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), QueryParser(["body"]).parse("+and +that with")))


@query(_INDEX + f"select doc_id, round(s, 6) as score from sc where {_is('body', 'and')} and doc_id not in (select doc_id from sc where {_is('body', 'with')})")
def must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_of(spark, sf_dir), QueryParser(["body"]).parse("+and -with")).select("doc_id", F.round("score", 6).alias("score"))


@query(_INDEX + "select doc_id, 1.0::double as score from documents where doc_id not in (select doc_id from post where term in ('the', 'der'))")
def pure_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that none of the fields may have."""
    return search(index_of(spark, sf_dir), QueryParser(["head", "body"]).parse("-the -der"))


@query(_INDEX + "select doc_id, 1.0::double as score from documents")
def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_of(spark, sf_dir), All())


_PHRASE = """, ph as (
  select a.doc_id, count(*) as tf from tok a join tok b on a.doc_id = b.doc_id and a.field = b.field and b.pos = a.pos + 1
  where a.field = 'body' and a.term = 'of' and b.term = 'the' group by a.doc_id
), wt as (select sum(ln(1 + (n - df + 0.5) / (df + 0.5))) as w from st, nd where field = 'body' and term in ('of', 'the'))
"""


@query(_INDEX + _PHRASE + "select doc_id, round(w * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)), 6) as score from ph join dl using (doc_id) join av using (field), wt where field = 'body'")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_of(spark, sf_dir), Phrase("body", ("of", "the"))).select("doc_id", F.round("score", 6).alias("score"))


@query(
    _INDEX
    + _top("select doc_id, round(max(s) + (sum(s) - max(s)) * 0.1, 6) as score from sc where field in ('head', 'body') and term = 'that' group by doc_id")
)
def dismax_head_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), QueryParser(["head", "body"]).parse_dismax("that", 0.1)))


@query(
    _INDEX
    + _top(
        "select doc_id, round(sum(s), 6) as score from (select doc_id, term, max(s) + (sum(s) - max(s)) * 0.1 as s from"
        " (select doc_id, term, s * case field when 'head' then 1.15 else 0.7 end as s from sc where term in ('that', 'with')) group by doc_id, term) group by doc_id"
    )
)
def boosted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parser = QueryParser(["head", "body"], boosts={"head": 1.15, "body": 0.7})
    return ranked(search(index_of(spark, sf_dir), parser.parse_dismax("that with", 0.1)))


@query(
    _INDEX
    + "select doc_id, case term when 'and' then 0 else 1 end as clause, field, term, tf, df, dl, round(idf, 6) as idf, case term when 'and' then 1.0 else 2.0 end::double as boost,"
    f" round(s * case term when 'and' then 1.0 else 2.0 end, 6) as score from sc where {_is('body', 'and', 'der')}"
)
def explain_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Boolean(((Occur.SHOULD, Term("body", "and")), (Occur.SHOULD, Boost(Term("body", "der"), 2.0))))
    return explained(index_of(spark, sf_dir), q).withColumns({"idf": F.round("idf", 6), "score": F.round("score", 6)})


@query(
    _INDEX
    + _top(
        f"select doc_id, round(sum(s), 6) as score from sc where {_is('body', 'the', 'and')} and doc_id in (select doc_id from labels where quality >= 1 and quality < 2) group by doc_id"
    )
)
def fulltext_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Boolean(((Occur.MUST, any_of((Term("body", "the"), Term("body", "and")))), (Occur.MUST, Range("quality", 1, 2))))
    return ranked(search(index_of(spark, sf_dir), q))


@query(_INDEX + "select doc_id from post where field = 'body' and term in ('las', 'les') group by doc_id")
def unscored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_of(spark, sf_dir), any_of((Term("body", "las"), Term("body", "les"))), scored=False).select("doc_id")


@query(
    _INDEX
    + "select doc_id, round(max(s) + (sum(s) - max(s)) * 1.0, 6) as score from (select doc_id, 'a' as d, s from sc where field = 'body' and term = 'des'"
    " union all select doc_id, 'b', sum(s) from sc where field = 'body' and term in ('des', 'und') group by doc_id) group by doc_id"
)
def dismax_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    q: Query = DisMax((Term("body", "des"), any_of((Term("body", "des"), Term("body", "und")))), 1.0)
    return search(index_of(spark, sf_dir), q).select("doc_id", F.round("score", 6).alias("score"))


# filters and facets ----------------------------------------------------------------------------------------------


@query("select p_partkey, p_name, p_size from part where p_size >= 10 and p_size < 20")
def range_filter_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_filter(table(spark, sf_dir, "part"), {"p_size": (10, 20), "p_retailprice": None}, PARTS).select("p_partkey", "p_name", "p_size")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 and o_totalprice < 50000.5 and o_custkey >= 10 and o_custkey < 100")
def range_filter_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_filter(table(spark, sf_dir, "orders"), {"o_totalprice": (1000, 50000.5), "o_custkey": (10, 100)}).select("o_orderkey", "o_totalprice")


@query("select doc_id, quality, toxic from documents left join labels using (doc_id) where quality >= 0 and quality < 1")
def range_filter_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_filter(labelled(spark, sf_dir), {"quality": (0, 1)}, LABELS).select("doc_id", "quality", "toxic")


def _facet_sql(source: str, ranges: dict[str, list[tuple[float, float]]]) -> str:
    return " union all ".join(
        f"select '{f}' as feature, {i}::integer as bucket, {float(a)!r}::double as lo, {float(b)!r}::double as hi, coalesce(min({f}) filter ({f} >= {float(a)!r}::double and {f} < {float(b)!r}::double), {float(b)!r})::double as min,"
        f" coalesce(max({f}) filter ({f} >= {float(a)!r}::double and {f} < {float(b)!r}::double), {float(a)!r})::double as max, count({f}) filter ({f} >= {float(a)!r}::double and {f} < {float(b)!r}::double) as count from {source}"
        for f, rs in ranges.items()
        for i, (a, b) in enumerate(rs)
    )


_OVERLAPPING = {"p_size": [(0, 10), (5, 25), (20, 60)], "p_retailprice": [(900, 1200), (1000, 1e6)]}
_OPTIONAL = {"quality": [(0, 1), (1, 2), (0, 2)], "toxic": [(1, 2)]}
_EMPTY = {"o_totalprice": [(-10, 0), (0, 100000)]}
_LABELLED = "(select * from documents left join labels using (doc_id)) d"


@query(_facet_sql("part", _OVERLAPPING))
def facets_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_stats(table(spark, sf_dir, "part"), _OVERLAPPING)


@query(_facet_sql(_LABELLED, _OPTIONAL))
def facets_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_stats(labelled(spark, sf_dir), _OPTIONAL)


@query(_facet_sql("orders", _EMPTY))
def facets_empty_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_stats(table(spark, sf_dir, "orders"), _EMPTY)


@query(_INDEX + _facet_sql("(select * from documents left join labels using (doc_id) where doc_id in (select doc_id from post where field = 'body' and term = 'that')) d", _OPTIONAL))
def facets_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return filtered_stats(index.docs, search(index, Term("body", "that"), scored=False), _OPTIONAL)


# sorts and pages -------------------------------------------------------------------------------------------------


def _order_page(name: str, columns: str, source: str, order: str, k: int, where: str = "true") -> str:
    return f"select {columns}, row_number() over (order by {order}) as rank from {source} where {where} order by {order} limit {k}"


def _ranked_long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(_order_page("", "o_orderkey, o_totalprice", "orders", "o_totalprice, o_orderkey", 25))
def topk_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_long(top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey"), 25, ascending=True))


@query(_order_page("", "o_orderkey, o_totalprice", "orders", "o_totalprice desc, o_orderkey", 25))
def topk_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_long(top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey"), 25))


@query(_order_page("", "p_partkey, p_size", "part", "p_size desc, p_partkey", 60))
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_long(top_k(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size"), F.col("p_partkey"), 60))


def _second_page(spark: SparkSession, sf_dir: str, ascending: bool) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key, id_ = F.col("p_size"), F.col("p_partkey")
    last = top_k(parts, key, id_, 30, ascending).orderBy(F.desc("rank")).first()
    return _ranked_long(top_k(parts, key, id_, 30, ascending, after(key, id_, last["p_size"], last["p_partkey"], ascending)))


def _second_sql(order: str) -> str:
    return f"select p_partkey, p_size, r - 30 as rank from (select p_partkey, p_size, row_number() over (order by {order}) as r from part) where r > 30 and r <= 60"


@query(_second_sql("p_size, p_partkey"))
def page2_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_page(spark, sf_dir, True)


@query(_second_sql("p_size desc, p_partkey"))
def page2_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_page(spark, sf_dir, False)


@query("select count(*) as total, count(*) filter (l_quantity < 10) as visited, count(*) filter (l_quantity < 10) > 10 as has_next from lineitem")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 10, 10)


@query(_order_page("", "l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue", "lineitem", "round(l_extendedprice * (1 - l_discount), 4) desc, l_orderkey * 10 + l_linenumber", 20))
def custom_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))
    return _ranked_long(top_k(rows, F.col("revenue"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), 20))


@query(_order_page("", "doc_id, coalesce(quality, 0) as quality", "documents left join labels using (doc_id)", "coalesce(quality, 0) desc, doc_id", 40))
def sort_missing_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled(spark, sf_dir).select("doc_id", sort_key(F.col("quality")).alias("quality"))
    return _ranked_long(top_k(docs, F.col("quality"), F.col("doc_id"), 40))


@query(_order_page("", "o_orderkey, o_totalprice", "orders", "o_totalprice desc, o_orderkey", 15, "o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'"))
def conditional_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any predicate may decide what is collected."""
    condition = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "1-URGENT")
    page = top_k(table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderkey"), 15, condition=condition)
    return _ranked_long(page.select("o_orderkey", "o_totalprice", "rank"))


@query(_order_page("", "p_partkey, p_size", "part", "p_size desc, p_partkey", 20, "p_size < 25 or p_size = 25 and p_partkey > 40"))
def tuple_cursor_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key, id_ = F.col("p_size"), F.col("p_partkey")
    return _ranked_long(top_k(parts, key, id_, 20, condition=tuple_cursor(key, id_, 25, 40, False)))


@query(_order_page("", "o_orderkey, o_totalprice", "orders", "o_totalprice, o_orderkey", 12))
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of disjoint parts, merged."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    key, id_ = F.col("o_totalprice"), F.col("o_orderkey")
    parts = [collect_page(orders.where(F.pmod("o_orderkey", F.lit(3)) == i), key, id_, 12, ascending=True) for i in range(3)]
    return _ranked_long(merge_pages(parts, key, id_, ascending=True).items)


# terms and keywords ----------------------------------------------------------------------------------------------


@query(f"select term, count(*) as tf from (select unnest({_TOKENS.format('text')}) as term from documents) group by term")
def termfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "documents"), F.col("text"))


@query(_INDEX + "select field, term, df from st")
def docfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats.select("field", "term", "df")


@query(_INDEX + "select field, term, df from st where field = 'body' and term = 'that'")
def docfreq_of_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_freq("body", "that").select("field", "term", "df")


@query(_INDEX + "select field, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from st, nd")
def idf_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return index.term_stats.crossJoin(index.num_docs()).select("field", "term", F.round(idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


@query(_INDEX + "select doc_id, field, term, tf from post where doc_id = 7")
def termfreq_of_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_terms(7).withColumn("doc_id", F.lit(7).cast("long"))


_KEYWORDS = ", kw as (select doc_id, field, term, round(tf * idf, 6) as score, df, row_number() over (partition by doc_id order by round(tf * idf, 6) desc, field, term) as rank from sc where {})"


@query(_INDEX + _KEYWORDS.format("field = 'body' and doc_id = 3") + "select field, term, score, rank from kw where rank <= 10")
def keywords_of_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TopTerms(index_of(spark, sf_dir), ["body"]).extract_from_doc(10, 3).ranked.withColumn("rank", F.col("rank").cast("long"))


@query(_INDEX + _KEYWORDS.format("field = 'body'") + "select doc_id, field, term, score, rank from kw where rank <= 5")
def keywords_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TopTerms(index_of(spark, sf_dir), ["body"]).extract_all(5).withColumn("rank", F.col("rank").cast("long"))


def _accept(term, tf, df, n):
    return (df > 5) & (F.length(term) > 4) & ~term.endswith("tion")


_ACCEPT = "field = 'body' and df > 5 and length(term) > 4 and term not like '%tion'"


@query(_INDEX + _KEYWORDS.format(_ACCEPT) + "select doc_id, field, term, score, rank from kw where rank <= 5")
def keywords_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TopTerms(index_of(spark, sf_dir), ["body"]).extract_all(5, _accept).withColumn("rank", F.col("rank").cast("long"))


_MLT = (
    ", ks as (select *, score / max(score) over (partition by doc_id) as share from kw where rank <= 20), ml as (select ks.doc_id as src, sc.doc_id, round(sum(sc.s{}), 6) as score"
    " from ks join sc using (field, term) group by 1, 2), mr as (select src, doc_id, score, row_number() over (partition by src order by score desc, doc_id) as rank from ml)"
)


#: Similarity is asked for every fiftieth document, and looks at all.
_ASKED = "doc_id % 50 = 0"
_ACCEPT_ASKED = f"{_ACCEPT} and {_ASKED}"


def similar_keywords(spark: SparkSession, sf_dir: str, accept: Acceptor = _accept) -> DataFrame:
    index = index_of(spark, sf_dir)
    return TopTerms(index, ["body"]).extract_all(20, accept, index.docs.where(_ASKED))


def _similar(spark: SparkSession, sf_dir: str, boosted: bool) -> DataFrame:
    return more_like_all(index_of(spark, sf_dir), similar_keywords(spark, sf_dir), 11, boosted).withColumn("rank", F.col("rank").cast("long"))


def similar_both(spark: SparkSession, sf_dir: str, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain and weighted results, found in one pass."""
    found = cut(more_like_both(index_of(spark, sf_dir), keywords, 11))
    return found.where("not boosted").drop("boosted"), found.where("boosted").drop("boosted")


@query(_INDEX + _KEYWORDS.format(_ACCEPT_ASKED) + _MLT.format("") + "select src, doc_id, score, rank from mr where rank <= 11")
def mlt_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, False)


@query(_INDEX + _KEYWORDS.format(_ACCEPT_ASKED) + _MLT.format(" * share") + "select src, doc_id, score, rank from mr where rank <= 11")
def mlt_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, True)


_NEAR = """, sim as (
  select doc_id as src, coalesce(list_filter(list(doc_id) over (partition by source, lang order by doc_id rows between 5 preceding and 5 following), lambda x: true), []) as near from documents
), want as (select src, list_filter(near, lambda x: x <> src) as wanted from sim where src % 50 = 0), got as (select src, list(doc_id order by rank) as ids from mr where rank <= 11 group by src)"""


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, similar): what should be found, the five documents before and after of the same source and language."""
    near = Window.partitionBy("source", "lang").orderBy("doc_id").rowsBetween(-5, 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.collect_list("doc_id").over(near).alias("near"))
    return docs.where("src % 50 = 0").select("src", F.filter("near", lambda x: x != F.col("src")).alias("similar"))


@query(
    _INDEX
    + _KEYWORDS.format(_ACCEPT_ASKED)
    + _MLT.format("")
    + _NEAR
    + """
select src, len(wanted)::bigint as n_similar, len(list_filter(wanted, lambda x: list_contains(coalesce(ids, []), x)))::bigint as hits,
  case when len(wanted) > 0 then len(list_filter(wanted, lambda x: list_contains(coalesce(ids, []), x)))::double / len(wanted) end as recall,
  coalesce(list_position(ids, src), 0)::bigint - 1 as self_position
from want left join got using (src)"""
)
def mlt_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(_similar(spark, sf_dir, False), near_documents(spark, sf_dir))


# records ---------------------------------------------------------------------------------------------------------


@query(_INDEX + ", page as (" + _top(f"select doc_id, round(s, 6) as score from sc where {_is('body', 'ist')}") + ") select rank, page.doc_id, score, lang, source, n_chars from page join documents using (doc_id)")
def hydrate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = ranked(search(index_of(spark, sf_dir), Term("body", "ist")))
    return hydrate(page, table(spark, sf_dir, "documents")).select("rank", "doc_id", "score", "lang", "source", "n_chars")


_ENGINE = (
    "select doc_id, sum(s) as score from (select doc_id, term, max(s) + (sum(s) - max(s)) * 0.1 as s from"
    " (select doc_id, term, s * case field when 'head' then 1.15 else 0.7 end as s from sc where term in ('that', 'with')) group by doc_id, term)"
    " join labels using (doc_id) where quality >= 1 and quality < 2 group by doc_id"
)


@query(
    _INDEX
    + f"select doc_id, row_number() over (order by k desc, doc_id) - 7 as rank, k::double as sort_key, total from (select doc_id, round(score, 6)::float as k, count(*) over () as total from ({_ENGINE}))"
    " qualify rank >= 1 and rank <= 7"
)
def engine_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, a filter and a cursor through the engine."""
    index = index_of(spark, sf_dir)
    docs = index.docs.withColumn("uuid", F.regexp_replace(F.md5(F.col("doc_id").cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))
    engine = Engine(replace(index, docs=docs), LABELS, boosts={"head": 1.15, "body": 0.7})
    request = {"fulltext": "that with", "filter": {"quality": (1, 2)}, "num_items": 7}
    second = engine.search({**request, "after": engine.search(request).next})
    return _ranked_long(second.items.select("doc_id", "rank", "sort_key")).withColumn("total", F.lit(second.total_found).cast("long"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    _INDEX
    + _KEYWORDS.format(_ACCEPT_ASKED)
    + _MLT.format("")
    + ", m2 as (select ks.doc_id as src, sc.doc_id, round(sum(sc.s * share), 6) as score from ks join sc using (field, term) group by 1, 2),"
    " r2 as (select src, doc_id, row_number() over (partition by src order by score desc, doc_id) as rank from m2)"
    " select a.src, count(*) filter (b.doc_id is not null) as shared from (select * from mr where rank <= 11) a left join (select * from r2 where rank <= 11) b on a.src = b.src and a.doc_id = b.doc_id group by a.src"
)
def result_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's simple results its weighted ones have too."""
    found = similar_both(spark, sf_dir, similar_keywords(spark, sf_dir))
    lists = [x.groupBy("src").agg(F.collect_list("doc_id").alias(n)) for x, n in zip(found, "ab")]
    return lists[0].join(lists[1], "src").select("src", overlap(F.col("a"), F.col("b")).alias("shared"))
