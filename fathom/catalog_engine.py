"""More registered queries: sources and sinks, the record store, the query language, and the engine as users call it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.catalog import _ACCEPT_ASKED, _INDEX, _KEYWORDS, _LABELLED, _MLT, _NEAR, LABELS, PARTS, _facet_sql, _is, _top, index_of, labelled, near_documents, query, ranked, similar_both, similar_keywords
from fathom.engine import Engine, RequestTooLarge, SearchRequest
from fathom.functions.cursor import integer_cursors
from fathom.functions.text import inverted
from fathom.operators.facets import aggregate, full_ranges
from fathom.operators.keywords import Keywords, TopTerms, similarity_report
from fathom.operators.store import RecordStore
from fathom.plans.compiler import explain_nodes, search
from fathom.plans.features import FeatureSet, InvalidRange, UnknownFeature, UnsupportedFeatureType
from fathom.plans.grammar import parse
from fathom.plans.query import QueryParser
from fathom.sources.index import Index, IndexExists
from fathom.sources.records import FixedLog, as_json, read_records, write_csv
from fathom.sources.shared import cut, scratch, table


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a fixed table."""
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({columns})"


def _refused(error: type[Exception], f: Callable, *args: object) -> bool:
    try:
        f(*args)
    except error:
        return True
    return False


def _uuid(key: str) -> Column:
    return F.regexp_replace(F.md5(F.col(key).cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


# sources and sinks -----------------------------------------------------------------------------------------------


@query("select doc_id, text, lang, n_chars from documents")
def json_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'lines')}/documents"
    as_json(table(spark, sf_dir, "documents")).withColumnRenamed("json", "value").write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
    return read_records(spark, path, schema)


@query("select doc_id, '{\"doc_id\":' || doc_id || coalesce(',\"quality\":' || quality, '') || coalesce(',\"toxic\":' || toxic, '') || case when lang = 'en' then ',\"tags\":[\"en\"]' else '' end || '}' as json from " + _LABELLED)
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null fields and empty arrays are left out."""
    own = labelled(spark, sf_dir).select("doc_id", "quality", "toxic", F.filter(F.array("lang"), lambda x: x == "en").alias("tags"))
    return as_json(own).select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), "json")


_REPORT = (
    _INDEX
    + _KEYWORDS.format(_ACCEPT_ASKED)
    + _MLT.format("")
    + _NEAR
    + """, ml2 as (select ks.doc_id as src, sc.doc_id, round(sum(sc.s * share), 6) as score from ks join sc using (field, term) group by 1, 2),
mr2 as (select src, doc_id, row_number() over (partition by src order by score desc, doc_id) as rank from ml2),
got2 as (select src, list(doc_id order by rank) as ids from mr2 where rank <= 11 group by src),
top as (select doc_id as src, count(*)::bigint as len, string_agg(term, ';' order by rank) filter (rank <= 5) as top5 from kw where rank <= 20 group by doc_id)
select want.src as recipe_id, coalesce(len, 0)::bigint as len, coalesce(top5, '') as top5, (coalesce(len(got.ids), 0) - coalesce(len(got2.ids), 0))::bigint as simple_weighted_found_delta,
  coalesce(list_position(got.ids, want.src), 0)::bigint - 1 as simple_pos, coalesce(list_position(got2.ids, want.src), 0)::bigint - 1 as weighted_pos,
  case when len(wanted) > 0 then len(list_filter(wanted, lambda x: list_contains(coalesce(got.ids, []), x)))::double / len(wanted) end as simple_recall,
  case when len(wanted) > 0 then len(list_filter(wanted, lambda x: list_contains(coalesce(got2.ids, []), x)))::double / len(wanted) end as weighted_recall
from want left join top using (src) left join got on got.src = want.src left join got2 on got2.src = want.src"""
)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = cut(similar_keywords(spark, sf_dir))
    return similarity_report(keywords, *similar_both(spark, sf_dir, keywords), near_documents(spark, sf_dir))


@query(_REPORT)
def similarity_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(_REPORT)
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a file with a header, read back."""
    path = f"{scratch(spark, 'csv')}/report"
    report = _report(spark, sf_dir)
    write_csv(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path).withColumn("top5", F.coalesce("top5", F.lit("")))


@query("select row_number() over (order by o_orderkey) - 1 as number, o_orderkey from orders")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of eight bytes, in two appends."""
    log = FixedLog(spark, f"{scratch(spark, 'log')}/entries", 8)
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    middle = orders.agg(F.expr("percentile_approx(o_orderkey, 0.5)")).first()[0]
    for part in (orders.where(F.col("o_orderkey") <= middle), orders.where(F.col("o_orderkey") > middle)):
        log.append(part, ["o_orderkey"], F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")))
    return log.entries().where(F.lit(len(log)) == orders.count()).select("number", F.conv(F.hex("entry"), 16, 10).cast("long").alias("o_orderkey"))


@query("select doc_id, string_split(text, chr(10))[1] as first, len(string_split(text, chr(10)))::bigint as n, length(text)::bigint as letters, text like '%.' as ends, replace(text, chr(10), ' | ') as joined from documents")
def array_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n", -1))
    return lines.select(
        "doc_id", F.get("lines", F.lit(0)).alias("first"), F.size("lines").cast("long").alias("n"), F.length("text").cast("long").alias("letters"), F.endswith("text", F.lit(".")).alias("ends"), F.array_join("lines", " | ").alias("joined")
    )


@query("select p_partkey, p_size::bigint as p_size, p_retailprice::float::double as p_retailprice from part")
def numeric_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers to 64 bits, single precision to double."""
    kinds = FeatureSet.of(p_size="i32", p_retailprice="f32")
    own = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("float").alias("p_retailprice"))
    return kinds.widened(kinds.checked(own))


# record store ----------------------------------------------------------------------------------------------------

_STORES: dict[tuple[str, str], RecordStore] = {}
_STORED = "select o_orderkey, o_custkey, case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end as o_totalprice from orders"


def store_of(spark: SparkSession, sf_dir: str) -> RecordStore:
    """All orders, and a second load of the urgent ones at another price."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        orders = table(spark, sf_dir, "orders").withColumn("uuid", _uuid("o_orderkey"))
        store = RecordStore.create(orders, f"{scratch(spark, 'store')}/orders", "o_orderkey")
        store.append(orders.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1), 1)
        _STORES[key] = store
    return _STORES[key]


@query(_STORED)
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two loads of a record the last wins."""
    return store_of(spark, sf_dir).records().select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"select * from ({_STORED}) where o_orderkey = 33")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(spark, sf_dir).find_by_id(33).select("o_orderkey", "o_custkey", "o_totalprice")


def _uuid_of(spark: SparkSession, key: int) -> str:
    return spark.range(1).select(F.lit(key).alias("k")).select(_uuid("k")).first()[0]


@query(f"select * from ({_STORED}) where o_orderkey = 35")
def lookup_by_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(spark, sf_dir).find_by_uuid(_uuid_of(spark, 35)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select 37::bigint as asked, (select o_orderkey from orders where o_orderkey = 37) as found union all select 0, null")
def id_of_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir)
    return spark.createDataFrame([(37, store.id_for_uuid(_uuid_of(spark, 37))), (0, store.id_for_uuid("no such uuid"))], "asked long, found long")


@query("select o_orderkey from orders")
def store_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(spark, sf_dir).ids()


# index and features ----------------------------------------------------------------------------------------------


@query("select true as refused, (select count(*) from documents) as n_docs")
def index_not_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index isn't written where there is one, which stays as it was."""
    path = f"{scratch(spark, 'index')}/small"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    index = Index.build(docs, {"lang": F.col("lang")})
    refused = not _refused(IndexExists, index.write, path) and _refused(IndexExists, Index.build(docs.limit(1), {"lang": F.col("lang")}).write, path)
    return Index.open(spark, path, ["lang"]).num_docs().select(F.lit(refused).alias("refused"), "n_docs")


@query("select count(*) as n_docs from documents")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).num_docs()


@query(_values("name, type, optional", [("p_size", "int", False), ("p_retailprice", "double", False), ("quality", "int", True), ("toxic", "int", True)]))
def feature_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is declared, held against the tables it's read from."""
    rows = []
    for kinds, df in ((PARTS, table(spark, sf_dir, "part")), (LABELS, labelled(spark, sf_dir))):
        kinds.validate(df.schema)
        rows += [(f.name, f.dataType.simpleString(), f.nullable) for f in kinds.schema]
    return spark.createDataFrame(rows, "name string, type string, optional boolean")


@query(_values("name, full_text, feature", [("doc_id", False, True), ("lang", True, False), ("n_chars", False, True), ("source", True, False), ("text", True, False)]))
def field_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns can be full text, and which numeric features."""
    docs = table(spark, sf_dir, "documents")
    rows = [(n, not _refused(TypeError, inverted, docs, "doc_id", {n: F.col(n)}), not _refused(UnsupportedFeatureType, FeatureSet.of(**{n: "i64"}).validate, docs.schema)) for n in sorted(docs.columns)]
    return spark.createDataFrame(rows, "name string, full_text boolean, feature boolean")


@query(_values("request, refused", [("a range", None), ("unknown filter", "UnknownFeature"), ("unknown name", "UnknownFeature"), ("unknown facet", "UnknownFeature"), ("unknown sort", "UnknownFeature"), ("text for a number", "InvalidRange"), ("a fraction", "InvalidRange"), ("beyond the type", "InvalidRange"), ("too large", "RequestTooLarge")]))
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    asked = {
        "a range": {"filter": {"quality": [0, 1]}}, "unknown filter": {"filter": {"nope": [0, 1]}}, "unknown name": {"nope": 1}, "unknown facet": {"agg": {"nope": [[0, 1]]}}, "unknown sort": {"sort": "nope"},
        "text for a number": {"filter": {"quality": ["0", "1"]}}, "a fraction": {"filter": {"quality": [0.5, 1]}}, "beyond the type": {"agg": {"toxic": [[0, 1 << 40]]}},
    }
    rows = []
    for name, request in asked.items():
        try:
            engine.search(request)
            rows.append((name, None))
        except (UnknownFeature, InvalidRange) as e:
            rows.append((name, type(e).__name__))
    rows.append(("too large", "RequestTooLarge" if _refused(RequestTooLarge, SearchRequest.from_json, '{"fulltext": "' + "x" * 4096 + '"}') else None))
    return spark.createDataFrame(rows, "request string, refused string")


# query language --------------------------------------------------------------------------------------------------

_TYPED = [
    ("gula", [("gula", False, None, "should")]), ("-ads", [("ads", False, None, "must_not")]), ("+love", [("love", False, None, "must")]), ('"gula recipes"', [("gula recipes", True, None, "should")]),
    ('-"ads and tracking"', [("ads and tracking", True, None, "must_not")]), ('+"great food"', [("great food", True, None, "must")]),
    (' +peanut -"peanut butter" -sugar roast', [("peanut", False, None, "must"), ("peanut butter", True, None, "must_not"), ("sugar", False, None, "must_not"), ("roast", False, None, "should")]),
    ("title:potato:queen", [("potato:queen", False, "title", "should")]), ("other:banana", [("other:banana", False, None, "should")]), ("--x", [("-x", False, None, "must_not")]), ("+-x", [("-x", False, None, "must")]),
    ('an "open', [("an", False, None, "should"), ('"open', False, None, "should")]), ("", []),
]


@query(_values("typed, place, text, phrase, field, occur", [(t, i, *c) for t, cs in _TYPED for i, c in enumerate(cs)]))
def query_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, i, c.text, c.phrase, c.field, c.occur.value) for t, _ in _TYPED for i, c in enumerate(parse(t, ["title"]))]
    return spark.createDataFrame(rows, "typed string, place int, text string, phrase boolean, field string, occur string")


@query(_values("validator, field, text", [("all", "a", "x"), ("none", None, "a:x"), ("list", "a", "x"), ("function", None, "a:x")]))
def field_name_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"all": True, "none": False, "list": ["a"], "function": lambda name: name == "b"}
    return spark.createDataFrame([(n, (c := parse("a:x", v)[0]).field, c.text) for n, v in kinds.items()], "validator string, field string, text string")


@query(_INDEX + "select doc_id, round(sum(s), 6) as score from sc where (field = 'head' and term = 'that') or (field = 'body' and term in ('with', 'body', 'and')) group by doc_id")
def parser_names_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field by another name, one that can't be addressed, and a default field."""
    parser = QueryParser(["head", "body"])
    parser.set_name("head", "first")
    parser.set_name("body", None)
    parser.set_default_fields(["body", "unknown"])
    return search(index_of(spark, sf_dir), parser.parse("first:that with body:and")).select("doc_id", F.round("score", 6).alias("score"))


@query(
    _INDEX
    + ", m as (select doc_id, max(case field when 'head' then s * 2.0 end) as h, max(case field when 'body' then s end) as b from sc where term = 'that' group by doc_id),"
    " x as (select doc_id, h, b, greatest(coalesce(h, 0.0), coalesce(b, 0.0)) as best, coalesce(h, 0.0) + coalesce(b, 0.0) as total from m)"
    " select doc_id, '0' as node, '' as occur, 'dismax tiebreaker 0.1' as what, true as matched, round(best + (total - best) * 0.1, 6) as score, null::bigint as tf from x"
    " union all select doc_id, '0.0', '', 'boost x 2.0', h is not null, round(h, 6), null from x union all select doc_id, '0.0.0', '', 'term head:that', h is not null, round(h / 2.0, 6), null from x"
    " union all select doc_id, '0.1', '', 'term body:that', b is not null, round(b, 6), null from x"
)
def explain_dismax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each disjunct beside what they give together."""
    q = QueryParser(["head", "body"], boosts={"head": 2.0}).parse_dismax("that", 0.1)
    return explain_nodes(index_of(spark, sf_dir), q).withColumn("score", F.round("score", 6))


# keywords as queries ---------------------------------------------------------------------------------------------

_TEXT = (
    _INDEX
    + ", tx as (select unnest(list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: strlen(x) < 40), lambda x: lower(x))) as term from benchmark where item_id = (select min(item_id) from benchmark)),"
    " tt as (select term, count(*) as tf from tx group by term), kt as (select field, term, round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as score from tt join st using (term), nd),"
    " kr as (select *, row_number() over (order by score desc, field, term) as rank from kt), kk as (select * from kr where rank <= 12)"
)


def _of_text(spark: SparkSession, sf_dir: str) -> Keywords:
    """Of the first benchmark item, with regard to both fields."""
    text = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]
    return TopTerms(index_of(spark, sf_dir), ["head", "body"]).extract(12, text)


@query(_TEXT + "select field, term, score, rank from kk")
def keywords_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_text(spark, sf_dir).ranked.withColumn("rank", F.col("rank").cast("long"))


@query(_TEXT + "select count(*) as n, count(*) = 0 as is_empty, string_agg(field || ':' || term, ' ' order by rank) as terms from kk")
def keywords_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _of_text(spark, sf_dir)
    return spark.createDataFrame([(len(k), k.is_empty, " ".join(f"{f}:{t}" for f, t, _ in k.terms()))], "n long, is_empty boolean, terms string")


@query(_TEXT + ", " + "hits as (select doc_id, round(sum(s), 6) as score from sc join (select field, term from kk) using (field, term) group by doc_id) " + _top("select * from hits"))
def keywords_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), _of_text(spark, sf_dir).into_query()))


@query(_TEXT + ", hits as (select doc_id, round(sum(s * (1.5 * (score / (select max(score) from kk)))), 6) as score from sc join (select field, term, score from kk) using (field, term) group by doc_id) " + _top("select * from hits"))
def keywords_boosted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(index_of(spark, sf_dir), _of_text(spark, sf_dir).into_boosted_query(1.5)))


# engine ----------------------------------------------------------------------------------------------------------


def _engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    index = index_of(spark, sf_dir)
    docs = index.docs.withColumn("uuid", _uuid("doc_id"))
    return Engine(replace(index, docs=docs), LABELS, **{"boosts": {"head": 1.15, "body": 0.7}, **options})


@query("select o_orderkey, translate(rtrim(base64(unhex('01' || lpad(to_hex(o_orderkey), 16, '0') || md5(o_orderkey::varchar))), '='), '+/', '-_') as cursor from orders")
def cursor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", integer_cursors(F.col("o_orderkey"), _uuid("o_orderkey")).alias("cursor"))


_SORTS = {"relevance": "1 desc", "relevance_asc": "1", "quality": "coalesce(quality, 0) desc", "quality_asc": "coalesce(quality, 0)", "toxic": "coalesce(toxic, 0) desc", "toxic_asc": "coalesce(toxic, 0)"}


@query(" union all ".join(f"select * from (select '{s}' as sort, row_number() over (order by {o.replace('1', 'one')}, doc_id) as rank, doc_id from (select *, 1 as one from {_LABELLED})) where rank <= 3" for s, o in _SORTS.items()))
def engine_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of every sort there is."""
    engine = _engine(spark, sf_dir)
    rows = [(s, r["rank"], r["doc_id"]) for s in engine.sorts for r in engine.search({"sort": s, "num_items": 3}).items.collect()]
    return spark.createDataFrame(rows, "sort string, rank long, doc_id long")


@query("select doc_id, row_number() over (order by doc_id) as rank, (select count(*) from documents) as total from documents order by doc_id limit 10")
def engine_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing asked: ten documents, by relevance."""
    found = _engine(spark, sf_dir).search({})
    return found.items.select("doc_id", F.col("rank").cast("long").alias("rank"), F.lit(found.total_found).cast("long").alias("total"))


_ASKED_FACETS = {"quality": [(0, 1), (1, 2)], "toxic": [(1, 2), (0, 2)]}
_MATCHING = "(select * from documents left join labels using (doc_id) where doc_id in (select doc_id from post where term = 'with' group by doc_id)) d"


@query(_INDEX + f", f as ({_facet_sql(_MATCHING, _ASKED_FACETS)}) select feature, bucket, min, max, count, (select count(*) from {_MATCHING}) as total from f")
def engine_total_and_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, facets and a page from one pass over the matches."""
    found = _engine(spark, sf_dir).search({"fulltext": "with", "agg": _ASKED_FACETS, "num_items": 5})
    rows = [(f, i, x["min"], x["max"], x["count"], found.total_found) for f, xs in found.agg.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "feature string, bucket int, min double, max double, count long, total long")


@query(_values("asked, features", [("nothing", None), ("empty", ""), ("one of two", "quality"), ("both", "quality,toxic")]))
def engine_agg_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without ranges don't appear in the answer."""
    asked = {"nothing": None, "empty": {}, "one of two": {"quality": [(0, 1)], "toxic": []}, "both": {"toxic": [(0, 1)], "quality": [(0, 1)]}}
    engine = _engine(spark, sf_dir)
    rows = [(n, None if (x := engine.search({"agg": a, "num_items": 1}).agg) is None else ",".join(sorted(x))) for n, a in asked.items()]
    return spark.createDataFrame(rows, "asked string, features string")


@query(_INDEX + f", t as (select count(*) as n from {_MATCHING}) select k as threshold, n <= k as has_facets from t, (select unnest([n - 1, n, n + 1]) as k from t)")
def engine_agg_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _engine(spark, sf_dir).search({"fulltext": "with", "num_items": 1}).total_found
    rows = [(k, _engine(spark, sf_dir, agg_threshold=k).search({"fulltext": "with", "agg": _ASKED_FACETS, "num_items": 1}).agg is not None) for k in (total - 1, total, total + 1)]
    return spark.createDataFrame(rows, "threshold long, has_facets boolean")


@dataclass
class _Spread:
    """An aggregation of one's own."""

    feature: str

    def columns(self) -> list[Column]:
        x = F.col(self.feature).cast("long")
        return [F.sum(x).alias("total"), F.count(x).alias("n"), (F.max(x) - F.min(x)).alias("spread")]


@query(_INDEX + f"select sum(quality)::bigint as total, count(quality) as n, (max(quality) - min(quality))::bigint as spread from {_MATCHING}")
def user_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(_engine(spark, sf_dir).matches("with", None, False), _Spread("quality"))


@query("select doc_id, lang, source, n_chars from documents where doc_id = 5")
def engine_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).get(_uuid_of(spark, 5)).select("doc_id", "lang", "source", "n_chars")


@query(f"select feature, min, max, count, (select count(*) from documents) as total, '{','.join(_SORTS)}' as sorts from ({_facet_sql(_LABELLED, full_ranges(LABELS))})")
def info_full_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _engine(spark, sf_dir).info()
    rows = [(f, x["min"], x["max"], x["count"], info["total_recipes"], ",".join(info["sorts"])) for f, (x,) in info["features"].items()]
    return spark.createDataFrame(rows, "feature string, min double, max double, count long, total long, sorts string")


@query(
    _INDEX
    + "select doc_id, k::double as sort_key, row_number() over (order by k desc, doc_id) as rank from (select doc_id, round(sum(s), 6)::float as k from (select doc_id, term, max(s) + (sum(s) - max(s)) * 0.1 as s from"
    " (select doc_id, term, s * case field when 'head' then 1.15 else 0.7 end as s from sc where term in ('that', 'with')) group by doc_id, term) group by doc_id) qualify rank <= 10"
)
def engine_default_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields called name and instructions have boosts of their own."""
    index = index_of(spark, sf_dir)
    named = lambda df: df.withColumn("field", F.when(F.col("field") == "head", "name").otherwise("instructions"))
    docs = index.docs.withColumn("uuid", _uuid("doc_id"))
    own = replace(index, docs=docs, fields=["name", "instructions"], postings=named(index.postings), term_stats=named(index.term_stats), field_stats=named(index.field_stats))
    return Engine(own, LABELS).search({"fulltext": "that with"}).items.select("doc_id", "sort_key", F.col("rank").cast("long").alias("rank"))


@query(_values("setting, value", [("agg_threshold", "None"), ("boosts", "instructions=0.7 name=1.15"), ("tiebreaker", "0.1"), ("unsortable", "None"), ("uuid", "uuid")]))
def engine_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(replace(index_of(spark, sf_dir)), LABELS)
    own = {f.name: getattr(engine, f.name) for f in fields(engine) if f.name not in ("index", "features", "card", "_info")}
    own["boosts"] = " ".join(f"{k}={v}" for k, v in sorted(own["boosts"].items()))
    return spark.createDataFrame([(k, str(v)) for k, v in own.items()], "setting string, value string")


@query("select doc_id, row_number() over (order by coalesce(quality, 0) desc, doc_id) as rank, md5(doc_id::varchar) as uuid, (select count(*) from documents) as total from " + _LABELLED + " order by coalesce(quality, 0) desc, doc_id limit 6")
def engine_respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request and its answer in JSON, with cards of one's own."""
    engine = _engine(spark, sf_dir, card=lambda records: records.select("doc_id", "rank", "uuid"))
    answer = spark.createDataFrame([(engine.respond('{"sort": "quality", "num_items": 6}'),)], "json string")
    parsed = answer.select(F.from_json("json", "items array<struct<doc_id: bigint, rank: bigint, uuid: string>>, total_found bigint").alias("x"))
    return parsed.select(F.explode("x.items").alias("i"), "x.total_found").select("i.doc_id", "i.rank", F.regexp_replace("i.uuid", "-", "").alias("uuid"), F.col("total_found").alias("total"))
