from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.engine import Engine, RequestTooLarge, SearchRequest
from fathom.functions.cursor import Cursor, CursorMismatch, UnknownCursor
from fathom.operators.store import MissingRecord, RecordStore, hydrate, hydrate_all
from fathom.plans.compiler import search
from fathom.plans.features import FeatureSet, InvalidRange, UnknownFeature
from fathom.sources.index import Index
from fathom.sources.records import FEATURES, FixedLog, InvalidData, as_json, card, fixed_width, flattened, info, read_records, unsigned, write_csv
from fathom.streaming.ingest import IndexSink

WORDS = "cheese bacon potato onion garlic salt pepper lemon butter cream".split()


def recipe(i: int, rng: random.Random) -> dict:
    pick = lambda n: [rng.choice(WORDS) for _ in range(n)]
    steps = [" ".join(pick(6)) for _ in range(3)]
    return {
        "uuid": str(uuid.UUID(int=i + 1)), "recipe_id": i, "name": " ".join(pick(2)), "crawl_url": f"http://x/{i}", "ingredients": pick(3), "instructions": steps,
        "images": [] if i % 3 else [f"{i}.jpg", "b.jpg"], "similar_recipe_ids": [],
        "features": {"num_ingredients": 3, "instructions_length": sum(map(len, steps)), "total_time": None if i % 4 == 0 else i % 5 * 10, "fat_content": None if i % 2 else i / 7},
    }


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    import json

    rng = random.Random(5)
    path = tmp_path_factory.mktemp("recipes") / "r.jsonlines"
    path.write_text("".join(json.dumps(recipe(i, rng)) + "\n" for i in range(60)))
    return read_records(spark, str(path))


@pytest.fixture(scope="module")
def engine(records, tmp_path_factory):
    docs = flattened(records)
    index = Index.build(docs, {f: F.col(f) for f in ("name", "ingredients", "instructions")}, key="recipe_id")
    stored = index.write(str(tmp_path_factory.mktemp("index") / "i"))
    return Engine(stored, FEATURES)


def ids(result):
    return [r["doc_id"] for r in result.items.orderBy("rank").collect()]


@pytest.mark.parametrize("sort", ["relevance", "relevance_asc", "total_time", "total_time_asc", "fat_content", "num_ingredients_asc"])
def test_pages_visit_all_once_in_order(engine, sort):
    whole = engine.search({"fulltext": "cheese bacon", "sort": sort, "num_items": 100})
    seen, after = [], None
    while True:
        page = engine.search(SearchRequest("cheese bacon", sort, 17, after=after))
        assert page.total_found == whole.total_found
        seen += ids(page)
        if page.next is None:
            break
        after = page.next
    assert seen == ids(whole) and len(set(seen)) == whole.total_found > 17
    assert whole.next is None


def test_facets_agree_with_filters(engine):
    agg = {"total_time": [(0, 15), (15, 60), (5, 31)]}
    got = engine.search({"fulltext": "cheese", "agg": agg, "num_items": 1})
    for (low, high), bucket in zip(agg["total_time"], got.agg["total_time"]):
        assert engine.search({"fulltext": "cheese", "filter": {"total_time": (low, high)}}).total_found == bucket["count"]
    # a cursor changes neither total nor facets
    second = engine.search({"fulltext": "cheese", "agg": agg, "num_items": 1, "after": got.next})
    assert (second.total_found, second.agg) == (got.total_found, got.agg)
    engine.agg_threshold = 3
    assert engine.search({"fulltext": "cheese", "agg": agg}).agg is None
    engine.agg_threshold = None


def test_defaults_and_errors(engine):
    everything = engine.search({})
    assert everything.total_found == 60 and len(ids(everything)) == 10 and everything.agg is None
    assert engine.search({"ascending": True}).total_found == 60
    with pytest.raises(ValueError):
        engine.search({"num_items": 0})
    for bad in ({"sort": "diet_vegan"}, {"sort": "nope"}, {"nope": 1}, {"agg": {"nope": [(0, 1)]}}, {"filter": {"nope": (0, 1)}}):
        with pytest.raises(UnknownFeature):
            engine.search(bad)
    with pytest.raises(CursorMismatch):
        engine.search({"sort": "total_time", "after": everything.next})
    with pytest.raises(UnknownCursor):
        engine.search({"after": Cursor(0, 1.0, uuid.UUID(int=10**9)).encode()})
    assert len(engine.sorts) == 20
    assert engine.get(str(uuid.UUID(int=4))).first()["doc_id"] == 3 and engine.get("nope").isEmpty()
    assert engine.info()["total_recipes"] == 60
    assert engine.info()["features"]["num_ingredients"] == [{"min": 3, "max": 3, "count": 60}]
    assert engine.info() is engine.info()


def test_projections_and_sinks(spark, records, tmp_path):
    import json

    first, second = card(flattened(records).orderBy("recipe_id")).limit(2).collect()
    assert (first["image"], second["image"]) == ("0.jpg", None) and first["instructions_length"] > 0
    texts = [r["json"] for r in as_json(info(flattened(records)).where("uuid like '%0002'")).collect()]
    assert texts and all('"images"' not in t and "diet_vegan" not in t and '"name"' in t for t in texts)
    write_csv(card(flattened(records)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 60
    with pytest.raises(Exception, match="(?i)already.exists"):
        write_csv(card(flattened(records)), str(tmp_path / "csv"))
    (tmp_path / "bad.jsonlines").write_text(f"{json.dumps(recipe(1, random.Random(1)))}\nnot json\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_records(spark, str(tmp_path / "bad.jsonlines")).collect()


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"uuid": None}, "uuid is required"), ({"recipe_id": None}, "recipe_id is required"), ({"features": {"instructions_length": 1}}, "num_ingredients isn't"),
        ({"features": {"num_ingredients": 300, "instructions_length": 1}}, "num_ingredients isn't of type u8"), ({"features": {"num_ingredients": 3, "instructions_length": 1, "calories": -5}}, "calories"),
    ],
)
def test_records_without_what_they_need_fail_the_load(spark, tmp_path, change, message):
    import json

    good = recipe(1, random.Random(1))
    (tmp_path / "r.jsonlines").write_text(json.dumps(good) + "\n" + json.dumps({k: v for k, v in (good | change).items() if v is not None}) + "\n")
    with pytest.raises(Exception, match=message):
        read_records(spark, str(tmp_path / "r.jsonlines")).select("name").collect()


KINDS = {"u8": [0, 7, 7, 255], "u16": [0, 65535], "u32": [5, 2**32 - 1], "u64": [0, 2**63 - 1, 2**62 + 1], "i8": [-128, -5, 127], "i16": [-7, 0, 32767], "i32": [-7, -5, -1, 5, -(2**31)], "i64": [-(2**63), 2**63 - 1, -(2**62) - 1, 3], "f32": [-1.5, 0.1, 3e38], "f64": [-1e300, 0.1, 1e300]}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("ascending", [False, True])
def test_pages_of_every_kind_of_feature(spark, kind, ascending):
    values = [v for v in KINDS[kind] for _ in range(3)] + [None]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("uuid", T.StringType()), T.StructField("t", T.StringType()), FeatureSet.of(x=f"{kind}?").schema[0]])
    docs = spark.createDataFrame([(i, str(uuid.UUID(int=i)), "word", v) for i, v in enumerate(values)], schema).coalesce(1)
    engine = Engine(Index.build(docs, {"t": F.col("t")}), FeatureSet.of(x=f"{kind}?"))
    seen, after = [], None
    while True:
        page = engine.search({"sort": "x_asc" if ascending else "x", "num_items": 4, "after": after})
        seen += ids(page)
        after = page.next
        if after is None:
            break
    key = lambda i: values[i] or 0
    assert seen == sorted(range(len(values)), key=lambda i: (key(i) if ascending else -key(i), i))


def test_requests_and_answers_in_json(engine):
    import json

    body = {"fulltext": "cheese", "sort": "num_ingredients_asc", "num_items": 3, "agg": {"total_time": [[0, 15], [15, 60]]}}
    answer = json.loads(engine.respond(json.dumps(body)))
    want = engine.search(body)
    assert [x["uuid"] for x in answer["items"]] == [r["uuid"] for r in want.items.collect()] and answer["total_found"] == want.total_found
    assert answer["next"] == want.next and answer["agg"] == want.agg
    assert set(answer["items"][0]) <= {"name", "uuid", "crawl_url", "num_ingredients", "instructions_length", "image", "total_time", "calories"}
    last = json.loads(engine.respond(json.dumps({"fulltext": "cheese", "num_items": 1000})))
    assert "next" not in last and "agg" not in last
    with pytest.raises(RequestTooLarge):
        engine.respond(json.dumps({"fulltext": "x" * 4096}))
    with pytest.raises(ValueError):
        engine.respond("[]")


@pytest.mark.parametrize("bounds", [(0,), (0, 1, 2), (0.5, 3), ("0", "3"), (True, 3), (-1, 3), (0, 2**32), (0, None), 3])
def test_ranges_must_be_of_their_features_type(engine, bounds):
    with pytest.raises(InvalidRange):
        engine.search({"filter": {"total_time": bounds}})
    with pytest.raises(InvalidRange):
        engine.search({"agg": {"total_time": [bounds]}})


def test_the_matches_are_found_once(engine, monkeypatch):
    """Whatever is asked of them: postings are scanned by one of the search's jobs."""
    from fathom import engine as module

    calls = []
    monkeypatch.setattr(module, "search", lambda *a: calls.append(a) or search(*a))
    found = engine.search({"fulltext": "cheese", "agg": {"total_time": [(0, 15)]}})
    assert len(calls) == 1 and found.total_found > 0 and found.agg["total_time"][0]["count"] > 0


def test_record_store(spark, records, tmp_path):
    store = RecordStore.create(records.limit(10), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)already.exists"):
        RecordStore.create(records, str(tmp_path / "s"))
    store.append(records.where("recipe_id = 3").withColumn("name", F.lit("later")), 1)
    assert len(store) == 10
    assert store.find_by_id(3).first()["name"] == "later"
    assert store.find_by_uuid(str(uuid.UUID(int=4))).first()["name"] == "later"
    assert store.id_for_uuid(str(uuid.UUID(int=4))) == 3 and store.id_for_uuid("nope") is None
    assert store.find_by_id(99).isEmpty()
    page = spark.createDataFrame([(4, 1), (2, 2)], "recipe_id long, rank int")
    assert [r["recipe_id"] for r in hydrate_all(page, store.records(), "recipe_id").collect()] == [4, 2]
    assert [r["recipe_id"] for r in hydrate(page, store.records(), "recipe_id").collect()] == [4, 2]
    with pytest.raises(Exception, match="names a record that is missing"):
        hydrate(spark.createDataFrame([(77, 1)], "recipe_id long, rank int"), store.records(), "recipe_id").collect()
    with pytest.raises(MissingRecord):
        hydrate_all(spark.createDataFrame([(77, 1)], "recipe_id long, rank int"), store.records(), "recipe_id")


def test_append_only_log(spark, tmp_path):
    log = FixedLog(spark, str(tmp_path / "log"), 8)
    assert len(log) == 0
    entry = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    log.append(spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "n long").repartition(3), ["n"], entry)
    log.append(spark.createDataFrame([(2,), (0,)], "n long"), [-F.col("n")], entry)
    assert len(log) == 6
    assert [(r["number"], int.from_bytes(r["entry"])) for r in log.entries().orderBy("number").collect()] == list(enumerate([1, 3, 5, 9, 2, 0]))
    with pytest.raises(Exception, match="isn't of 8 bytes"):
        log.append(spark.createDataFrame([(1,)], "n long"), ["n"], F.unhex(F.lit("00")))
    assert len(FixedLog(spark, str(tmp_path / "log"), 8)) == 6
    for width in (0, 7):
        with pytest.raises(InvalidData):
            FixedLog(spark, str(tmp_path / "log"), width)


def test_fixed_width_log(spark, tmp_path):
    entries = [(7, b"abcd"), (2**40, b"wxyz")]
    (tmp_path / "log.bin").write_bytes(b"".join(n.to_bytes(8, "big") + t for n, t in entries))
    fields = [("n", 8, unsigned), ("t", 4, lambda raw: F.decode(raw, "UTF-8"))]
    rows = fixed_width(spark, str(tmp_path / "log.bin"), fields, 12).orderBy("number").collect()
    assert [(r["n"], r["t"].encode()) for r in rows] == entries
    (tmp_path / "bad.bin").write_bytes(b"x" * 13)
    with pytest.raises(InvalidData):
        fixed_width(spark, str(tmp_path / "bad.bin"), fields, 12)


def test_streamed_index_equals_a_batch_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{WORDS[i % 7]} {WORDS[i % 3]} soup") for i in range(30)], "doc_id long, t string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    sink = IndexSink(str(tmp_path / "out"), {"t": F.col("t")})
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink.start(stream, str(tmp_path / "cp")).awaitTermination()
    sink.write_batch(spark.read.parquet(sorted(str(p) for p in (tmp_path / "in").glob("*.parquet"))[0]), 99)
    import shutil

    shutil.rmtree(tmp_path / "out/forward/batch=99")
    shutil.rmtree(tmp_path / "out/docs/batch=99")
    got, want = sink.open(spark), Index.build(docs, {"t": F.col("t")})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got.term_stats) == key(want.term_stats)
    assert key(got.field_stats) == key(want.field_stats)
    assert got.num_docs().first()[0] == 30
    stored = sink.compact(spark, str(tmp_path / "whole"))
    assert key(stored.postings) == key(want.postings) and stored.num_docs().first()[0] == 30
