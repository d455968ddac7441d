"""The search engine: full text, filters, sorts in both directions, keyset pages, facets, records."""

from __future__ import annotations

import json
import struct
import uuid as uuids
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.cursor import DOUBLE, INTEGER, RELEVANCE, Cursor, CursorMismatch, UnknownCursor, signed
from fathom.operators.facets import as_lists, full_ranges, range_stats, stats_columns, stats_rows
from fathom.operators.filters import range_predicate
from fathom.operators.store import hydrate, last_wins
from fathom.operators.topk import after, sort_key, top_k
from fathom.plans.compiler import search
from fathom.plans.features import FeatureSet, UnknownFeature
from fathom.plans.query import All, Query, QueryParser
from fathom.sources.index import Index
from fathom.sources.records import as_json, card

#: Longest request, in bytes.
REQUEST_BYTES = 4096


class RequestTooLarge(ValueError):
    """A request of more than ``REQUEST_BYTES``."""


@dataclass(frozen=True)
class SearchRequest:
    """``ascending`` is accepted for compatibility and has no effect: a sort's name says its direction."""

    fulltext: str | None = None
    sort: str | None = None
    num_items: int | None = None
    filter: Mapping[str, tuple[float, float]] | None = None
    agg: Mapping[str, list[tuple[float, float]]] | None = None
    after: str | None = None
    ascending: bool | None = None

    @staticmethod
    def of(request: Mapping) -> SearchRequest:
        unknown = set(request) - {f.name for f in fields(SearchRequest)}
        if unknown:
            raise UnknownFeature(", ".join(sorted(unknown)))
        return SearchRequest(**request)

    @staticmethod
    def from_json(body: str | bytes) -> SearchRequest:
        raw = body.encode() if isinstance(body, str) else body
        if len(raw) > REQUEST_BYTES:
            raise RequestTooLarge(f"{len(raw)} bytes, of {REQUEST_BYTES} at most")
        request = json.loads(raw)
        if not isinstance(request, dict):
            raise ValueError("a request is an object")
        return SearchRequest.of(request)


@dataclass
class SearchResult:
    items: DataFrame
    total_found: int
    next: str | None = None
    agg: dict[str, list[dict]] | None = None


@dataclass
class Engine:
    """Over an index whose docs hold the features, a uuid column and whatever cards show.

    boosts and tiebreaker are those of the default query: a clause's score is its best field's and a tenth of the others'.
    Facets are computed only up to ``agg_threshold`` matches. Diets (features called ``diet_...``) can't be sorted by, unless
    ``unsortable`` names others. ``card`` turns records into what lists of results show.
    """

    index: Index
    features: FeatureSet
    unsortable: frozenset[str] | None = None
    boosts: Mapping[str, float] = field(default_factory=lambda: {"name": 1.15, "instructions": 0.7})
    tiebreaker: float = 0.1
    agg_threshold: int | None = None
    uuid: str = "uuid"
    card: Callable[[DataFrame], DataFrame] = card
    _info: dict | None = None

    def __post_init__(self) -> None:
        self.features.validate(self.index.docs.schema)

    # sorts -------------------------------------------------------------------------------------------------------

    @property
    def sorts(self) -> list[str]:
        no = {s.name for s in self.features.specs if s.name.startswith("diet_")} if self.unsortable is None else self.unsortable
        names = ["relevance"] + [s.name for s in self.features.specs if s.name not in no]
        return [x for n in names for x in (n, f"{n}_asc")]

    def _sort(self, sort: str | None) -> tuple[Column, bool, int]:
        """(key, ascending, tag of its cursors)"""
        sort = sort or "relevance"
        if sort not in self.sorts:
            raise UnknownFeature(sort)
        name = sort.removesuffix("_asc")
        if name == "relevance":
            # as the cursor stores it, so that resuming compares equal
            return F.round("score", 6).cast("float"), sort != name, RELEVANCE
        spec = self.features[name]
        return sort_key(F.col(name), spec.is_float).cast("double" if spec.is_float else "long"), sort != name, DOUBLE if spec.is_float else INTEGER

    # queries -----------------------------------------------------------------------------------------------------

    def query(self, fulltext: str | None) -> Query:
        parser = QueryParser(list(self.index.fields), boosts={f: b for f, b in self.boosts.items() if f in self.index.fields})
        return (parser.parse_dismax(fulltext, self.tiebreaker) if fulltext else None) or All()

    def matches(self, fulltext: str | None, ranges: Mapping[str, tuple[float, float]] | None, scored: bool) -> DataFrame:
        """All columns of the matching documents, and their score. Filters are applied to the documents before the join,
        and don't add to scores."""
        docs = self.index.docs
        if ranges:
            docs = docs.where(range_predicate(ranges, self.features))
        q = self.query(fulltext)
        if isinstance(q, All):
            return docs.withColumn("score", F.lit(1.0))
        return docs.join(search(self.index, q, scored), "doc_id")

    def search(self, request: SearchRequest | Mapping) -> SearchResult:
        r = request if isinstance(request, SearchRequest) else SearchRequest.of(request)
        k = 10 if r.num_items is None else r.num_items
        if k <= 0:
            raise ValueError("num_items must be positive")
        key, ascending, tag = self._sort(r.sort)
        condition = self._after(r.after, tag, key, ascending)
        agg = {name: [self.features[name].checked_range(x) for x in ranges] for name, ranges in (r.agg or {}).items()}
        found = self.matches(r.fulltext, r.filter, tag == RELEVANCE).select("doc_id", key.alias("sort_key"), *agg)
        # the matches are found once, whatever is asked of them: total, facets and page read what that left
        found = found.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            gated = self.agg_threshold is not None
            row = found.agg(F.count("*").alias("total"), *([] if gated else stats_columns(agg))).first()
            total, facets = row["total"], None
            if r.agg is not None and (not gated or total <= self.agg_threshold):
                facets = as_lists(stats_rows(row, agg) if not gated else range_stats(found, agg).collect())
            rest = found if condition is None else found.where(condition)
            # one more than a page tells whether there is a next one
            page = top_k(rest.select("doc_id", "sort_key"), F.col("sort_key"), F.col("doc_id"), k + 1, ascending).collect()
        finally:
            found.unpersist()
        shown = page[:k]
        spark = self.index.docs.sparkSession
        ranked = spark.createDataFrame([(x["doc_id"], x["rank"], float(x["sort_key"])) for x in shown], "doc_id long, rank int, sort_key double")
        # the page's ids reach the scan of the records
        records = self.index.docs.where(F.col("doc_id").isin([x["doc_id"] for x in shown]))
        items = hydrate(ranked, records)
        return SearchResult(items, total, self._cursor(shown[-1], tag) if len(page) > k else None, facets)

    def respond(self, body: str | bytes) -> str:
        """A request in JSON, answered in JSON: items (as cards), total_found, and next and agg where there are any."""
        r = self.search(SearchRequest.from_json(body))
        cards = as_json(self.card(r.items)).collect()  # a page, in its order
        out: dict = {"items": [json.loads(x["json"]) for x in cards], "total_found": r.total_found}
        return json.dumps(out | ({"next": r.next} if r.next else {}) | ({"agg": r.agg} if r.agg else {}))

    def _cursor(self, last, tag: int) -> str:
        row = self.index.docs.where(F.col("doc_id") == last["doc_id"]).select(self.uuid).first()
        return Cursor(tag, last["sort_key"], uuids.UUID(row[0])).encode()

    def _after(self, text: str | None, tag: int, key: Column, ascending: bool) -> Column | None:
        if text is None:
            return None
        cursor = Cursor.decode(text)
        if cursor.tag != tag:
            raise CursorMismatch("a cursor of another sort")
        row = self.index.docs.where(F.col(self.uuid) == str(cursor.uuid)).select("doc_id").first()
        if row is None:
            raise UnknownCursor(str(cursor.uuid))
        if tag == RELEVANCE:
            value = F.lit(struct.unpack(">f", struct.pack(">f", cursor.value))[0]).cast("float")
        else:
            value = F.lit(signed(cursor.value)).cast("long") if tag == INTEGER else F.lit(cursor.value)
        return after(F.col("sort_key"), F.col("doc_id"), value, row[0], ascending)

    # records -----------------------------------------------------------------------------------------------------

    def get(self, uuid: str) -> DataFrame:
        """The record of a uuid; no row where there is none."""
        return self.index.docs.where(F.col(self.uuid) == str(uuid))

    def info(self) -> dict:
        """Number of records, statistics of all features over their full ranges, and sorts; computed once."""
        if self._info is None:
            total = self.index.num_docs().first()[0]
            self._info = {"total_recipes": total, "features": as_lists(range_stats(self.index.docs, full_ranges(self.features)).collect()), "sorts": self.sorts}
        return self._info


def deduplicated(records: DataFrame, key: str, sequence: str) -> DataFrame:
    """Records ready to index: of several with one key, the last."""
    return last_wins(records, key, sequence)
