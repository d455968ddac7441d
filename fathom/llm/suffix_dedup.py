"""Suffix-array dedup by a logarithmic family of indexes.

Wanted: every passage of at least ``length`` words that stands in two or more documents. The index is a family of levels;
a new batch gets a suffix array of its own, is merge-scanned against the levels there are for matches of ``length``
words, and then levels of equal size merge, so that n batches lie in at most log2(n) + 1 levels.

The family is distributed by content. Each window of ``length`` words has one anchor: of its ``gram``-word runs the one of
smallest hash, the leftmost on ties. Equal windows have equal anchors, so the windows of an anchor form one snippet of
text, and all snippets of an anchor go to one task. Before that, equal snippets become one, with the smallest and the
largest document that has them: however many copies a passage has, it's indexed once.

``repeated_passages`` looks at one set of documents. There an anchor seen in a single document sorts out all its windows
exactly, without a suffix array; and an anchor of more than ``HOT`` occurrences (a licence's words, say, before thousands
of continuations) is split: each of its windows goes where the whole window's hash says. ``StoredFamily`` keeps the levels
in the shared folder; adding a batch reads the levels and the batch, never earlier texts.

Defined results
- null or empty text, null id, fewer than ``length`` words: no span. Very long texts: whole.
- repeated rows and rows that share an id are one document: what repeats only among them, or within one row, is no repeat
  across documents; their spans are united.
- ties: ``other_doc`` is the smallest other document that shares a window of the span (for the document that is itself
  the smallest of a window: the largest). Empty table: empty result. Extra columns: ignored, kept by the stage.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import WORD, Tokens, c, chunks, cut, exists, fresh, lowered, mix64, ngram_hash, qualified, shuffle_partitions, tokens

LENGTH, GRAM, BATCH_WORDS, HOT = 50, 8, 300_000, 20_000
_PLACE = np.uint64((1 << 32) - 1)


def anchors(t: Tokens, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first, last): each anchor's hash, its text, and the first words of its first and its last window."""
    n = len(t.hashes)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none
    h = ngram_hash(t.hashes, gram)
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    starts = np.arange(n - length + 1)
    starts = starts[starts + length <= t.first[text[: n - length + 1] + 1]]
    if not len(starts):
        return none, none, none, none
    least, size, wide = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: size - wide], least[wide - size :])
    at = (least[starts] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(at)]]) - 1
    return h[at[begin]].view(np.int64), text[starts[begin]], starts[begin], starts[end]


def _pairs(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two words at each place as one number, in the order of the words."""
    return text[at].astype(np.uint64) << np.uint64(32) | text[at + 1]


@dataclass
class Level:
    """A suffix array over windows. Equal windows are one run, which stands in the order once."""

    text: np.ndarray  # words as 32-bit hashes
    at: np.ndarray  # of each run a place in text, in the order of the words there
    head: np.ndarray  # the first two words there
    low: np.ndarray  # smallest and largest document known to have the run's words, here or in any other level
    high: np.ndarray
    run: np.ndarray  # of each window its run, snippet and place in the snippet
    owner: np.ndarray
    inner: np.ndarray
    rank: int = 0

    @staticmethod
    def of(text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, inner: np.ndarray, length: int) -> Level:
        """Sorts the windows at ``at`` by prefix doubling, as deep as their length and no deeper."""
        n, deep = len(text), 2
        padded = np.concatenate([text, np.zeros(length + 2, text.dtype)])
        key = _pairs(padded, np.arange(n))
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.zeros(n + length, np.uint64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64) + np.uint64(1)
            if 2 * deep > length:
                break
            key = rank[:n] << np.uint64(32) | rank[deep : n + deep]
            deep *= 2
        key = rank[at] << np.uint64(32) | rank[at + length - deep]
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        begin = np.flatnonzero(new)
        run = np.empty(len(at), np.int64)
        run[order] = np.cumsum(new) - 1
        rep = at[order[begin]]
        return Level(text, rep, _pairs(padded, rep), np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin), run, owner, inner)


def _compare(a: Level, i: np.ndarray, b: Level, j: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for each pair of runs, whose first two words are equal already."""
    out = np.zeros(len(i), np.int8)
    x, y, live = a.at[i], b.at[j], np.arange(len(i))
    for k in [*range(2, length - 1, 2)] + [length - 2] * (length % 2):
        if not len(live):
            break
        p, q = _pairs(a.text, x[live] + k), _pairs(b.text, y[live] + k)
        out[live] = (p > q).astype(np.int8) - (p < q).astype(np.int8)
        live = live[p == q]
    return out


def places(a: Level, b: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of a: before which run of b it belongs, and whether that one is equal."""
    lo, hi = np.searchsorted(b.head, a.head, "left"), np.searchsorted(b.head, a.head, "right")
    equal = np.zeros(len(lo), bool)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        order = _compare(a, live, b, mid, length)
        same = order == 0
        equal[live[same]] = True
        lo[live] = np.where(same, mid, np.where(order > 0, mid + 1, lo[live]))
        hi[live] = np.where(order > 0, hi[live], mid)
        live = live[~same & (lo[live] < hi[live])]
    return lo, equal


def scan(a: Level, b: Level, length: int) -> None:
    """Lets equal runs of two levels know of each other's documents."""
    at, equal = places(a, b, length)
    i, j = np.flatnonzero(equal), at[equal]
    a.low[i] = b.low[j] = np.minimum(a.low[i], b.low[j])
    a.high[i] = b.high[j] = np.maximum(a.high[i], b.high[j])


def merge(a: Level, b: Level, length: int) -> Level:
    at, equal = places(a, b, length)
    own = np.flatnonzero(~equal)
    # b's run j at 2j + 1, a's new runs just before the run they precede
    order = np.argsort(np.concatenate([2 * np.arange(len(b.at)) + 1, 2 * at[own]]), kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    to = np.empty(len(a.at), np.int64)
    to[own] = new[len(b.at) :]
    to[equal] = new[at[equal]]
    both = lambda x, y: np.concatenate([x, y[own]])[order]
    return Level(
        np.concatenate([b.text, a.text]), both(b.at, a.at + len(b.text)), both(b.head, a.head), both(b.low, a.low), both(b.high, a.high),
        np.concatenate([new[b.run], to[a.run]]), np.concatenate([b.owner, a.owner]), np.concatenate([b.inner, a.inner]), max(a.rank, b.rank) + 1,
    )


def level_of(snippets: list[tuple[int, int, int, np.ndarray]], length: int) -> Level:
    """Of (snippet's number, smallest and largest document, words)."""
    text = np.concatenate([s[3] for s in snippets])
    size = np.array([len(s[3]) for s in snippets])
    windows = size - length + 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner, low, high = (np.repeat(np.array([s[k] for s in snippets], np.int64), windows) for k in range(3))
    return Level.of(text, inner + np.repeat(np.cumsum(size) - size, windows), low, high, owner, inner, length)


class Family:
    """Levels of geometrically growing size."""

    def __init__(self, length: int = LENGTH, levels: list[Level] | None = None) -> None:
        self.length, self.levels = length, levels or []

    def add(self, new: Level) -> None:
        """Scans a batch's level against the others, which then merge as the digits of a counter carry."""
        for level in self.levels:
            scan(new, level, self.length)
        while self.levels and self.levels[-1].rank == new.rank:
            new = merge(new, self.levels.pop(), self.length)
        self.levels.append(new)


def repeats(x: Level) -> tuple[np.ndarray, ...]:
    """(snippet, first and last window, smallest and largest document) of stretches of windows that the same two documents
    have at least."""
    many = np.flatnonzero((x.low != x.high)[x.run])
    order = many[np.lexsort((x.inner[many], x.owner[many]))]
    owner, inner, low, high = x.owner[order], x.inner[order], x.low[x.run[order]], x.high[x.run[order]]
    if not len(order):
        return owner, inner, inner, low, high
    same = (owner[1:] == owner[:-1]) & (inner[1:] == inner[:-1] + 1) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    end = np.concatenate([begin[1:], [len(order)]]) - 1
    return owner[begin], inner[begin], inner[end], low[begin], high[begin]


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = c(text_col).cast("string")
    return docs.select(c(id_col).cast("long").alias("d"), text.alias("t"), F.xxhash64(text).alias("x")).where("d is not null and t is not null")


_SNIPPET = "route long, d long, x long, first long, words binary"


def _snippets(t: Tokens, ids: np.ndarray, hashes: np.ndarray, key: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray, length: int) -> pa.RecordBatch:
    """One row an anchor, or for hot ones one a window, by the hash of the whole window."""
    if hot.any():
        n = np.where(hot, last - first + 1, 1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, text, first, last, hot = (np.repeat(x, n) for x in (key, text, first, last, hot))
        first = first + inner
        last = np.where(hot, first, last)
        if hot.any():
            whole = np.zeros(int(hot.sum()), np.uint64)
            for k in range(length):
                whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + t.hashes[first[hot] + k])
            key = key.copy()
            key[hot] = whole.view(np.int64)
    w = (t.hashes >> np.uint64(32)).astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[text]), pa.array(hashes[text]), pa.array(first - t.first[text]), pa.array([w[x : y + length].tobytes() for x, y in zip(first, last)], pa.binary())], ["route", "d", "x", "first", "words"])


def _numbered(cuttings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(route, s1, s2, d, x, first) of all occurrences, and (route, s1, s2, words, low, high) of distinct snippets, told apart by
    their words; s1 and s2 are 96 bits of them, on top of the route's 64."""
    held = cut(cuttings)
    named = held.withColumns({"s1": F.xxhash64("words"), "s2": F.hash("words")})
    distinct = held.groupBy("route", "words").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return named.select("route", "s1", "s2", "d", "x", "first"), distinct.select("route", F.xxhash64("words").alias("s1"), F.hash("words").alias("s2"), "words", "low", "high")


def _placed(occurrences: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(d, x, s, e, low, high) of the occurrences of found stretches (route, s1, s2, a, b, low, high)."""
    return occurrences.join(found, ["route", "s1", "s2"]).select("d", "x", (F.col("first") + F.col("a")).alias("s"), (F.col("first") + F.col("b") + length).alias("e"), "low", "high")


def _united(spans: DataFrame, *by_: str) -> DataFrame:
    """Spans (by, s, e, o) that overlap or touch as one each: (by, start_word, end_word, other_doc)."""
    by = Window.partitionBy(*by_).orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("isle", isle)
        .groupBy(*by_, "isle")
        .agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("o").alias("other_doc"))
        .drop("isle")
    )


def _other() -> Column:
    return F.when(F.col("d") != F.col("low"), F.col("low")).otherwise(F.col("high"))


def shared_windows(docs: DataFrame, length: int, gram: int, batch_words: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    """(d, x, s, e, low, high): stretches of windows that several documents have, and the smallest and largest of these; x is
    a hash of the row's text."""
    own = _own(docs, id_col, text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for begin, end, texts in chunks(b.column(1)):
                key, text, _, _ = anchors(tokens(texts), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[begin:end][text])], ["key", "d"])

    seen = cut(own.mapInArrow(keys, "key long, d long"))
    repeated = seen.groupBy("key").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).where("a < b").select("key", (F.col("n") > hot).alias("hot"))
    wanted = seen.join(repeated, "key").groupBy("d").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for begin, end, texts in chunks(b.column(1)):
                t = tokens(texts)
                key, text, first, last = anchors(t, length, gram)

                def among(k: int, key: np.ndarray, text: np.ndarray) -> np.ndarray:
                    # an anchor belongs to its text's wanted keys: one lookup for the whole chunk, by text and key together
                    parts = b.column(k).slice(begin, end - begin)  # noqa: B023
                    flat = np.ascontiguousarray(parts.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
                    owner = np.repeat(np.arange(end - begin), np.diff(parts.offsets.to_numpy()))  # noqa: B023
                    salt = lambda which, k: k.view(np.uint64) ^ (which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    return np.isin(salt(text, key), salt(owner, flat))

                keep = among(2, key, text)
                key, text, first, last = key[keep], text[keep], first[keep], last[keep]
                yield _snippets(t, ids[begin:end], b.column(4).to_numpy(zero_copy_only=False)[begin:end], key, text, first, last, among(3, key, text), length)

    def family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size, names = Family(length), [], 0, []
        for b in batches:
            for *name, words, low, high in zip(*(b.column(k).to_pylist() for k in range(6))):
                held.append((len(names), low, high, np.frombuffer(words, np.uint32)))
                names.append(name)
                size += len(words) // 4
                if size >= batch_words:
                    index.add(level_of(held, length))
                    held, size = [], 0
        if held:
            index.add(level_of(held, length))
        named = [np.array([n[k] for n in names], np.int64) for k in range(3)]
        for level in index.levels:
            owner, *found = repeats(level)
            yield pa.RecordBatch.from_arrays([pa.array(n[owner]) for n in named] + [pa.array(x) for x in found], ["route", "s1", "s2", "a", "b", "low", "high"])

    cuttings = own.join(wanted, "d").select("d", "t", "keys", "hot", "x").mapInArrow(snippets, _SNIPPET)
    occurrences, distinct = _numbered(cuttings)
    parts = shuffle_partitions(docs.sparkSession) * 2
    found = distinct.repartition(parts, "route").mapInArrow(family, "route long, s1 long, s2 long, a long, b long, low long, high long").withColumn("s2", F.col("s2").cast("int"))
    return _placed(occurrences, found, length)


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_words: int = BATCH_WORDS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, other_doc) of every passage shared with another document, one row a span."""
    spans = shared_windows(docs, length, gram, batch_words, hot, id_col, text_col)
    return _united(spans.select("d", "s", "e", _other().alias("o")), "d").withColumnRenamed("d", id_col)


def drop_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that a document of a smaller id has too: each passage stays in one document."""
    spans = shared_windows(docs, length, gram, BATCH_WORDS, HOT, id_col, text_col).where("d <> low").select("d", "x", "s", "e", F.col("low").alias("o"))
    key, key2, cuts = fresh(docs, "key_"), fresh(docs, "key2_"), fresh(docs, "cuts_")
    # of rows that share an id each has its own spans
    own = _united(spans, "d", "x").groupBy(F.col("d").alias(key), F.col("x").alias(key2)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hit, new = b.column(at), np.zeros(b.num_rows, bool), []
            for k, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                text = texts[k].as_py() if spans else None
                place = [m.span() for m in WORD.finditer(lowered(text))] if text else []
                found = [(place[x["start_word"]][0], place[x["end_word"] - 1][1]) for x in spans or []]
                if found:
                    ends = [0, *(e for _, e in found)]
                    hit[k] = True
                    new.append("".join(text[e:s] for e, s in zip(ends, [*(s for s, _ in found), len(text)])))
            out = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([out if j == at else b.column(j) for j in range(b.num_columns - 1)], b.schema.names[:-1])

    met = docs.join(own, (c(id_col) == c(key)) & (F.xxhash64(c(text_col)) == c(key2)), "left")
    return met.select(*[c(x) for x in docs.columns], c(cuts)).mapInArrow(run, docs.schema)


class StoredFamily:
    """Levels in a shared folder, split into ``buckets`` by anchor; a bucket's part of a level is to fit a task, so a family
    that grows much larger wants more of them from the start. An anchor's snippets lie in one bucket.

    A batch must hold new documents. A batch that fails leaves the family as it was: what it wrote isn't named."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, buckets: int = 64) -> None:
        self.spark, self.path, self.length, self.gram, self.buckets = spark, qualified(spark, path), length, gram, buckets

    def levels(self) -> list[tuple[int, str]]:
        """(rank, folder) of each level, the largest first."""
        names = f"{self.path}/names"
        if not exists(self.spark, names):
            return []
        newest = self.spark.read.parquet(names).orderBy(F.desc("batch")).first()
        return [tuple(x) for x in json.loads(newest["levels"])]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, start_word, end_word, other_doc) of the batch's passages that stand in the family or elsewhere in the batch,
        which from now on belongs to the family."""
        length, gram, was = self.length, self.gram, self.levels()
        # as in a binary counter: a batch is of rank 0, and two levels of one rank make one of the next
        merges = next((k for k, (rank, _) in enumerate(reversed(was)) if rank != k), len(was))

        def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for begin, end, texts in chunks(b.column(1)):
                    t = tokens(texts)
                    key, text, first, last = anchors(t, length, gram)
                    yield _snippets(t, ids[begin:end], b.column(2).to_numpy(zero_copy_only=False)[begin:end], key, text, first, last, np.zeros(len(key), bool), length)

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, held, names = None, [], []
            for b in batches:
                for k, *name, words, low, high in zip(*(b.column(j).to_pylist() for j in range(7))):
                    if k != bucket and held:
                        yield row(bucket, held, names)
                        held, names = [], []
                    bucket = k
                    held.append((len(names), low, high, np.frombuffer(words, np.uint32)))
                    names.append(name)
            if held:
                yield row(bucket, held, names)

        def row(bucket: int, held: list, names: list) -> pa.RecordBatch:
            blob = pickle.dumps((level_of(held, length), [np.array([n[j] for n in names], np.int64) for j in range(3)]))
            return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([blob], pa.binary())], ["bucket", "new"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A bucket's level after the carry, and what it found, as one row."""
            for b in batches:
                for bucket, new, *old in zip(*(b.column(j).to_pylist() for j in range(b.num_columns))):
                    known = [pickle.loads(x) if x is not None else None for x in old]
                    found, level = [np.zeros(0, np.int64)] * 7, None
                    if new is not None:
                        level, named = pickle.loads(new)
                        for x in known:
                            if x is not None:
                                scan(level, x, length)
                        owner, *rest = repeats(level)
                        found = [n[owner] for n in named] + rest
                        level = replace(level, run=level.run[:0], owner=level.owner[:0], inner=level.inner[:0])
                    for x in list(reversed(known))[:merges]:
                        level = x if level is None else level if x is None else merge(level, x, length)
                    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([None if level is None else pickle.dumps(level)], pa.binary()), *lists], ["bucket", "level", *fields])

        fields = ["route", "s1", "s2", "a", "b", "low", "high"]
        occurrences, distinct = _numbered(_own(docs, id_col, text_col).mapInArrow(snippets, _SNIPPET))
        bucket = F.pmod("route", F.lit(self.buckets)).alias("bucket")
        rows = distinct.select(bucket, "route", "s1", "s2", "words", "low", "high").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(built, "bucket long, new binary")
        for k, (_, name) in enumerate(was):
            stored = self.spark.read.parquet(f"{self.path}/{name}").select("bucket", F.col("level").alias(f"l{k}"))
            rows = rows.join(stored, "bucket", "full_outer")
        done = cut(rows.select("bucket", "new", *[f"l{k}" for k in range(len(was))]).mapInArrow(added, "bucket long, level binary, " + ", ".join(f"{f} array<long>" for f in fields)))
        name = f"level-{merges}-{uuid.uuid4()}"
        done.where("level is not null").select("bucket", "level").write.parquet(f"{self.path}/{name}")
        now = [*was[: len(was) - merges], (merges, name)]
        count = self.spark.read.parquet(f"{self.path}/names").agg(F.max("batch")).first()[0] + 1 if was else 0
        self.spark.createDataFrame([(count, json.dumps(now))], "batch long, levels string").coalesce(1).write.mode("append").parquet(f"{self.path}/names")
        found = done.select(F.explode(F.arrays_zip(*fields)).alias("x")).select("x.*").withColumn("s2", F.col("s2").cast("int"))
        return _united(_placed(occurrences, found, length).select("d", "s", "e", _other().alias("o")), "d").withColumnRenamed("d", id_col)


#: The same by comparing all windows as text.
SQL = f"""
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from documents),
g as (select doc_id, i - 1 as a, md5(array_to_string(w[i:i+{LENGTH - 1}], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) as i from dw where len(w) >= {LENGTH})),
r as (select k, min(doc_id) as lo, max(doc_id) as hi from g group by k having min(doc_id) < max(doc_id)),
o as (select doc_id, a, case when doc_id <> lo then lo else hi end as other from g join r using (k)),
p as (select *, max(a) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) as prev from o),
s as (select *, sum(case when prev is null or a > prev + {LENGTH} then 1 else 0 end) over (partition by doc_id order by a rows unbounded preceding) as isle from p)
select doc_id, min(a)::bigint as start_word, max(a)::bigint + {LENGTH} as end_word, min(other) as other_doc from s group by doc_id, isle
"""
