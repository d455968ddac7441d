"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

A shard is what a task has read, in parts of a bounded size, however large Spark's batches are. Its index is of all its
words, whatever is going to be asked: the words become symbols, a separator stands behind each text, and over that stand
a suffix array (prefix doubling, which sorts again only what is still undecided), its Burrows-Wheeler transform in a
wavelet matrix with block ranks, and suffix positions sampled at every text's start and every 8th word. The suffix array
itself goes.

The test phrases are all runs of ``n`` words of the benchmark items (the whole item where it has fewer). All phrases are
searched at once, symbol by symbol from their end; occurrences are located by walking back to a sample, and overlapping
or touching ones merge into the spans to remove. ``shard_indexes`` stores the indexes, for any number of benchmarks.

A benchmark of more than ``PASS_WORDS`` words doesn't go to the tasks at once: the indexes are then stored, every part of
the benchmark searches them, and the spans of all parts merge before anything is cut. The result is that of one pass.

Defined results
- null or empty text: no span, kept by the stage. Null id: analysed like others, its spans have a null id.
- very long texts: whole; a text is never split, so a shard is as large as its longest text at least.
- repeated rows: each row has its own spans. Ties: all items that have a phrase are named, in order.
- benchmark items with a null id or text, or no words (or fewer than ``least``, for callers that want that): no phrase. An
  item of fewer than ``n`` words is cut wherever it stands as a whole. No items: no span.
- empty documents: empty result. Extra columns: ignored, kept by the stage.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fathom.llm.common import WORD, c, chunks, cut, fresh, lowered, tokens

N, LEAST, SAMPLE = 8, 1, 8
SHARD_BYTES = 8 << 20
#: Test words that one pass takes to the tasks (about 100 MB); a larger benchmark takes several passes.
PASS_WORDS = 1_000_000
Found = list[tuple[int, int, list[int]]]


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a running count per word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)


class Wavelet:
    """A wavelet matrix: rank and access over a sequence of symbols, for whole arrays of questions."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.shifts = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for b in self.shifts:
            one = ((s >> b) & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])
        self.start = self.down(np.arange(sigma), np.zeros(sigma, np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before i."""
        return self.down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before i."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(i), level.rank(i)
            symbol = symbol * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order; zeros are separators, each different from all others (the earlier is the smaller) and smaller than
    any word. The last symbol is one."""
    n = len(s)
    zero = s == 0  # places and symbols are 32-bit numbers, keys alone are longer
    seps = int(zero.sum())
    bits, sep_bits = int(s.max()).bit_length() or 1, seps.bit_length()
    # at first as many symbols as a number holds; behind a separator the key has its number
    deep = max(1, (62 - sep_bits) // bits)
    key, open_, ordinal = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int32)
    number = np.cumsum(zero, dtype=np.int32)
    for j in range(deep):
        m = max(0, n - j)  # suffixes that have a symbol j; all others have met their separator
        key <<= bits
        key[:m] |= np.where(open_[:m], s[n - m :], 0)
        ends = np.flatnonzero(open_[:m] & zero[n - m :])
        ordinal[ends] = number[ends + j]
        open_[ends] = False
    key <<= sep_bits
    key |= ordinal
    del open_, ordinal, number
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del key, ordered
    order, rank = order.astype(np.int32), np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    while True:
        undecided = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(undecided):
            return order
        own = order[undecided]  # has no separator within its first ``deep`` symbols
        key = rank[own].astype(np.int64)
        key <<= 31
        key |= rank[own + deep]
        by = np.argsort(key)
        order[undecided], ordered = own[by], key[by]
        new[undecided] = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        del key, by, ordered
        rank[order[undecided]] = np.maximum.accumulate(np.where(new[undecided], undecided, 0))
        deep *= 2


class FMIndex:
    """Over words as symbols from 1; zeros separate runs, and the last symbol is one."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        sa = suffix_array(s)
        self.n = len(s)
        self.wavelet = Wavelet(s[sa - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])[:sigma]
        at = np.arange(self.n, dtype=np.int32)
        starts = np.concatenate([[True], s[:-1] == 0])
        offset = at - np.maximum.accumulate(np.where(starts, at, np.int32(0)))
        sampled = (offset % sample == 0)[sa]
        self.marks, self.samples = Bits(sampled), sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the interval of suffixes that begin with it."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            base = self.smaller[symbol]
            lo[live], hi[live] = base + self.wavelet.rank(symbol, lo[live]), base + self.wavelet.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, rows = np.zeros(len(rows), np.int64), rows.copy()
        live, steps = np.arange(len(rows)), 0
        while len(live):
            done = self.marks.get(rows[live]) == 1
            at = live[done]
            out[at] = self.samples[self.marks.rank(rows[at])] + steps
            live = live[~done]
            symbol, rank = self.wavelet.access(rows[live])
            rows[live] = self.smaller[symbol] + rank
            steps += 1
        return out


class Phrases:
    """Test phrases by length, as rows of word hashes, and of each the items that hold it. Arrays throughout, about 100 bytes
    a test word, as they go to every task."""

    def __init__(self, items: list[tuple[int, str]], n: int = N, least: int = LEAST) -> None:
        t = tokens([text for _, text in items])
        size = np.diff(t.first)
        rows: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, (item, _) in enumerate(items):
            if size[k] >= max(1, least):
                w = sliding_window_view(t.hashes[t.first[k] : t.first[k + 1]], min(n, int(size[k])))
                rows[w.shape[1]].append(np.concatenate([w, np.full((len(w), 1), item, np.int64).view(np.uint64)], axis=1))
        #: (phrases, where each one's items begin, items)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for m in sorted(rows):
            own = np.concatenate(rows[m])
            own = own[np.lexsort(own.T[::-1])]
            own = own[np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])]
            new = np.concatenate([[True], (own[1:, :m] != own[:-1, :m]).any(axis=1)])
            self.groups.append((own[new, :m], np.concatenate([np.flatnonzero(new), [len(own)]]), own[:, m].view(np.int64)))


class ShardIndex:
    """The FM-index of all words of some texts, by their hashes."""

    def __init__(self, texts: pa.Array) -> None:
        parts, sizes = [], []
        for _, _, chunk in chunks(texts):
            t = tokens(chunk)
            parts.append(t.hashes)
            sizes.append(np.diff(t.first))
        #: of each text where it ends, its separator included
        self.ends = np.cumsum(np.concatenate(sizes) + 1) if sizes else np.zeros(0, np.int64)
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.words, self.fm = np.zeros(0, np.uint64), None
        if len(hashes):
            del parts
            order = np.argsort(hashes)
            hashes = hashes[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            self.words = hashes[new]
            symbols = np.empty(len(hashes), np.int32)
            symbols[order] = np.cumsum(new, dtype=np.int32)
            del hashes, order
            s = np.zeros(self.ends[-1], np.int32)
            is_word = np.ones(len(s), bool)
            is_word[self.ends - 1] = False
            s[is_word] = symbols
            del symbols
            self.fm = FMIndex(s, len(self.words) + 1)

    def occurrences(self, asked: Phrases) -> list[Found]:
        """For each text the (first word, end word, items) of every occurrence of a phrase."""
        out: list[Found] = [[] for _ in range(len(self.ends))]
        if self.fm is None:
            return out
        begins = np.concatenate([[0], self.ends])
        for phrases, begin, items in asked.groups:
            k = np.minimum(np.searchsorted(self.words, phrases), len(self.words) - 1)
            known = np.flatnonzero((self.words[k] == phrases).all(axis=1))  # a word the shard hasn't got can't be found
            lo, hi = self.fm.search(k[known] + 1)
            which = np.repeat(known, hi - lo)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            at = self.fm.locate(rows)
            text = np.searchsorted(self.ends, at, side="right")
            for d, p, w in zip(text.tolist(), (at - begins[text]).tolist(), which.tolist()):
                out[d].append((p, p + phrases.shape[1], items[begin[w] : begin[w + 1]].tolist()))
        return out


def merged(found: Found) -> Found:
    """Overlapping and touching occurrences as spans."""
    spans: list[list] = []
    for a, b, items in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
            spans[-1][2].update(items)
        else:
            spans.append([a, b, set(items)])
    return [(a, b, sorted(s)) for a, b, s in spans]


def passes(benchmark: DataFrame, n: int, least: int, item_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[Phrases]]:
    """How many passes the benchmark takes, and the phrases of each, as many at a time as a task can hold."""
    own = benchmark.select(c(item_col).cast("long").alias("i"), c(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    size = own.agg(F.sum(F.size(F.split("t", "\\s+")))).first()[0] or 0
    count = max(1, math.ceil(size / PASS_WORDS))

    def each() -> Iterator[Phrases]:
        for k in range(count):
            part = own if count == 1 else own.where(F.pmod(F.xxhash64("i"), F.lit(count)) == k)
            yield Phrases([(r["i"], r["t"]) for r in part.collect()], n, least)

    return count, each()


def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SHARD_BYTES, or of one longer row."""
    if batch.nbytes <= SHARD_BYTES or batch.num_rows < 2:
        yield batch
    else:
        yield from halved(batch.slice(0, batch.num_rows // 2))
        yield from halved(batch.slice(batch.num_rows // 2))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows, in tables of at most SHARD_BYTES or of one longer row. A batch, which Spark bounds by 10,000 rows at first,
    may be far larger."""
    held, size = [], 0
    for b in batches:
        for part in halved(b):
            if held and size + part.nbytes > SHARD_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
        if size and b.nbytes > SHARD_BYTES:  # its last part would keep all of it in memory
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def indexed(docs: DataFrame, text_col: str, shard: str, number: str, index: str) -> DataFrame:
    """docs with three more columns: the row's shard, its number within, and on a shard's first row the shard's index."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(shard, LongType()), StructField(number, LongType()), StructField(index, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, own in enumerate(shards(batches)):
            if not own.num_rows:
                continue
            blob = pickle.dumps(ShardIndex(own.column(at).combine_chunks()))
            own = own.append_column(shard, pa.array([first + k] * own.num_rows, pa.int64())).append_column(number, pa.array(range(own.num_rows), pa.int64()))
            yield from own.append_column(index, pa.array([blob] + [None] * (own.num_rows - 1), pa.binary())).to_batches()

    return docs.mapInArrow(run, schema)


def shard_indexes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, ids, index): one row a shard, to be stored and searched for any benchmark without the texts."""
    own = docs.select(c(id_col).cast("long").alias("d"), c(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, shard in enumerate(shards(batches)):
            if shard.num_rows:
                blob = pickle.dumps(ShardIndex(shard.column(1).combine_chunks()))
                yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([shard.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["shard", "ids", "index"])

    return own.mapInArrow(run, "shard long, ids array<long>, index binary")


def search_indexes(indexes: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """(shard, number, id, start_word, end_word, items) of all occurrences in stored indexes, spans not merged over passes:
    a row's spans of different passes may overlap."""
    out = None
    for phrases in passes(benchmark, n, least)[1]:

        def run(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, ids, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                    found = [(shard, k, None if ids is None else ids[k], x, y, items) for k, spans in enumerate(pickle.loads(blob).occurrences(phrases)) for x, y, items in merged(spans)]
                    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["shard", "number", "id", "start_word", "end_word", "items"])

        own = cut(indexes.mapInArrow(run, "shard long, number long, id long, start_word long, end_word long, items array<long>"))
        out = own if out is None else out.unionByName(own)
    return out


def searched(docs: DataFrame, text_col: str, benchmark: DataFrame, n: int, least: int, schema: StructType | str, finish: Callable[[pa.Table, list[Found]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What finish makes of rows and their merged spans."""
    at = docs.columns.index(text_col)
    count, each = passes(benchmark, n, least)
    if count == 1:
        phrases = next(each)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in shards(batches):
                yield from finish(own, [merged(x) for x in ShardIndex(own.column(at).combine_chunks()).occurrences(phrases)])

        return docs.mapInArrow(run, schema)
    shard, number, index, spans = (fresh(docs, x) for x in ("shard_", "number_", "index_", "spans_"))
    held = cut(indexed(docs, text_col, shard, number, index))
    stored = held.where(c(index).isNotNull()).select(c(shard).alias("shard"), F.lit(None).cast("array<long>").alias("ids"), c(index).alias("index"))
    found = search_indexes(stored, benchmark, n, least).groupBy(F.col("shard").alias(shard), F.col("number").alias(number))
    found = found.agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"), "items")).alias(spans))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b.column(b.num_columns - 1).to_pylist()
            own = pa.Table.from_batches([b]).remove_column(b.num_columns - 1)
            yield from finish(own, [merged([(x["a"], x["b"], x["items"]) for x in row or []]) for row in was])

    return held.join(found, [shard, number], "left").select(*[c(x) for x in docs.columns], c(spans)).mapInArrow(last, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, start_char, end_char, items): what to remove, one row a span."""
    own = docs.select(c(id_col).cast("long").alias("d"), c(text_col).cast("string").alias("t"))
    schema = f"`{id_col}` long, start_word long, end_word long, start_char long, end_char long, items array<long>"

    def finish(shard: pa.Table, spans: list[Found]) -> Iterator[pa.RecordBatch]:
        ids, texts, rows = shard.column(0), shard.column(1), []
        for k, found in enumerate(spans):
            if found:
                place = [m.span() for m in WORD.finditer(lowered(texts[k].as_py()))]
                rows += [(ids[k].as_py(), a, b, place[a][0], place[b - 1][1], items) for a, b, items in found]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], [id_col, "start_word", "end_word", "start_char", "end_char", "items"])

    return searched(own, "t", benchmark, n, least, schema, finish)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """docs with the spans cut from their texts and one more column, contaminated: whether any was."""
    at, flag = docs.columns.index(text_col), fresh(docs, "contaminated")

    def finish(shard: pa.Table, spans: list[Found]) -> Iterator[pa.RecordBatch]:
        texts = shard.column(at).combine_chunks()
        hit, cleaned = np.zeros(len(texts), bool), []
        for k, found in enumerate(spans):
            if found:
                text = texts[k].as_py()
                place = [m.span() for m in WORD.finditer(lowered(text))]
                hit[k] = True
                cleaned.append(remove_spans(text, [(place[a][0], place[b - 1][1]) for a, b, _ in found]))
        new = pc.replace_with_mask(texts, pa.array(hit), pa.array(cleaned, texts.type))
        yield from shard.set_column(at, shard.schema.field(at), new).append_column(flag, pa.array(hit)).to_batches()

    return searched(docs, text_col, benchmark, n, least, docs.withColumn(flag, F.lit(False)).schema, finish)


#: The merged spans by plain n-gram joins, for items of at least N words (all that the given benchmark has); places of
#: characters from the lengths of a text's words and of what lies between.
SQL = f"""
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from documents),
bw as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from benchmark),
bg as (select item_id, array_to_string(w[i:i+{N - 1}], ' ') as g from (select item_id, w, unnest(range(1, len(w) - {N - 2})) as i from bw where len(w) >= {N})),
bi as (select distinct item_id, g from bg),
o as (
  select doc_id, i - 1 as a, item_id from (select doc_id, i, array_to_string(w[i:i+{N - 1}], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - {N - 2})) as i from dw where len(w) >= {N})) join bi using (g)
), p as (select doc_id, a, item_id, max(a) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) as prev from o),
s as (select *, sum(case when prev is null or a > prev + {N} then 1 else 0 end) over (partition by doc_id order by a rows unbounded preceding) as isle from p),
f as (
  select doc_id, min(a)::bigint as start_word, max(a)::bigint + {N} as end_word, array_to_string(list_sort(list(distinct item_id)), ',') as items, count(distinct item_id)::bigint as n_items
  from s group by doc_id, isle
),
pc as (
  select doc_id, unnest(x) as piece, generate_subscripts(x, 1) as i
  from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') as x from documents where doc_id in (select doc_id from f))
),
pl as (
  select doc_id, b - length(piece) as a, b, row_number() over (partition by doc_id order by a) - 1 as word
  from (select doc_id, piece, sum(length(piece)) over (partition by doc_id order by i) as b, sum(length(piece)) over (partition by doc_id order by i) - length(piece) as a from pc)
  where regexp_matches(piece, '^[\\p{{L}}\\p{{N}}_]')
)
select f.doc_id, start_word, end_word, x.a::bigint as start_char, y.b::bigint as end_char, items, n_items
from f join pl x on x.doc_id = f.doc_id and x.word = start_word join pl y on y.doc_id = f.doc_id and y.word = end_word - 1
"""
