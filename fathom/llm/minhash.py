"""MinHash near-dedup by circulant permutations, banding and exact Jaccard verification.

Every word n-gram of a document is hashed into a universe of 2**22 places and moved by a first permutation (sigma); one
second permutation (pi), read at K successive circular shifts, yields all K coordinates: the coordinate k is the
smallest pi[(sigma(x) + k) mod D] over the document's n-grams. Runs of ``rows`` coordinates make ``bands`` band keys;
documents sharing a key are candidates. What counts is the exact Jaccard similarity of their n-gram sets.

The result is the connected components of the verified pairs. A bucket of m documents needs no m*m verifications: first
each document is held against the smallest id it shares a bucket with, then the other bucket leaders, and at last, in
buckets that still hold several components, every pair of different components. A pair within one component can't
change the components, so this equals verifying all candidate pairs; nothing is capped.

Sets that are verified hold 32 bits of each n-gram's hash: of two sets of m n-grams about m * m / 2**32 unlike ones agree
by chance, which moves the similarity by 5 in a million for texts of 20,000 words.

Defined results
- null id, null or empty text, text without words: never in a group (and never dropped by the stage).
- very long texts: all their n-grams count. Fewer than n words: the whole text is the one n-gram.
- exact copies and repeated rows have similarity 1.
- rows that share an id: for the groups they are one node, similar to whatever any of them is similar to. The stage looks at
  each text by itself: of equal rows one stays (the least in order of all columns), texts unlike any other stay.
- ties: the smallest id of a group is its representative; of its texts, where it has several in the group, the one of the
  smallest hash. Empty table: empty result. Extra columns: ignored, kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import c, chunks, cut, fresh, mix64, ngram_hash, ngrams, tokens

N, BANDS, ROWS, THRESHOLD, SEED = 3, 50, 5, 0.55, 20240229
LOG_D = 22


def gram_arrays(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-grams; of the whole text where it has fewer words."""
    t = tokens(texts)
    h, text, _ = ngrams(t, n)
    both = np.sort(text.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.split(low, np.searchsorted(both >> np.uint64(32), np.arange(1, len(texts)))) if len(texts) else []
    for i in np.flatnonzero((np.diff(t.first) > 0) & (np.diff(t.first) < n)):
        out[i] = (ngram_hash(t.hashes[t.first[i] : t.first[i + 1]], n) >> np.uint64(32)).astype(np.uint32)
    return out


class Sketcher:
    """Signature and n-gram set of a text."""

    def __init__(self, n: int = N, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        self.n, self.bands, self.rows = n, bands, rows
        rng = np.random.Generator(np.random.PCG64(seed))
        d = 1 << LOG_D
        pi = np.arange(d, dtype=np.uint32)
        rng.shuffle(pi)
        self.shifts = sliding_window_view(np.concatenate([pi, pi[: bands * rows]]), bands * rows)
        self.factor, self.offset = np.uint64(int(rng.integers(d)) | 1), np.uint64(int(rng.integers(d)))  # sigma: x -> factor * x + offset mod D, a bijection

    def grams(self, texts: list[str | None]) -> list[np.ndarray]:
        return gram_arrays(texts, self.n)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        at = ((grams.astype(np.uint64) * self.factor + self.offset) & np.uint64((1 << LOG_D) - 1)).astype(np.int64)
        return reduce(np.minimum, (self.shifts[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)))

    def band_keys(self, signatures: list[np.ndarray]) -> np.ndarray:
        """One row of keys for each signature."""
        s = np.stack(signatures).reshape(-1, self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), s.shape[:2])
        for j in range(self.rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j] + np.uint64(1))
        return h.view(np.int64)


def _own(docs: DataFrame, node: Column, text_col: str) -> DataFrame:
    return docs.select(node.alias("d"), c(text_col).cast("string").alias("t")).where("d is not null and t is not null")


def band_keys(own: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(d, keys) for each row (d, t) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(n, bands, rows)
        for b in batches:
            ids = b.column(0)
            for begin, _, texts in chunks(b.column(1)):
                found = [(begin + i, s.signature(g)) for i, g in enumerate(s.grams(texts)) if len(g)]
                if found:
                    keys = s.band_keys([x for _, x in found])
                    ends = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in found])), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["d", "keys"])

    return own.mapInArrow(run, f"d {dict(own.dtypes)['d']}, keys array<long>")


def gram_sets(own: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(d, grams) of the rows (d, t) among ids: only candidates' sets are ever stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end, texts in chunks(b.column(1)):
                grams = gram_arrays(texts, n)
                ends = np.cumsum([0] + [len(g) for g in grams]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams).view(np.int32)))], ["d", "grams"])

    return own.join(ids, "d", "left_semi").mapInArrow(run, f"d {dict(own.dtypes)['d']}, grams array<int>")


def verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) whose n-gram sets have a Jaccard similarity of at least threshold."""
    left = pairs.join(grams.select(F.col("d").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(grams.select(F.col("d").alias("b"), F.col("grams").alias("gb")), "b")
    # sizes alone refuse many pairs before any set is intersected
    na, nb = F.size("ga"), F.size("gb")
    both = both.where(F.least(na, nb) >= threshold * F.greatest(na, nb))
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (shared / (na + nb - shared)).alias("j")).where(F.col("j") >= threshold).groupBy("a", "b").agg(F.max("j").alias("j"))


def components(edges: DataFrame) -> DataFrame:
    """(d, comp): the smallest id reachable from each end of the edges (a, b), by large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None

    def least(pairs: DataFrame) -> DataFrame:
        """With m, the smallest v beside each u. Each task sums up first, so a node of very many neighbours is no burden."""
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = least(both).withColumn("m", F.least("u", "m"))
        large = near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = least(large)
        small = down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    # at rest every edge leads from a member to its component's smallest id
    return e.select(F.col("u").alias("d"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("d"), F.col("v").alias("comp")).distinct())


def near_duplicate_groups(docs: DataFrame, n: int = N, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id, keep) of every document in a group of two or more; group_id is the smallest id, the one kept."""
    comp = groups(_own(docs, c(id_col).cast("long"), text_col), n, bands, rows, threshold)
    return comp.select(F.col("d").alias(id_col), F.col("comp").alias("group_id"), (F.col("d") == F.col("comp")).alias("keep"))


def groups(own: DataFrame, n: int, bands: int, rows: int, threshold: float) -> DataFrame:
    """(d, comp) of the rows (d, t): each node in a group and the group's smallest one."""
    members = cut(band_keys(own, n, bands, rows)).select("d", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("leader")).where("n > 1").select("key", "leader")
    m = cut(members.join(shared, "key"))
    sets = cut(gram_sets(own, m.select("d").distinct(), n))
    star = m.where("d <> leader")
    first = cut(verified(star.groupBy("d").agg(F.min("leader").alias("a")).select("a", F.col("d").alias("b")), sets, threshold))

    def differing(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends aren't in one component yet."""
        ca = comp.select(F.col("d").alias("a"), F.col("comp").alias("ca"))
        cb = comp.select(F.col("d").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    comp = components(first)
    least = star.groupBy("d").agg(F.min("leader").alias("least"))
    rest = star.select(F.col("leader").alias("a"), F.col("d").alias("b")).distinct()
    tried = least.select(F.col("least").alias("a"), F.col("d").alias("b"))
    pairs = cut(differing(rest, comp).join(tried, ["a", "b"], "left_anti"))
    edges = first
    if not pairs.isEmpty():
        edges = first.unionByName(cut(verified(pairs, sets, threshold)))
        comp = components(edges)
    # buckets of several components: each member outside the largest meets all members of other components
    sides = m.join(comp, "d", "left").select("key", "d", "leader", F.coalesce("comp", "d").alias("comp"))
    sizes = sides.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "comp")).alias("top")).where("k > 1").select("key", F.col("top.comp").alias("top"))
    sides = sides.join(mixed, "key")
    minor = sides.where("comp <> top").select("key", F.col("d").alias("x"), F.col("comp").alias("cx"))
    cross = cut(
        minor.join(sides.select("key", F.col("d").alias("y"), F.col("comp").alias("cy"), "leader"), "key")
        .where("cx <> cy and x <> leader and y <> leader")  # pairs with the leader have been tried
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    if not cross.isEmpty():
        comp = components(edges.unionByName(cut(verified(cross, sets, threshold))))
    return comp


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each group, and without all but one of equal rows."""
    text, words = c(text_col).cast("string"), c(text_col).cast("string").rlike("[\\p{L}\\p{N}_]")
    id_ = F.when(words, c(id_col).cast("long"))
    if docs.select(id_.alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        node, again = id_, None
    else:
        # an id that several rows have is as many nodes as texts: the id, and 32 bits of the text's hash behind it
        node = id_.cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.pmod(F.xxhash64(text), F.lit(1 << 32)).cast("decimal(10,0)")
        node = node.cast("decimal(38,0)")
        again = docs.select(node.alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    gone, key, own = fresh(docs, "gone_"), fresh(docs, "node_"), _own(docs, node, text_col)
    comp = groups(own, n, bands, rows, threshold)
    kept = docs.withColumn(key, node).join(comp.where("d <> comp").select(F.col("d").alias(gone)), c(key) == c(gone), "left_anti")
    if again is not None:
        twice = again.withColumnRenamed("d", gone)
        row = F.struct(*[c(x) for x in docs.columns])
        first = kept.join(twice, c(key) == c(gone), "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(gone)).select(f"{gone}.*")
        kept = kept.join(twice, c(key) == c(gone), "left_anti").drop(key).unionByName(first)
    return kept.select(*[c(x) for x in docs.columns])


#: What the groups would be if no pair were missed: all pairs that share an n-gram compared, and their links followed. Of
#: pairs just at the threshold one in thirteen shares no band (of those at 0.7, one in ten thousand), so the two may differ.
SQL = f"""
with recursive dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i+{N - 1}], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - {N - 2}, 2))) as i from dw where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as s from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where s::double / (x.n + y.n - s) >= {THRESHOLD}),
both_ as (select a, b from e union all select b, a from e),
reach as (select a, b from both_ union select r.a, x.b from reach r join both_ x on x.a = r.b)
select a as doc_id, min(b) as group_id, a = min(b) as keep from reach group by a
"""
