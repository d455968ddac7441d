"""Text analysis: column expressions that stay within the JVM, and documents turned over for an index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# letters and digits only: the underscore, which \w has, separates
_TOKEN = re.compile(r"[^\W_]+")
#: Longer tokens, in bytes, are dropped.
TOKEN_BYTES = 40
#: Positions of the elements of a multi-valued field lie this far apart, so that no phrase spans two of them.
ELEMENT_GAP = 1_000_000


def tokens(text: Column) -> Column:
    """The tokens of a text in order: runs of letters and digits, the overlong ones dropped, in lower case."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.octet_length(x) < TOKEN_BYTES), F.lower)


def tokenize(text: str) -> list[str]:
    """The same outside the JVM, token for token."""
    return [t.lower() for t in _TOKEN.findall(text) if len(t) * 4 < TOKEN_BYTES or len(t.encode("utf-8", "surrogatepass")) < TOKEN_BYTES]


#: Bytes of text that are turned over at once, if they aren't of one document.
BATCH_BYTES = 4_000_000


def inverted(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, field, dl, terms, tfs, positions) of strings and arrays of strings: one row for each document's field that has
    tokens, its distinct terms side by side with how often and where they stand; dl is the number of tokens.

    A document is turned over in one go where it is read: its tokens never become rows, let alone rows to shuffle. Only
    tables of fewer files than there are cores are spread over them first."""
    own = df.select(F.col(key).alias(key), *[c.alias(f"f{i}") for i, c in enumerate(columns.values())])
    spark = df.sparkSession
    if not df.isStreaming and len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
        own = own.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for i, f in enumerate(columns):
        kind = own.schema[f"f{i}"].dataType.simpleString()
        if kind not in ("string", "array<string>"):
            raise TypeError(f"{f}: full text needs a string or an array of strings, not {kind}")
    fields = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(fields):
                for part in _slices(b.column(1 + i)):
                    yield _inverted(b.column(0).slice(part.start, part.stop - part.start), f, b.column(1 + i).slice(part.start, part.stop - part.start), key)

    kind = own.schema[key].dataType.simpleString()
    return own.mapInArrow(run, f"`{key}` {kind}, field string, dl bigint, terms array<string>, tfs array<bigint>, positions array<array<bigint>>")


def _slices(column: pa.Array) -> Iterator[slice]:
    """Rows of about BATCH_BYTES of text."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        elements, of = column.flatten(), pc.list_parent_indices(column).to_numpy()
        size = np.bincount(of, weights=pc.fill_null(pc.binary_length(elements), 0).to_numpy(), minlength=len(column))
    else:
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    part = np.cumsum(size) // BATCH_BYTES
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(column)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _inverted(keys: pa.Array, field: str, column: pa.Array, key: str) -> pa.RecordBatch:
    """The inverted rows of a field, a row for each document that has tokens; all tokens are handled side by side, and words
    become lower case once for each slice."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        texts, row_of = column.flatten(), pc.list_parent_indices(column).to_numpy()
        place = np.arange(len(row_of)) - np.searchsorted(row_of, row_of)
    else:
        texts, row_of, place = column, np.arange(len(column)), np.zeros(len(column), np.int64)
    # the same tokens as _TOKEN's: RE2 and Python agree on which characters are letters and digits
    spaced = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    split = pc.split_pattern(spaced, " ")
    found = split.flatten()
    size = pc.binary_length(found).to_numpy()
    kept = (size > 0) & (size < TOKEN_BYTES)
    element = pc.list_parent_indices(split).to_numpy()[kept]
    coded = found.filter(pa.array(kept)).dictionary_encode()
    lower = pa.array([w.lower() for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code = lower.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
    row = row_of[element].astype(np.int64)
    at = np.arange(len(element)) - np.searchsorted(element, element) + place[element] * ELEMENT_GAP

    pair = row * max(len(lower.dictionary), 1) + code
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    rows, lengths = np.unique(row, return_counts=True)
    ends = pa.array(np.r_[np.searchsorted(row[order[first]], rows), len(first)], pa.int32())
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pair)], pa.int32()), pa.array(at[order], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(rows)), pa.array([field], pa.string()).take(pa.array(np.zeros(len(rows), np.int64))), pa.array(lengths, pa.int64()),
            pa.ListArray.from_arrays(ends, lower.dictionary.take(pa.array(code[order[first]]))), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.r_[first, len(pair)]), pa.int64())),
            pa.ListArray.from_arrays(ends, positions),
        ],
        [key, "field", "dl", "terms", "tfs", "positions"],
    )


def term_frequencies(df: DataFrame, text: Column) -> DataFrame:
    """(term, tf) over all rows of df."""
    return df.select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), in double precision."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


K1, B = 1.2, 0.75


def bm25(tf: Column, weight: Column, dl: Column, avg_dl: Column) -> Column:
    return weight * (K1 + 1.0) * tf / (tf + K1 * ((1.0 - B) + B * dl / avg_dl))
