"""Shared helpers: scratch space, column hygiene, tokens and hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.shared import cut, delete, exists, qualified, scratch, table

__all__ = ["cut", "delete", "exists", "qualified", "scratch", "table"]

#: A word: a run of letters, digits and underscores, in lower case.
WORD = re.compile(r"\w+")
#: The same for the JVM's and DuckDB's expression engines.
WORD_SQL = r"[\p{L}\p{N}_]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def c(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lowered(text: str) -> str:
    """Lower case, letter for letter: the few letters whose lower case is longer stay, so that places agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ngram_hash(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words; of the whole when there are fewer; none for none."""
    if len(w) == 0:
        return np.empty(0, np.uint64)
    n = min(n, len(w))
    x, m = w.astype(np.uint64), len(w) - n + 1
    h = np.full(m, mix64(np.array([n], np.uint64))[0], np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * _P + x[j : j + m]
    return mix64(h)


class Tokens(NamedTuple):
    """The words of some texts, one after another."""

    hashes: np.ndarray  # 64-bit, one for each word
    first: np.ndarray  # of each text its first word; one more entry at the end
    start: np.ndarray  # of each word its first character within its text
    end: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to words, and a random number."""
    word = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return word, np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 0x110000, np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = 0x9E3779B97F4A7C15
    up, down = np.full(n, odd, np.uint64), np.full(n, pow(odd, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Scan:
    """Where the words of some texts are, and their hashes, without a Python object for each: a word's hash is the
    difference of two prefix sums of its letters' numbers times powers of an odd number, brought back to power 0 and mixed.
    Texts lie one after another, a line break behind each."""

    def __init__(self, texts: list[str | None]) -> None:
        low = [lowered(t) if t else "" for t in texts]
        self.codes = codes("\n".join(low))
        self.starts = np.cumsum([0] + [len(t) + 1 for t in low])
        letter, number = _letters()
        edge = np.diff(np.concatenate([[False], letter[self.codes], [False]]).view(np.int8))
        self.a, self.b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, self.down = _powers(1 << max(16, len(self.codes).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[self.codes] * up[: len(self.codes)])])
        self.first = np.searchsorted(self.a, self.starts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Of all words, or of their beginnings of at most so many letters."""
        b = self.b if longest is None else np.minimum(self.b, self.a + longest)
        return mix64((self.sums[b] - self.sums[self.a]) * self.down[self.a])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def tokens(texts: list[str | None]) -> Tokens:
    s = Scan(texts)
    offset = np.repeat(s.starts[:-1], np.diff(s.first))
    return Tokens(s.hashes(), s.first, s.a - offset, s.b - offset)


def chunks(column: pa.Array, size: int = 400_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """A column of texts in ranges (begin, end, texts) of about that many bytes each, so that few texts are Python strings
    at a time; a longer text is a range of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, total = i, 0
        total += n + 1
    if begin < len(lengths):
        yield begin, len(lengths), column.slice(begin).to_pylist()


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word): all runs of n words within one text; shorter texts give none."""
    if len(t.hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = ngram_hash(t.hashes, n)
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))[: len(h)]
    at = np.arange(len(h))
    ok = at + n <= t.first[text + 1]
    return h[ok], text[ok], at[ok]
