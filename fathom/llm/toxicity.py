"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled documents (``max_positive`` + ``max_negative`` of those that are there, chosen by hash) is
split in three: one part yields a learned lexicon (all words and word beginnings that mark toxic documents), one fits the
trees, one the calibration. Every document is then scored over its whole text.

Defined results
- null or empty text: no words, so every density is 0; scored like any other row (never toxic unless labels say so).
- null id: scored, with a null id in the result. Repeated rows: one result row for each row.
- very long texts: whole, like others. They weigh in features as rates, and as logarithms of counts.
- no labels, or one class only: a model that gives every document the one class (not toxic, where there is none).
- an id with several labels: toxic if any of them is 1; null labels and ids are ignored, and so are labels of documents that
  aren't there. Of several texts with one id, the least in order is learned from; each is scored.
- held-back labels of one class only: no calibration, a probability is the logistic function of the score.
- ties: of splits that gain the same, the first feature's lowest; a probability of exactly ``threshold`` is toxic.
- empty documents: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import Scan, _letters, c, chunks, codes, cut, tokens

#: General insults and slurs of contempt; the learned lexicon adds what the labels show.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool foolish imbecile cretin loser losers scum trash garbage filth vermin clown clowns pathetic"
    " worthless useless disgusting disgrace ugly freak creep pig swine rat bastard bitch asshole jerk crap damn shit shitty fuck fucking retard hate"
    " kill die coward liar parasite subhuman degenerate sucker hell"
    " dummkopf arschloch scheisse scheiße abschaum trottel depp versager blödmann idioten dreckig wertlos"
    " imbécile connard salaud crétin abruti ordure minable dégoûtant stupide merde"
    " estúpido imbécil idiota basura asqueroso pendejo mierda inútil escoria patético".split()
)
SECOND = frozenset("you your yours yourself yourselves youre u ur thou thee thy du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split())
PREFIXES = (4, 5, 6, 7)
FEATURES = (
    "insult_density", "insult_count", "learned_density", "learned_count", "learned_weight", "learned_max", "learned_distinct", "second_proximity",
    "second_density", "capital_rate", "shout_rate", "exclamation_rate", "punctuation_rate", "obfuscation_rate", "log_words", "window_hits",
)
_PUNCT = np.array([(33 <= b <= 47) or (58 <= b <= 64) or (91 <= b <= 96) or (123 <= b <= 126) for b in range(256)])
_SIGN = np.array([chr(b) in "0123456789@$!*" for b in range(128)])
#: Gains closer than this are ties: sums in another order differ by less.
TIE = 1e-9
#: How many words a window of window_hits has.
WINDOW = 50


class Lexicon:
    """Insults, second-person pronouns and learned units, by the hashes of words and of their beginnings."""

    def __init__(self, learned: dict[tuple[int, int], float]) -> None:
        """learned: weights by (number of letters, 0 for a whole word; hash)"""
        self.insults, self.second = (np.sort(tokens([" ".join(sorted(x))]).hashes) for x in (INSULTS, SECOND))
        self.words = self._table(learned, 0)
        self.beginnings = {n: self._table(learned, n) for n in PREFIXES}

    @staticmethod
    def _table(learned: dict[tuple[int, int], float], n: int) -> tuple[np.ndarray, np.ndarray]:
        own = sorted((h & 0xFFFFFFFFFFFFFFFF, w) for (k, h), w in learned.items() if k == n)
        return np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own], np.float64)

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
        return at, (table[at] == h) if len(table) else np.zeros(len(h), bool)

    def weights(self, s: Scan, h: np.ndarray) -> np.ndarray:
        """Of each word its weight, or that of its longest known beginning, or 0."""
        at, found = self._find(self.words[0], h)
        out = np.zeros(len(h))
        out[found] = self.words[1][at[found]]
        for n in reversed(PREFIXES):
            rest = np.flatnonzero(~found & (s.b - s.a > n))
            at, own = self._find(self.beginnings[n][0], s.hashes(n)[rest])
            out[rest[own]] = self.beginnings[n][1][at[own]]
            found[rest[own]] = True
        return out


def feature_rows(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text, all texts at once."""
    s, k = Scan(texts), len(texts)
    out = np.zeros((k, len(FEATURES)))
    if not len(s.a):
        return out
    h, n, text = s.hashes(), np.diff(s.first), np.repeat(np.arange(k), np.diff(s.first))
    per = lambda x, w=None: np.bincount(text[x], None if w is None else w[x], k)
    best = lambda x, w: _best(text[x], w, k)
    insult, second, v = lexicon._find(lexicon.insults, h)[1], lexicon._find(lexicon.second, h)[1], lexicon.weights(s, h)
    learned, at, you = np.flatnonzero(v > 0), np.flatnonzero(insult | (v > 0)), np.flatnonzero(second)
    near = np.zeros(k)
    if len(at) and len(you):
        j = np.searchsorted(you, at)
        for other in (you[np.clip(j - 1, 0, len(you) - 1)], you[np.clip(j, 0, len(you) - 1)]):
            same = text[other] == text[at]
            near = np.maximum(near, best(at[same], 1.0 / (1.0 + np.abs(at[same] - other[same]))))
    # words that a window beginning at each hit has, within the text
    span = np.searchsorted(at, np.minimum(at + WINDOW, s.first[text[at] + 1])) - np.arange(len(at))
    seen = np.unique(np.stack([text[learned].astype(np.uint64), h[learned]]), axis=1)[0].astype(np.int64) if len(learned) else learned
    # letters as written; lowered texts have the same length
    x = codes("\n".join(t or "" for t in texts))
    upper, lower = (x >= 65) & (x <= 90), (x >= 97) & (x <= 122)
    punct = (x < 256) & _PUNCT[np.minimum(x, 255)]
    bounds = list(zip(s.starts[:-1].tolist(), s.starts[1:].tolist()))
    sums = lambda y: np.array([np.count_nonzero(y[i:j]) for i, j in bounds])
    shout, capitals = np.flatnonzero((s.b - s.a >= 3) & upper[s.a]), np.flatnonzero(upper)
    shout = shout[np.searchsorted(capitals, s.b[shout]) - np.searchsorted(capitals, s.a[shout]) == (s.b - s.a)[shout]]
    n_upper = sums(upper)
    sign = (x < 128) & _SIGN[np.minimum(x, 127)]
    edge = np.diff(np.concatenate([[False], sign, [False]]).view(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letter = _letters()[0][x] & ~sign & (x != 95)
    inner = (a > 0) & (b < len(x))
    a, b = a[inner], b[inner]
    hidden = a[letter[a - 1] & letter[b]]
    words_, chars = np.maximum(n, 1), np.maximum(np.diff(s.starts) - 1, 1)
    out[:] = np.stack(
        [
            per(insult.nonzero()[0]) / words_, np.log1p(per(insult.nonzero()[0])), per(learned) / words_, np.log1p(per(learned)), per(learned, v) / words_,
            best(learned, v[learned]), np.log1p(np.bincount(seen, minlength=k)), near, per(you) / words_, n_upper / np.maximum(n_upper + sums(lower), 1),
            per(shout) / words_, sums(x == 33) / chars, sums(punct) / chars, np.bincount(np.searchsorted(s.starts, hidden, side="right") - 1, minlength=k) / words_,
            np.log1p(n), best(at, span.astype(np.float64)),
        ],
        axis=1,
    )
    out[n == 0] = 0
    return out


def _best(text: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(k)
    np.maximum.at(out, text, value)
    return out


def column_rows(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    parts = [feature_rows(texts, lexicon) for _, _, texts in chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logistic loss, over quantile bins; with a calibration."""

    base: float = -20.0
    depth: int = 3
    cuts: list = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 7), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    iso_x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    iso_y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if len(self.iso_x):
            return np.interp(raw, self.iso_x, self.iso_y)
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, least: float = 2.0, l2: float = 1.0) -> Trees:
    if len(y) == 0 or y.min() == y.max():
        return Trees(base=-20.0 if len(y) == 0 or y.max() == 0 else 20.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    zero = [np.unique(np.concatenate([q, [0.0]])) for q in cuts]  # presence against absence can always be told
    binned = np.stack([np.searchsorted(zero[j], x[:, j], side="left") for j in range(x.shape[1])], 1)
    share = y.mean()
    model = Trees(base=float(np.log(share / (1 - share))), depth=depth, cuts=zero)
    raw = np.full(len(y), model.base)
    fs, ts, vs = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for k in range(2**depth - 1):
            own = np.flatnonzero(node == k)
            best, gain = None, 1e-6
            if len(own) >= 2 * least:
                G, H = g[own].sum(), h[own].sum()
                for j in range(x.shape[1]):
                    m = len(zero[j]) + 1
                    b = binned[own, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[own], h[own], None))
                    score = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                    score[(nl < least) | (len(own) - nl < least)] = -1
                    if not len(score) or (most := score.max()) <= gain + TIE:
                        continue
                    best, gain = (j, int(np.flatnonzero(score >= most - TIE)[0])), most
            right = np.zeros(len(own), np.int64)
            if best:
                f[k], t[k] = best[0], zero[best[0]][best[1]]
                right = (binned[own, best[0]] > best[1]).astype(np.int64)
            node[own] = 2 * k + 1 + right
        leaf = node - (2**depth - 1)
        G, H = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        v = rate * np.clip(G / (H + l2), -4, 4)
        raw += v[leaf]
        fs.append(f), ts.append(t), vs.append(v)
    model.feature, model.threshold, model.value = np.array(fs), np.array(ts), np.array(vs)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray, prior: float = 0.0, strength: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing map from score to probability, as the ends of its steps. Each step is drawn
    to the prior as if ``strength`` more documents had been seen, so that a step of one or two documents proves nothing."""
    scores, group = np.unique(raw, return_inverse=True)
    total, count = np.bincount(group, y), np.bincount(group)  # ties are one observation
    blocks: list[list[float]] = []  # sum, count, lowest score, highest score
    for s, t, n in zip(scores.tolist(), total.tolist(), count.tolist()):
        blocks.append([t, float(n), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    x = np.array([e for b in blocks for e in b[2:]])
    p = np.array([(b[0] + strength * prior) / (b[1] + strength) for b in blocks for _ in range(2)])
    return x, np.maximum.accumulate(p)


def units(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(letters, text, hash) of the distinct words of each text, and of their beginnings."""
    s = Scan(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(s.first))
    for n in (0, *PREFIXES):
        long = np.flatnonzero(s.b - s.a > n)
        t, h = text[long], (s.hashes(n) if n else s.hashes())[long]
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        yield n, t[new], h[new]


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for begin, end, texts in chunks(b.column("text")):
            for n, t, h in units(texts):
                keys, at = np.unique(h, return_inverse=True)
                a = np.bincount(at, toxic[begin:end][t], len(keys)).astype(np.int64)
                both = np.bincount(at, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(a), pa.array(both - a)], ["n", "h", "a", "b"])


def learned_lexicon(train: DataFrame, n_toxic: int, n_clean: int, least: int = 3, ratio: float = 12.0) -> dict[tuple[int, int], float]:
    """All units whose document frequency among toxic documents is ``ratio`` times that among the others (log odds). They
    are units of the sample's toxic documents, so the sample bounds how many."""
    n = train.select("text", "toxic").mapInArrow(_count_units, "n int, h long, a long, b long").groupBy("n", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weight = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_clean + 1.0))
    rows = n.where(F.col("a") >= least).select("n", "h", weight.alias("w")).where(F.col("w") >= float(np.log(ratio))).collect()
    return {(r["n"], r["h"]): float(r["w"]) for r in rows}


@dataclass
class Model:
    lexicon: dict[tuple[int, int], float]
    trees: Trees
    n_train: int = 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 4000, max_negative: int = 8000) -> Model:
    """Fits on at most ``max_positive`` + ``max_negative`` labelled documents, those whose id hashes lowest."""
    lab = labels.select(c(id_col).cast("long").alias("id"), c(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    own = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    # a label counts for the sample only if its document is there
    lot = lab.join(own.select("id"), "id", "left_semi").withColumn("lot", F.xxhash64("id", F.lit(11)))
    chosen = lot.where("toxic = 1").orderBy("lot", "id").limit(max_positive).unionByName(lot.where("toxic = 0").orderBy("lot", "id").limit(max_negative))
    # at most max_positive + max_negative rows of three numbers: a bound of its own, whatever the tables hold
    met = own.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    train = cut(met.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(10)).alias("fold")))
    size = {(r["toxic"], r["first"]): r["n"] for r in train.groupBy("toxic", (F.col("fold") < 5).alias("first")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = (sum(size.get((k, f), 0) for f in (True, False)) for k in (1, 0))
    if not n_toxic or not n_clean:
        return Model({}, Trees(base=20.0 if n_toxic else -20.0), n_toxic + n_clean)
    lexicon = learned_lexicon(train.where("fold < 5"), size.get((1, True), 0), size.get((0, True), 0))
    table_ = Lexicon(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = column_rows(b.column("text"), table_)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("toxic"), b.column("fold")], ["x", "toxic", "fold"])

    got = train.where("fold >= 5").mapInArrow(rows, "x array<double>, toxic int, fold long").orderBy("x", "toxic", "fold").collect()
    if not got:
        return Model(lexicon, Trees(), 0)
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got])
    trees = fit_trees(x[fold < 8], y[fold < 8]) if (fold < 8).any() else Trees()
    held = fold >= 8
    if len(trees.feature) and held.any() and y[held].min() < y[held].max():
        trees.iso_x, trees.iso_y = isotonic(trees.raw(x[held]), y[held], prior=n_toxic / (n_toxic + n_clean), strength=4.0)
    return Model(lexicon, trees, n_toxic + n_clean)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, probability, toxic) for each row."""
    lexicon, trees = Lexicon(model.lexicon), model.trees

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = column_rows(b.column(1), lexicon)
            p = trees.probability(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.raw(x)), pa.array(p), pa.array(p >= threshold)], [id_col, "score", "probability", "toxic"])

    return docs.select(c(id_col).cast("long").alias(id_col), c(text_col).cast("string").alias("text_")).mapInArrow(rows, f"`{id_col}` long, score double, probability double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit_options) -> DataFrame:
    return score(docs, fit(docs, labels, **fit_options), threshold=threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit_options) -> DataFrame:
    """The documents that aren't toxic, with all their columns, in one more pass over the texts and no shuffle."""
    model = fit(docs, labels, **fit_options)
    lexicon, trees = Lexicon(model.lexicon), model.trees
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = column_rows(b.column(at), lexicon)
            yield b.filter(pa.array(trees.probability(x) < threshold))

    return docs.mapInArrow(keep, schema)
