"""From a query tree to a DataFrame of matches.

All terms of a tree are looked up in one pass over the postings and meet in one shuffle, by document; the tree itself
becomes one expression over a row of per-term scores. However deep a tree, its plan has one scan and one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import bm25, idf
from fathom.plans.grammar import Occur
from fathom.plans.query import All, Boolean, Boost, DisMax, Nothing, Phrase, Query, Range, Term
from fathom.sources.index import Index


class NotAMatch(LookupError):
    """The document to explain doesn't match."""


def leaves(q: Query) -> list[tuple[str, str]]:
    """All (field, term) below a tree, each once."""
    if isinstance(q, Term):
        return [(q.field, q.term)]
    if isinstance(q, Phrase):
        return list(dict.fromkeys((q.field, t) for t in q.terms))
    below = [x for _, x in q.clauses] if isinstance(q, Boolean) else q.disjuncts if isinstance(q, DisMax) else [q.query] if isinstance(q, Boost) else []
    return list(dict.fromkeys(x for b in below for x in leaves(b)))


def phrases(q: Query) -> list[Phrase]:
    if isinstance(q, Phrase):
        return [q]
    below = [x for _, x in q.clauses] if isinstance(q, Boolean) else q.disjuncts if isinstance(q, DisMax) else [q.query] if isinstance(q, Boost) else []
    return [x for b in below for x in phrases(b)]


def matches_without_terms(q: Query) -> bool:
    """Whether a document that has none of the tree's terms may match."""
    if isinstance(q, (All, Range)):
        return True
    if isinstance(q, Boost):
        return matches_without_terms(q.query)
    if isinstance(q, DisMax):
        return any(map(matches_without_terms, q.disjuncts))
    if isinstance(q, Boolean):
        must = [x for o, x in q.clauses if o is Occur.MUST]
        should = [x for o, x in q.clauses if o is Occur.SHOULD]
        return all(map(matches_without_terms, must)) if must else any(map(matches_without_terms, should))
    return False


def ranges(q: Query) -> list[str]:
    if isinstance(q, Range):
        return [q.feature]
    below = [x for _, x in q.clauses] if isinstance(q, Boolean) else q.disjuncts if isinstance(q, DisMax) else [q.query] if isinstance(q, Boost) else []
    return list(dict.fromkeys(x for b in below for x in ranges(b)))


def weights(index: Index, terms: list[tuple[str, str]]) -> DataFrame:
    """(field, term, leaf, weight, avg_dl): what scoring needs of each term, from the small tables of statistics."""
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(terms)], "leaf int, field string, term string")
    stats = index.term_stats.where(F.col("term").isin(list({t for _, t in terms})))
    n = index.num_docs()
    return (
        asked.join(stats, ["field", "term"])
        .join(index.field_stats, "field")
        .crossJoin(n)
        .select("leaf", "field", "term", "df", idf(F.col("df"), F.col("n_docs")).alias("weight"), (F.col("total_length") / F.col("n_docs")).alias("avg_dl"))
    )


def _postings(index: Index, terms: list[tuple[str, str]]) -> DataFrame:
    """The postings of the terms; the conditions reach the Parquet scan."""
    own = F.col("term").isin(list({t for _, t in terms})) & F.col("field").isin(list({f for f, _ in terms}))
    return index.postings.where(own)


class _Row:
    """Expressions over one document's row: s0, s1, ... are the scores of its leaves (null: hasn't it)."""

    def __init__(self, terms: list[tuple[str, str]], scored: bool) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        self.scored = scored

    def of(self, q: Query) -> tuple[Column, Column]:
        """(does it match, score where it does)"""
        zero = F.lit(0.0)
        if isinstance(q, All):
            return F.lit(True), F.lit(1.0)
        if isinstance(q, Nothing):
            return F.lit(False), zero
        if isinstance(q, Range):
            x = F.col(q.feature)
            return F.coalesce((x >= q.low) & (x < q.high), F.lit(False)), zero
        if isinstance(q, Term):
            s = F.col(f"s{self.number[q.field, q.term]}")
            return s.isNotNull(), F.coalesce(s, zero)
        if isinstance(q, Phrase):
            return self.phrase(q)
        if isinstance(q, Boost):
            m, s = self.of(q.query)
            return m, s * float(q.factor)
        if isinstance(q, DisMax):
            parts = [self.of(d) for d in q.disjuncts]
            if not parts:
                return F.lit(False), zero
            scores = [F.when(m, s).otherwise(zero) for m, s in parts]
            total = reduce(lambda a, b: a + b, scores)
            best = F.greatest(*scores, zero) if len(scores) > 1 else F.greatest(scores[0], zero)
            return reduce(lambda a, b: a | b, [m for m, _ in parts]), best + (total - best) * float(q.tiebreaker)
        if isinstance(q, Boolean):
            by = {o: [self.of(x) for p, x in q.clauses if p is o] for o in Occur}
            must, should, no = by[Occur.MUST], by[Occur.SHOULD], by[Occur.MUST_NOT]
            if not must and not should:
                return F.lit(False), zero
            ok = reduce(lambda a, b: a & b, [m for m, _ in must]) if must else reduce(lambda a, b: a | b, [m for m, _ in should])
            for m, _ in no:
                ok = ok & ~m
            return ok, reduce(lambda a, b: a + b, [s for _, s in must] + [F.when(m, s).otherwise(zero) for m, s in should])
        raise TypeError(type(q).__name__)

    def phrase_tf(self, q: Phrase) -> Column:
        # where the phrase would begin, going by each of its terms: in proportion to how often they stand there
        begin = lambda i: lambda at: at - i
        begins = [F.transform(F.col(f"p{self.number[q.field, t]}"), begin(i)) for i, t in enumerate(q.terms)]
        return F.size(reduce(F.array_intersect, begins))

    def phrase(self, q: Phrase) -> tuple[Column, Column]:
        numbers = [self.number[q.field, t] for t in q.terms]
        tf = self.phrase_tf(q)
        there = reduce(lambda a, b: a & b, [F.col(f"p{k}").isNotNull() for k in dict.fromkeys(numbers)])
        matched = F.coalesce(there & (tf > 0), F.lit(False))
        if not self.scored:
            return matched, F.lit(0.0)
        weight = reduce(lambda a, b: a + b, [F.col(f"w{k}") for k in numbers])
        return matched, F.coalesce(bm25(tf.cast("double"), weight, F.col(f"d{numbers[0]}"), F.col(f"a{numbers[0]}")), F.lit(0.0))


def rows(index: Index, q: Query, scored: bool) -> DataFrame:
    """One row a document that has any of the tree's terms."""
    terms = leaves(q)
    spark = index.docs.sparkSession
    if scored:
        asked = weights(index, terms)
    else:
        asked = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(terms)], "leaf int, field string, term string")
    # as many rows as the query has terms
    hits = _postings(index, terms).join(F.broadcast(asked), ["field", "term"])
    score = bm25(F.col("tf").cast("double"), F.col("weight"), F.col("dl"), F.col("avg_dl")) if scored else F.lit(0.0)
    of = lambda i, x: F.max(F.when(F.col("leaf") == i, x))
    columns = [of(i, score).alias(f"s{i}") for i in range(len(terms))]
    number = {t: i for i, t in enumerate(terms)}
    for k in dict.fromkeys(number[p.field, t] for p in phrases(q) for t in p.terms):
        columns.append(of(k, F.col("positions")).alias(f"p{k}"))
        if scored:
            columns += [of(k, F.col(x)).alias(f"{y}{k}") for x, y in (("weight", "w"), ("dl", "d"), ("avg_dl", "a"))]
    return hits.groupBy("doc_id").agg(*columns)


def search(index: Index, q: Query | None, scored: bool = True) -> DataFrame:
    """(doc_id, score) of all matches; no query matches nothing. Unscored, the tables of statistics aren't read."""
    q = q if q is not None else Nothing()
    terms = leaves(q)
    needs_docs = matches_without_terms(q) or ranges(q)
    everything = index.docs.select("doc_id", *ranges(q))
    if not terms:
        found = everything if needs_docs else everything.where(F.lit(False))
    elif needs_docs:
        found = everything.join(rows(index, q, scored), "doc_id", "left" if matches_without_terms(q) else "inner")
    else:
        found = rows(index, q, scored)
    match, score = _Row(terms, scored).of(q)
    return found.where(match).select("doc_id", (score if scored else F.lit(0.0)).alias("score"))


def clauses(q: Query, boost: float = 1.0) -> list[tuple[str, str, float]]:
    """(field, term, boost) of each term below a tree that adds to scores, repeated ones repeatedly."""
    if isinstance(q, Term):
        return [(q.field, q.term, boost)]
    if isinstance(q, Phrase):
        return [(q.field, t, boost) for t in q.terms]
    if isinstance(q, Boost):
        return clauses(q.query, boost * q.factor)
    below = [x for o, x in q.clauses if o is not Occur.MUST_NOT] if isinstance(q, Boolean) else q.disjuncts if isinstance(q, DisMax) else []
    return [x for b in below for x in clauses(b, boost)]


def explain(index: Index, q: Query, doc_id: int) -> DataFrame:
    """(doc_id, clause, field, term, tf, df, dl, idf, boost, score) of a matching document's clauses."""
    if search(index, q, scored=False).where(F.col("doc_id") == doc_id).isEmpty():
        raise NotAMatch(str(doc_id))
    return explained(index, q).where(F.col("doc_id") == doc_id)


def explained(index: Index, q: Query) -> DataFrame:
    """The same for all documents that match."""
    spark = index.docs.sparkSession
    parts = clauses(q)
    asked = spark.createDataFrame([(i, f, t, float(b)) for i, (f, t, b) in enumerate(parts)], "clause int, field string, term string, boost double")
    terms = list(dict.fromkeys((f, t) for f, t, _ in parts))
    known = weights(index, terms).drop("leaf").join(asked, ["field", "term"])
    hits = _postings(index, terms).drop("positions").join(F.broadcast(known), ["field", "term"])
    hits = hits.join(search(index, q, scored=False).select("doc_id"), "doc_id", "left_semi")
    score = bm25(F.col("tf").cast("double"), F.col("weight"), F.col("dl"), F.col("avg_dl")) * F.col("boost")
    return hits.select("doc_id", "clause", "field", "term", "tf", "df", "dl", F.col("weight").alias("idf"), "boost", score.alias("score"))


def nodes(q: Query, path: str = "0", occur: str = "") -> list[tuple[str, str, str, Query]]:
    """(path, occur, what it is, tree) of each node, from the root down; a node's children go by their place."""
    kind = type(q).__name__.lower()
    if isinstance(q, Term):
        text, below = f"{q.field}:{q.term}", []
    elif isinstance(q, Phrase):
        text, below = f'{q.field}:"{" ".join(q.terms)}"', []
    elif isinstance(q, Boost):
        text, below = f"x {float(q.factor)}", [("", q.query)]
    elif isinstance(q, DisMax):
        text, below = f"tiebreaker {float(q.tiebreaker)}", [("", d) for d in q.disjuncts]
    elif isinstance(q, Boolean):
        text, below = "", [(o.value, x) for o, x in q.clauses]
    else:
        text, below = (f"{q.feature} in [{q.low}, {q.high})" if isinstance(q, Range) else ""), []
    return [(path, occur, f"{kind} {text}".strip(), q), *(x for i, (o, b) in enumerate(below) for x in nodes(b, f"{path}.{i}", o))]


def explain_nodes(index: Index, q: Query) -> DataFrame:
    """(doc_id, node, occur, what, matched, score, tf) of every node of the tree, for all documents that match: of a DisMax
    each disjunct beside what they give together, of a phrase how often it stands there. A node that doesn't match has no
    score."""
    terms = leaves(q)
    row = _Row(terms, True)
    needs_docs = matches_without_terms(q) or ranges(q)
    everything = index.docs.select("doc_id", *ranges(q))
    found = everything if not terms else everything.join(rows(index, q, True), "doc_id", "left" if matches_without_terms(q) else "inner") if needs_docs else rows(index, q, True)
    parts = []
    for path, occur, what, node in nodes(q):
        match, score = row.of(node)
        tf = row.phrase_tf(node) if isinstance(node, Phrase) else F.lit(None)
        parts.append(F.struct(F.lit(path).alias("node"), F.lit(occur).alias("occur"), F.lit(what).alias("what"), match.alias("matched"), F.when(match, score).alias("score"), F.when(match, tf).cast("long").alias("tf")))
    return found.where(row.of(q)[0]).select("doc_id", F.inline(F.array(*parts)))
