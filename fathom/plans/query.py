"""Query trees, and the parser that makes them of what users type.

Trees are plain values; ``fathom.plans.compiler`` turns one into a DataFrame of matches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from fathom.functions.text import tokenize
from fathom.plans.grammar import Occur, RawClause, parse

class Query:
    """Base of all trees."""


@dataclass(frozen=True)
class All(Query):
    """Every document, with score 1."""


@dataclass(frozen=True)
class Nothing(Query):
    """No document."""


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str


@dataclass(frozen=True)
class Phrase(Query):
    """Consecutive terms of one field."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Boolean(Query):
    """Must clauses must match; a should clause is optional beside one; none of the must-not clauses may match."""

    clauses: tuple[tuple[Occur, Query], ...]


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float


@dataclass(frozen=True)
class DisMax(Query):
    """The best disjunct's score, and of the others' sum so much."""

    disjuncts: tuple[Query, ...]
    tiebreaker: float

    def __post_init__(self) -> None:
        if not 0.0 <= self.tiebreaker <= 1.0:
            raise ValueError("a tiebreaker lies between 0 and 1")


@dataclass(frozen=True)
class Range(Query):
    """A feature within [low, high); a constant score of 0, so that filters don't change a ranking."""

    feature: str
    low: float
    high: float


def any_of(queries: Iterable[Query]) -> Query:
    qs = tuple(queries)
    return Nothing() if not qs else qs[0] if len(qs) == 1 else Boolean(tuple((Occur.SHOULD, q) for q in qs))


def all_of(queries: Iterable[Query]) -> Query:
    """Of none, all documents; of one, itself."""
    qs = tuple(queries)
    return All() if not qs else qs[0] if len(qs) == 1 else Boolean(tuple((Occur.MUST, q) for q in qs))


def dismax(queries: Iterable[Query], tiebreaker: float) -> Query:
    qs = tuple(queries)
    return Nothing() if not qs else qs[0] if len(qs) == 1 else DisMax(qs, tiebreaker)


@dataclass
class QueryParser:
    """Reads queries over some fields, by default over all of them."""

    fields: list[str]
    boosts: dict[str, float] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    defaults: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.names = self.names or {f: f for f in self.fields}
        self.defaults = self.defaults or list(self.fields)

    def set_boost(self, field_: str, factor: float | None) -> None:
        if factor is None:
            self.boosts.pop(field_, None)
        elif field_ in self.fields:
            self.boosts[field_] = factor

    def set_name(self, field_: str, name: str | None) -> None:
        """The name that addresses a field; None: it can't be addressed."""
        self.names = {n: f for n, f in self.names.items() if f != field_}
        if name is not None and field_ in self.fields:
            self.names[name] = field_

    def set_default_fields(self, fields: list[str]) -> None:
        """Unknown ones are ignored; the order is that of the parser's fields."""
        self.defaults = [f for f in self.fields if f in fields]

    def parse(self, text: str) -> Query | None:
        """A clause matches in any field; None where nothing is left to look for."""
        return self._parse(text, None)

    def parse_dismax(self, text: str, tiebreaker: float) -> Query | None:
        """A clause's score is that of its best field, and of the others so much."""
        return self._parse(text, tiebreaker)

    def _parse(self, text: str, tiebreaker: float | None) -> Query | None:
        clauses: list[tuple[Occur, Query]] = []
        for raw in parse(text, list(self.names)):
            fields = [self.names[raw.field]] if raw.field is not None else self.defaults
            found = [q for f in fields if (q := self._leaf(raw, f)) is not None]
            if raw.occur is Occur.MUST_NOT:
                clauses += [(Occur.MUST_NOT, q) for q in found]  # in none of the fields
            elif found:
                clauses.append((raw.occur, any_of(found) if tiebreaker is None else dismax(found, tiebreaker)))
        if not clauses:
            return None
        if all(o is Occur.MUST_NOT for o, _ in clauses):
            clauses.append((Occur.MUST, All()))
        if len(clauses) == 1:
            return clauses[0][1]
        return Boolean(tuple(clauses))

    def _leaf(self, raw: RawClause, field_: str) -> Query | None:
        terms = tokenize(raw.text)
        if not terms:
            return None
        if len(terms) == 1:
            q: Query = Term(field_, terms[0])
        elif raw.phrase:
            q = Phrase(field_, tuple(terms))
        else:
            q = any_of(Term(field_, t) for t in terms)
        factor = self.boosts.get(field_)
        return q if factor is None or raw.occur is Occur.MUST_NOT else Boost(q, factor)
