from __future__ import annotations

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fathom.functions.text import ELEMENT_GAP, tokenize, tokens
from fathom.operators.keywords import TopTerms
from fathom.plans.compiler import NotAMatch, explain, explain_nodes, explained, leaves, search
from fathom.plans.grammar import Occur
from fathom.plans.query import All, Boolean, Boost, DisMax, Nothing, Phrase, QueryParser, Range, Term, all_of, any_of
from fathom.sources.index import Index, IndexExists, MissingTable

FILMS = [
    (0, "Across the Universe", "Musical based on The Beatles songbook and set in the 60s England, America, and Vietnam. The love story of Lucy and Jude is intertwined with the anti-war movement and social protests of the 60s."),
    (1, "Moulin Rouge!", "A poor Bohemian poet in 1890s Paris falls for a beautiful courtesan and nightclub star coveted by a jealous duke."),
    (2, "Once", "A modern-day musical about a busker and an immigrant and their eventful week in Dublin, as they write, rehearse and record songs that tell their love story."),
]
COUNTS = [(i, "x", i) for i in range(50)]


@pytest.fixture(scope="module")
def films(spark):
    df = spark.createDataFrame(FILMS, "doc_id long, title string, plot string")
    return Index.build(df, {"title": F.col("title"), "plot": F.col("plot")})


@pytest.fixture(scope="module")
def numbers(spark):
    return Index.build(spark.createDataFrame(COUNTS, "doc_id long, t string, n long"), {"t": F.col("t")})


def ids(index, q):
    return sorted(r["doc_id"] for r in search(index, q).collect())


def const(low, high):
    return Boolean(((Occur.MUST, Range("n", low, high)), (Occur.MUST, All())))


def test_tokens(spark):
    text = "Don't PANIC, it's 42—ok?  über_groß " + "x" * 40 + " " + "y" * 39
    want = ["don", "t", "panic", "it", "s", "42", "ok", "über", "groß", "y" * 39]
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == want
    assert tokenize(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("+title:Once musical", [2]),
        ('"the beatles"', [0]),
        ("-love", [1]),
        ("-story -love", [1]),
        ('-"love story"', [1]),
        ("musical", [0, 2]),
        ("+musical -dublin", [0]),
        ("love-story", [0, 2]),
        ("nothingofthesort", []),
    ],
)
def test_parsed_queries(films, text, want):
    assert ids(films, QueryParser(["title", "plot"]).parse(text)) == want
    assert ids(films, QueryParser(["title", "plot"]).parse_dismax(text, 0.1)) == want


def test_kinds_of_leaves():
    p = QueryParser(["a", "b"])
    assert p.parse("a:x") == Term("a", "x")
    assert p.parse('a:"x"') == Term("a", "x")
    assert p.parse('a:"x y"') == Phrase("a", ("x", "y"))
    assert p.parse("a:x-y") == any_of((Term("a", "x"), Term("a", "y")))
    assert p.parse("...") is None and p.parse("") is None
    assert p.parse("x") == any_of((Term("a", "x"), Term("b", "x")))
    assert p.parse_dismax("x", 0.5) == DisMax((Term("a", "x"), Term("b", "x")), 0.5)
    assert p.parse("-x") == Boolean(((Occur.MUST_NOT, Term("a", "x")), (Occur.MUST_NOT, Term("b", "x")), (Occur.MUST, All())))
    p.set_boost("a", 2.0)
    assert p.parse("a:x") == Boost(Term("a", "x"), 2.0)
    p.set_boost("a", None)
    p.set_name("a", "headline")
    assert p.parse("headline:x") == Term("a", "x")
    assert p.parse("a:x") != Term("a", "x")
    p.set_name("a", None)
    assert p.parse("headline:x") != Term("a", "x")
    p.set_default_fields(["b", "zz"])
    assert p.parse("x") == Term("b", "x")
    assert all_of([]) == All() and any_of([]) == Nothing()


def test_boost_changes_the_order(spark):
    rows = [(0, "bar", "foo baz"), (1, "foo", "bar"), (2, "bar", "foo")]
    index = Index.build(spark.createDataFrame(rows, "doc_id long, a string, b string"), {"a": F.col("a"), "b": F.col("b")})
    best = lambda p: search(index, p.parse("foo baz")).orderBy(F.desc("score"), "doc_id").first()["doc_id"]
    assert best(QueryParser(["a", "b"])) == 0
    # an exact length norm weighs short fields less than a rounded one would, so the factor is larger than 1.5
    assert best(QueryParser(["a", "b"], boosts={"a": 4.0})) == 1


def test_dismax(numbers):
    assert ids(numbers, DisMax((const(0, 10), const(5, 20), const(9, 30), const(42, 43), const(13, 13)), 0.3)) == [*range(30), 42]
    score = lambda q, i: {r["doc_id"]: r["score"] for r in search(numbers, q).collect()}[i]
    three = DisMax((const(4, 5), const(4, 6), const(4, 7)), 1.0)
    assert [score(three, i) for i in (4, 5, 6)] == [3, 2, 1]
    assert score(DisMax((const(7, 8), const(7, 8)), 0.0), 7) == 1
    with pytest.raises(ValueError):
        DisMax((), 1.5)
    assert ids(numbers, DisMax((), 0.5)) == []


def test_scores_of_must_and_should(films):
    base = {r["doc_id"]: r["score"] for r in search(films, Term("plot", "musical")).collect()}
    more = {r["doc_id"]: r["score"] for r in search(films, QueryParser(["plot"]).parse("+musical beatles")).collect()}
    assert more[2] == pytest.approx(base[2]) and more[0] > base[0]
    twice = {r["doc_id"]: r["score"] for r in search(films, Boost(Term("plot", "musical"), 2.0)).collect()}
    assert twice[2] == pytest.approx(2 * base[2])
    again = {r["doc_id"]: r["score"] for r in search(films, QueryParser(["plot"]).parse("musical musical")).collect()}
    assert again[2] == pytest.approx(2 * base[2])  # a repeated clause counts again


def test_phrases(spark):
    rows = [(0, ["one two", "three four"]), (1, ["one two three"]), (2, ["two one two one two"]), (3, [])]
    index = Index.build(spark.createDataFrame(rows, "doc_id long, t array<string>"), {"t": F.col("t")})
    assert ids(index, Phrase("t", ("two", "three"))) == [1]  # not over the edge of an element
    assert ids(index, Phrase("t", ("one", "two", "one"))) == [2]
    assert ids(index, Phrase("t", ("one", "two"))) == [0, 1, 2]
    assert index.postings.where("term = 'four'").first()["positions"] == [ELEMENT_GAP + 1]


def test_a_phrase_in_a_very_long_text_takes_time_in_proportion(spark):
    text = "one two " * 60_000 + "two three"
    index = Index.build(spark.createDataFrame([(1, text), (2, "two one")], "doc_id long, t string"), {"t": F.col("t")})
    begun = time.perf_counter()
    (row,) = search(index, Phrase("t", ("one", "two", "one"))).collect()
    assert ids(index, Phrase("t", ("two", "two", "three"))) == [1] and row["doc_id"] == 1
    assert time.perf_counter() - begun < 20


def test_tokens_outside_the_jvm_are_the_same(spark):
    odd = "İstanbul ǅ ﬁ ΑΣ ΑΣ. 数学 ½ Ⅷ ² ٣ e\u0301 ß ẞ _x_ a_b \U0001f600x\U00010400 ª ºn " + "é" * 19 + " " + "é" * 20 + " " + "x" * 39 + " " + "x" * 40
    data = spark.createDataFrame([(odd,), ("",), ("...",)], "t string")
    assert [r[0] for r in data.select(tokens(F.col("t"))).collect()] == [tokenize(t) for t in (odd, "", "...")]


def test_unscored_search_reads_no_statistics(films):
    films_without = replace(films, term_stats=films.term_stats.select("field"), corpus=films.docs.select("title"))
    assert sorted(r["doc_id"] for r in search(films_without, Term("plot", "musical"), scored=False).collect()) == [0, 2]


def test_one_scan_and_one_exchange_for_a_deep_tree(spark, films, tmp_path, capsys):
    stored = films.write(str(tmp_path / "i"))
    q = QueryParser(["title", "plot"], boosts={"title": 2.0}).parse_dismax("+musical love -dublin universe", 0.1)
    assert len(leaves(q)) == 8
    search(stored, q, scored=False).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("postings") == 1
    assert "In(term" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_explain(films):
    q = QueryParser(["title", "plot"]).parse("musical once")
    rows = explain(films, q, 2).collect()
    assert {(r["field"], r["term"]) for r in rows} == {("plot", "musical"), ("title", "once")}
    total = search(films, q).where("doc_id = 2").first()["score"]
    assert sum(r["score"] for r in rows) == pytest.approx(total)
    with pytest.raises(NotAMatch):
        explain(films, q, 1)
    # documents that have a term but don't match aren't explained
    assert {r["doc_id"] for r in explained(films, QueryParser(["plot"]).parse("+musical -dublin")).collect()} == {0}


def test_explained_nodes(films):
    q = QueryParser(["title", "plot"], boosts={"title": 2.0}).parse_dismax('musical "love story" -paris', 0.1)
    rows = {(r["doc_id"], r["node"]): r for r in explain_nodes(films, q).collect()}
    scores = {r["doc_id"]: r["score"] for r in search(films, q).collect()}
    assert {d for d, _ in rows} == set(scores) == {0, 2}
    for d, total in scores.items():
        assert rows[d, "0"]["score"] == pytest.approx(total) == pytest.approx(rows[d, "0.0"]["score"] + rows[d, "0.1"]["score"])
        title, plot = rows[d, "0.0.0"], rows[d, "0.0.1"]
        assert rows[d, "0.0"]["what"] == "dismax tiebreaker 0.1" and not title["matched"] and title["score"] is None
        assert rows[d, "0.0"]["score"] == pytest.approx(plot["score"]) and plot["what"] == "term plot:musical"
        phrase = next(r for (x, _), r in rows.items() if x == d and r["what"] == 'phrase plot:"love story"')
        assert phrase["tf"] == 1
        assert [r["occur"] for (x, n), r in rows.items() if x == d and "paris" in r["what"]] == ["must_not"] * 2


def test_stored_index(spark, films, tmp_path):
    path = str(tmp_path / "index")
    stored = films.write(path)
    q = QueryParser(["title", "plot"]).parse("love story")
    want = {(r["doc_id"], round(r["score"], 9)) for r in search(films, q).collect()}
    assert {(r["doc_id"], round(r["score"], 9)) for r in search(stored, q).collect()} == want
    before = sorted(p.name for p in (tmp_path / "index").rglob("*"))
    with pytest.raises(IndexExists, match="already exists"):
        films.write(path)
    assert sorted(p.name for p in (tmp_path / "index").rglob("*")) == before
    assert films.write(path, overwrite=True).num_docs().first()[0] == 3
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{path}/term_stats")
    with pytest.raises(MissingTable):
        Index.open(spark, path, ["title"])


def test_empty_index_and_null_text(spark):
    empty = Index.build(spark.createDataFrame([], "doc_id long, t string"), {"t": F.col("t")})
    assert ids(empty, Term("t", "x")) == [] and ids(empty, All()) == []
    some = Index.build(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, t string"), {"t": F.col("t")})
    assert ids(some, Term("t", "x")) == [3] and ids(some, All()) == [1, 2, 3]
    with pytest.raises(TypeError):
        Index.build(spark.createDataFrame([(1, 2)], "doc_id long, t int"), {"t": F.col("t")})


QUOTES = [
    (0, "Marley", "Marley was dead: to begin with. There is no doubt whatever about that. Old Marley was as dead as a door-nail."),
    (1, "Wilde", "A little sincerity is a dangerous thing, and a great deal of it is absolutely fatal. Dangerous indeed."),
    (2, "Twain", "The reports of my death are greatly exaggerated, said the old man to the great crowd about him."),
]


@pytest.fixture(scope="module")
def quotes(spark):
    df = spark.createDataFrame(QUOTES, "doc_id long, source string, quote string")
    return Index.build(df, {"source": F.col("source"), "quote": F.col("quote")})


def test_keywords(quotes):
    top = TopTerms(quotes, ["quote"])
    assert "marley" in [t for _, t, _ in top.extract_from_doc(4, 0).terms()]
    assert top.extract_from_doc(1, 1).terms()[0][1] == "dangerous"
    words = top.extract(10, QUOTES[2][2])
    found = search(quotes, words.into_query()).orderBy(F.desc("score")).first()["doc_id"]
    boosted = search(quotes, words.into_boosted_query(2.0)).orderBy(F.desc("score")).first()["doc_id"]
    assert found == boosted == 2
    assert len(words) == 10 and not words.is_empty
    assert top.extract(10, "unheard of words: zzz").terms() != [] and top.extract(5, "zzz qqq").is_empty
    assert top.extract(5, "zzz").into_boosted_query(1.0) == Nothing()


def test_keywords_count_once_a_field_and_can_be_refused(quotes):
    both = TopTerms(quotes, ["source", "quote"]).extract(10, "marley")
    assert {(f, t) for f, t, _ in both.terms()} == {("source", "marley"), ("quote", "marley")}
    longer = TopTerms(quotes, ["quote"]).extract_from_doc(50, 0, lambda term, tf, df, n: (F.length(term) > 4) & (tf > 1) & (df < n))
    assert [t for _, t, _ in longer.terms()] == ["marley"]
    with pytest.raises(LookupError):
        TopTerms(quotes, ["nope"])
