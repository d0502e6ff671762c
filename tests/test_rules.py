"""Text rules, answer checks, scores and passage search on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers, evaluate, scoring


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, clean", [("a\tb", "a\tb"), ("a \t b", "a b"), ("a \n\t b", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("﻿  a \n\n", "a"), ("", ""), (None, None)])
def test_tidy(spark, raw, clean):
    assert one(spark, raw, T.tidy) == clean


@pytest.mark.parametrize("raw, clean", [("<p>a</p>b", "a\nb"), ("a<BR/>b<i>c</i>", "a\nbc"), ("&amp;lt;b&gt;", "<b>"), ("&amp;nbsp;", "&nbsp;"), ("a&nbsp;&#39;b&quot;", "a 'b\"")])
def test_strip_html(spark, raw, clean):
    assert one(spark, raw, T.strip_html) == clean


@pytest.mark.parametrize(
    "url, slug",
    [
        ("https://h.org/x/page.php", "page"),
        ("https://h.org/generateVerse.php?id=12", "verse-12"),
        ("https://h.org/generateVerse.php?b=1&id=12#id=3", "verse-12"),
        ("https://h.org/generateVerse.php?id=a1", "generateVerse"),
        ("https://h.org/generateverse.php?id=1", "generateverse"),
        ("https://h.org/a/Seneksar.php?q=7&q=8", "day-7"),
        ("https://h.org/seneksar.php?id=7", "seneksar"),
        ("https://h.org", ""),
        ("https://h.org/a/b/", "b"),
        (None, None),
    ],
)
def test_slug(spark, url, slug):
    assert one(spark, url, T.slug) == slug


@pytest.mark.parametrize(
    "answer, open_end",
    [("Done.", False), ("Go on,", True), ("so:**", True), ("wait...", True), ("left -", True), ("a dash —", False), ("this And.", True), ("``", True), (" ", True), (None, True), ("42", False), ("land", False)],
)
def test_incomplete(spark, answer, open_end):
    assert one(spark, answer, lambda c: answers.incomplete(c, ["and"])) is open_end


def test_loose(spark):
    for word in ("سلام", "سماء", "اب", "ااااب كتاب", "plain words"):
        assert one(spark, word, T.loose) == scoring.loose(word)
    assert scoring.loose("كتاب") == "كتب"


SCORES = "chunk_id string, title string, section string, search_text string, domain string, aliases array<string>"


def scores(spark, row, query, stop=frozenset()):
    got = scoring.scored(spark.createDataFrame([row], SCORES), [(1, query)], stop).first()
    return got and (got.score, got.structured)


def test_phrases_count_in_full_in_enrichment_alone(spark):
    # title: query 20, two tokens 5 each, phrase 10 and 6; coverage 2 * 12 + 80; title 40; broad title 15
    assert scores(spark, ("c", "red door", "", "", "x", None), "red door") == (20 + 10 + 16 + 104 + 40 + 15, False)
    # aliases: query 36, tokens 9 each, phrase 36 and 18; coverage 104; no title
    assert scores(spark, ("c", "", "", "", "bible", ["red door"]), "red door") == (36 + 18 + 54 + 104, True)
    assert scores(spark, ("c", "", "", "", "other", ["red door"]), "red door") is None


def test_titles_by_their_variants(spark):
    # three of the title's words, "the" is none; two of them asked for: 18 * 2 / 3; the section's word stops the broad title
    got = scores(spark, ("c:3", "the red door open", "red", "", "x", None), "red door", frozenset(["the"]))
    assert got[0] == pytest.approx(20 + 10 + 16 + 10 // 4 + 104 + 12)
    # all variants of the title stand in the query, in another order: 15 / (3 + 1)
    got = scores(spark, ("c:3", "door red", "", "", "x", None), "red big door")
    assert got[0] == pytest.approx(10 + 2 * 12 + 40 + 15 / 4)


def test_loose_and_weak_words(spark):
    # the loose form alone: 20 // 5; coverage of the one group 92
    assert scores(spark, ("c", "كتب", "", "", "x", None), "كتاب") == (4 + 92, False)
    # a word that tells little: a quarter of 20 // 4, the whole query 20; coverage 92; title 40, broad 15
    assert scores(spark, ("c", "يسوع", "", "", "x", None), "يسوع") == (20 + 1.25 + 92 + 55, False)


def test_passages_of_any_length(spark):
    docs = [(i, t) for i, t in enumerate(["one two three four five six seven eight", "xone two three fourx", "two  three", "", None, "a one two three four five six sevens"])]
    found = ["one two three four five six seven", "one two three four five six", "one two three", "two three", "two", "wo", "", "absent words here", None, "e two three f", "three four"]
    p = spark.createDataFrame(list(enumerate(found)), "item_id int, passage string")
    d = spark.createDataFrame([*docs, docs[0]], "doc_id int, text string")
    got = {r.item_id: (r.documents, r.first_doc) for r in evaluate.holders(p, d).collect()}
    held = {i: [k for k, t in docs if t is not None and x is not None and x in t] for i, x in enumerate(found)}
    assert got == {i: (len(k), min(k)) for i, k in held.items() if k}
    assert evaluate.holders(p.limit(0), d).count() == 0 and evaluate.holders(p, d.limit(0)).count() == 0
