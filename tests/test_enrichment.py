"""Entity enrichment: tables whose header picks columns, colon lines, four levels of annotations, limits."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import enrichment as E

TABLE = "| يوسف و مريم | ملك داود |\n| الاسم | العمل |\n|---|---|\n| هابيل | راعي |\n| قايين، شيث | فلاح |\n| الملك | المكان |\n| الملك شاول | اورشليم |\nكلام\n| بطرس | متى |"


def names(spark, text):
    rows = E.names(spark.createDataFrame([("c", text)], "chunk_id string, text string")).collect()
    return rows[0].names if rows else []


@pytest.mark.parametrize(
    "text, want",
    [
        (TABLE, ["يوسف", "مريم", "داود", "هابيل", "قايين", "شيث", "شاول", "بطرس"]),
        ("موسى: النبي", ["موسى"]),
        ("  موسى و هارون ：اخوان", ["موسى", "هارون"]),
        ("هدف السفر: كذا\nمقدمه الكتاب: كذا\nملخص: كذا\nabc: x\n: x\nسنه 3: x", []),
        ("| 12 ملك | من | abc | ترتيب السفر |", []),
        ("| قائد الجيش يشوع |", ["يشوع"]),
        ("|  |\n|---|", []),
        ("", []),
        (None, []),
    ],
)
def test_names(spark, text, want):
    assert names(spark, text) == want


def test_annotations_come_from_four_levels(spark):
    chunks = spark.createDataFrame([("a:0", "a", "S", 0, ""), ("a:1", "a", "T", 1, ""), ("b:0", "b", None, 0, "")], "chunk_id string, slug string, section string, number int, text string")
    given = spark.createDataFrame([("a", "file", "", "events", ["x", " y "]), ("a", "section", "S", "events", ["z", "x"]), ("a", "section", "0", "events", ["s0"]), ("a", "chunk", "0", "events", ["c0", ""]), ("a", "chunk", "1", "places", ["p"]), ("b", "section", "T", "events", ["no"])], "slug string, level string, key string, field string, values array<string>")
    got = {(r.chunk_id, r.field): r["values"] for r in E.annotations_for(chunks, given).collect()}
    assert got == {("a:0", "events"): ["x", "y", "z", "s0", "c0"], ("a:1", "events"): ["x", "y"], ("a:1", "places"): ["p"]}


def test_fields_are_limited_and_without_repeats(spark):
    chunks = spark.createDataFrame([("a:0", "a", "S", 0, "| سمعان بطرس |\n| بن يامين |"), ("a:1", "a", "S", 1, None)], "chunk_id string, slug string, section string, number int, text string")
    many = [f"مكان{c}" for c in "ابتثجحخدذرزسشصضطظعغفقكلمن"]
    given = spark.createDataFrame([("a", "chunk", "0", "places", many + ["ملخص سريع"]), ("a", "chunk", "0", "enriched_terms", ["سِمعان بطرس", "كلمه", "كلمه", "a b c d e"]), ("a", "chunk", "0", "aliases", ["صخره"])], "slug string, level string, key string, field string, values array<string>")
    got = {r.chunk_id: r for r in E.enriched(chunks, given).collect()}
    a = got["a:0"]
    assert a.entities == ["سمعان بطرس", "بن يامين"] and a.places == many[:16] and a.enriched_terms == ["كلمه"]
    assert a.aliases == ["صخره", "سمعان", "سمعانبطرس", "بنيامين"]
    assert a.detail_search_text.startswith("مكانا مكانب") and "صخره" in a.detail_search_text and len(a.detail_search_text) <= 1000
    assert got["a:1"].entities == [] and got["a:1"].aliases == [] and got["a:1"].detail_search_text == ""
    assert E.enriched(chunks.filter("false"), given).count() == 0
    alone = E.enriched(chunks.select("chunk_id", "text")).orderBy("chunk_id").select("entities", F.size("events")).collect()
    assert [tuple(r) for r in alone] == [(["سمعان بطرس", "بن يامين"], 0), ([], 0)]
