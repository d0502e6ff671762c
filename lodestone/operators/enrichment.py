"""Entity enrichment of chunks: names from markdown tables and from lines with a colon, annotations of four levels, limits.

A table's cells count as names; once a row names entity columns, these columns alone do, until another row names some. The scan is
a window over a chunk's lines: the last header at or before a line is its header. Names are cut at commas and at a single joining
letter, lose a leading office, and must look like names (up to five words with a letter of the script, no digit, no heading or
filler). Annotations of a chunk are those of its document, of its section by name, of its section by number, and of the chunk, in
that order. Nulls are empty; repeated values count once, at their first place; an empty table gives an empty result. A chunk's lines
are one window partition, so memory is bounded by a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions import text as T

FIELDS = ("entities", "events", "places", "aliases", "symbols", "themes", "enriched_terms")
# How many values a field keeps, and how many characters the detail text.
LIMITS = {"entities": 24, "events": 24, "places": 16, "aliases": 24, "symbols": 8, "themes": 8, "enriched_terms": 40}
DETAIL = 1000
# Filler words, first words that are no alias, headings that are no names, headers of columns that hold names.
FILLER = "في, من, عن, على, الى, إلى, مع, ده, دي, دا, كان, كانت, فيه, ربنا, الله, الرب, السيد, المسيح, الكتاب, المقدس, اللي, الذي, التي, هذا, هذه, بعد, قبل, كل, لكن, عشان, انه, إنه, لما, لمّا"
NO_ALIAS = "ابن, بن, بنت, من, الى, الي, ال, ملكي"
CONCEPTS = "هدف, اهداف, ظروف, مفاتيح, فهم, السفر, مقدمه, مدخل, ملخص, فكره, اساسيه, شعار, ترتيب, تقسيم, اقسام, موضوع, محور, البركه, الشعب, الارض, السلام, الخطيه, التوبه, الانقاذ, الذل, الوعد, وعد, تغيير, كرم, تواضع, عدل, رحمه, الله, الختان"
HEADINGS = "هدف السفر, ظروف الكتابه, مفاتيح فهم السفر, فكره السفر, مقدمه السفر, ترتيب السفر, تقسيم السفر"
HEADERS = "الاسم, القاضي, النبي, النبيه, الرسول, الرسل, التلميذ, التلاميذ, الملك, الملكه, الشخص, الشخصيه"
LOW_VALUE = r"^(?:اصحاح|صلاه|قال|سنه|جدا|عن السفر|ترتيب السفر|شعار السفر|ملخص سريع|تفسير وتاملات|ايات وتاملات|نتعلم ايه)$|^ملخص السفر|(?:^|\s)(?:اصحاحات?|ملخص|سريع)(?:$|\s)|^\d+\s+"
OFFICES = (r"^(?:قائد|قايد)\s+(?:الجيش|جيش)\s+", r"^(?:الملك|ملك)\s+")
COMMA, JOINER, NOT_CORE = "،", "و", ("اصحاح", "ملخص")


@dataclass(frozen=True)
class Script:
    """The rules of a language; `letters` and `name` are patterns of a letter that a name must hold and of a line's name."""

    letters: str = r"[\x{0621}-\x{064A}]"
    name: str = r"^[\p{IsArabic}\s]+$"
    headers: tuple[str, ...] = tuple(L.words(HEADERS, T.INGEST_DIACRITICS))
    filler: tuple[str, ...] = tuple(L.words(FILLER, T.INGEST_DIACRITICS))
    concepts: tuple[str, ...] = tuple(L.words(CONCEPTS, T.INGEST_DIACRITICS))
    headings: tuple[str, ...] = tuple(L.words(HEADINGS, T.INGEST_DIACRITICS))
    compose: bool = True

    def normal(self, x: Column) -> Column:
        return T.normalize_ingest(x, self.compose)


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def is_name(n: Column, s: Script) -> Column:
    """Whether a normalized value looks like a name."""
    w = _words(n)
    listed = lambda x, of: x.isin(*of) if of else F.lit(False)
    heading = listed(n, s.headings) | listed(F.get(w, F.lit(0)), s.concepts)
    return F.size(w).between(1, 5) & n.rlike(s.letters) & ~n.rlike(r"[0-9]") & ~n.rlike(LOW_VALUE) & ~heading & F.exists(w, lambda t: (F.length(t) >= 3) & ~listed(t, s.filler))


def is_core(n: Column) -> Column:
    """Whether a normalized value may stand in an enrichment field."""
    bad = n.rlike(LOW_VALUE)
    for x in NOT_CORE:
        bad = bad | F.contains(n, F.lit(x))
    return F.size(_words(n)).between(1, 4) & ~bad


def cut_names(cell: Column) -> Column:
    """The names of a cell, without their offices."""

    def bare(x: Column) -> Column:
        for office in OFFICES:
            x = F.regexp_replace(x, office, "")
        return F.trim(x)

    return F.transform(F.split(cell, rf"\s+{JOINER}\s+|\s*{COMMA}\s*"), bare)


def names(chunks: DataFrame, s: Script = Script()) -> DataFrame:
    """(chunk_id, names): of chunks (chunk_id, text) those that have any, table rows before colon lines, in their order."""
    lines = chunks.select("chunk_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    rows = lines.filter(F.col("raw").startswith("|") & F.col("raw").endswith("|"))
    cells = F.filter(F.transform(F.split("raw", r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: (c != "") & ~F.regexp_replace(c, r"\s+", "").rlike(r"^-+$"))
    rows = rows.select("chunk_id", "line", cells.alias("cells")).filter(F.size("cells") > 0)
    each = rows.select("chunk_id", "line", F.posexplode("cells").alias("at", "cell")).withColumn("head", s.normal(F.col("cell")).isin(*s.headers) if s.headers else F.lit(False))
    heads = F.collect_set(F.when(F.col("head"), F.col("at"))).over(Window.partitionBy("chunk_id", "line"))
    each = each.withColumn("own", heads)
    last = F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(Window.partitionBy("chunk_id").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("columns", last).filter((F.size("own") == 0) & (F.col("columns").isNull() | F.array_contains("columns", F.col("at"))))
    table = each.select("chunk_id", F.lit(0).alias("kind"), "line", "at", F.posexplode(cut_names(F.col("cell"))).alias("part", "name"))
    colon = F.greatest(F.instr("raw", ":"), F.instr("raw", "："))
    said = lines.select("chunk_id", "line", F.trim(F.col("raw").substr(F.lit(1), colon - 1)).alias("whole"), F.regexp_replace(F.get(F.split("raw", "[:：]"), F.lit(0)), r"\s+$", "").alias("first"), colon.alias("colon"))
    # `colon` counts from 1: a name of 1 to 80 characters stands before it
    said = said.filter((F.col("colon") > 1) & (F.col("colon") <= 81)).withColumn("n", s.normal(F.col("whole"))).filter(F.col("whole").rlike(s.name) & is_name(F.col("n"), s))
    said = said.select("chunk_id", F.lit(1).alias("kind"), "line", F.lit(0).alias("at"), F.posexplode(cut_names(F.col("first"))).alias("part", "name"))
    found = table.union(said).withColumn("n", s.normal(F.col("name"))).filter(is_name(F.col("n"), s))
    grouped = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("kind", "line", "at", "part", "name"))).alias("f"))
    return grouped.select("chunk_id", F.col("f.name").alias("names"))


def annotations_for(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(chunk_id, field, values): annotations (slug, level, key, field, values) of chunks (chunk_id, slug, section, number). Levels:
    file (key ''), section (its name or number), chunk (its number)."""
    key = lambda n, level, k: F.struct(F.lit(n).alias("order"), F.lit(level).alias("level"), k.cast("string").alias("key"))
    keys = F.array(key(0, "file", F.lit("")), key(1, "section", F.col("section")), key(2, "section", F.col("number")), key(3, "chunk", F.col("number")))
    asked = chunks.select("chunk_id", "slug", F.inline(keys))
    given = annotations.select("slug", "level", "key", "field", F.posexplode("values").alias("at", "value")).withColumn("value", F.trim("value")).filter("value != ''")
    found = asked.join(given, ["slug", "level", "key"]).groupBy("chunk_id", "field").agg(F.array_sort(F.collect_list(F.struct("order", "at", "value"))).alias("v"))
    return found.select("chunk_id", "field", F.array_distinct("v.value").alias("values"))


def enriched(chunks: DataFrame, annotations: DataFrame | None = None, s: Script = Script(), limits: dict = LIMITS) -> DataFrame:
    """chunk_id with the seven fields and `detail_search_text`, for every chunk (chunk_id, text; slug, section, number with
    annotations)."""
    none = F.array().cast("array<string>")
    base = chunks.select("chunk_id").join(names(chunks, s), "chunk_id", "left")
    if annotations is not None:
        by = annotations_for(chunks, annotations).groupBy("chunk_id").pivot("field", list(FIELDS)).agg(F.first("values"))
        base = base.join(by, "chunk_id", "left")
    base = base.select("chunk_id", F.coalesce("names", none).alias("names"), *[(F.coalesce(F.col(c), none) if annotations is not None else none).alias(c) for c in FIELDS])
    # values as rows: their normal form needs the vectorized function, which lambdas can't call
    short = F.filter(F.concat("entities", "names"), lambda e: (F.size(F.split(e, r"\s+")) <= 3) & F.exists(F.split(e, r"\s+"), lambda t: F.length(t) >= 3))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), (short if c == "entities" else F.col(c)).alias("values")) for c in FIELDS])
    rows = base.select("chunk_id", F.inline(fields)).select("chunk_id", "field", F.posexplode("values").alias("at", "value")).withColumn("n", s.normal(F.col("value")))
    kept = rows.filter(is_core(F.col("n")))
    lists = kept.groupBy("chunk_id").pivot("field", list(FIELDS)).agg(F.array_sort(F.collect_list(F.struct("at", "value", "n"))))
    limit = lambda c: F.slice(F.array_distinct(F.coalesce(F.col(f"{c}.value"), none)), 1, limits[c])
    out = base.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in FIELDS]).join(lists, "chunk_id", "left")
    first = {c: limit(c) for c in ("entities", "events", "places", "symbols", "themes")}
    entry = F.array().cast("array<struct<at:int,value:string,n:string>>")

    def normal_of(c: str) -> Column:
        return F.transform(F.filter(F.coalesce(F.col(c), entry), lambda x: F.array_contains(first[c], x["value"])), lambda x: x["n"])

    out = out.withColumns({f"{c}_n": normal_of(c) for c in first})
    known = F.flatten(F.array(*[F.col(f"{c}_n") for c in first]))
    more = F.slice(F.array_distinct(F.transform(F.filter(F.coalesce(F.col("enriched_terms"), entry), lambda x: ~F.array_contains(known, x["n"])), lambda x: x["value"])), 1, limits["enriched_terms"])
    useful = lambda t: (F.length(t) >= 3) & ~t.isin(*L.words(NO_ALIAS, T.INGEST_DIACRITICS), *s.filler)
    short_forms = F.flatten(F.transform(F.filter("entities_n", lambda n: F.size(_words(n)).between(2, 5)), lambda n: F.concat(F.filter(F.slice(_words(n), 1, 1), useful), F.array(F.array_join(_words(n), "")))))
    core = F.filter(short_forms, is_core)
    alias = F.slice(F.array_distinct(F.concat(F.coalesce(F.col("aliases.value"), none), core)), 1, limits["aliases"])
    detail = F.array_join(F.array_distinct(F.concat("_entities", "_events", "_places", "_aliases")), "\n")
    done = out.select("chunk_id", *[x.alias(c) for c, x in first.items()], alias.alias("aliases"), more.alias("enriched_terms"), detail.alias("_detail"))
    return done.select("chunk_id", *FIELDS, F.substring(s.normal(F.col("_detail")), 1, DETAIL).alias("detail_search_text"))
