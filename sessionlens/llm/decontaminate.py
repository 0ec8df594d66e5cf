"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Texts become words, numbers and sentence ends.  A number becomes ``<number>``, a
unit behind a number ``<unit>``, a capitalised word inside a sentence
``<name>``; all else is lower-cased.  Windows of ``width`` such tokens are
templates: those of the benchmark are hash-joined with those of the documents,
so a question whose numbers, names or units were changed still meets its item.

A hit needs consistent slots: along one alignment of document and item, every
value of the item must stand for one value of the document (two values of the
item may have become the same one).  An item counts as contained when
consistent windows of one alignment cover ``cover`` of its windows.

Only windows of the benchmark with enough literal words take part, so that rows
of names or numbers do not match each other.  The distinct hashes of the
benchmark's windows are broadcast when a count shows at most ``broadcast_most``
of them (8 bytes each); a larger benchmark is joined by shuffling, on the hash
and a part of the row, so that no window is in one task.  A window of a
document moves as three numbers; the words of its slots are read again from the
few documents with a hit.

``UNITS`` are words per language; ``languages`` selects them.  Names are told
by capitals, so a noun of a language that capitalises all nouns is a slot.

Defined cases: null or short texts have no windows; an item shorter than a
window is one window of its own length; an item without a window of enough
literal words is not searched; repeated items and documents are each judged;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col

from sessionlens.llm.common import free_name, keep

TOKENS = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+|[.!?\n]"
#: Units of measure that may follow a number.
UNITS = {
    "en": ("mm cm m km mg g kg t ml l s ms min h hour hours minute minutes second seconds day days week weeks month months year years "
           "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams "
           "kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons percent dollar dollars euro euros cent cents "
           "degree degrees kmh mph hz khz mhz w kw v kv a j kj").split(),
    "de": "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad".split(),
    "es": "segundo segundos minuto minutos hora horas metro metros kilo kilos litro litros semana semanas mes meses grado grados".split(),
    "fr": "seconde secondes heure heures jour jours semaine semaines mois mètre mètres kilomètre kilomètres litres degré degrés".split(),
}
SALTS = 16  # tasks that share the documents' windows of one hash where the benchmark is not broadcast


MARKS = (".", "!", "?", "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; a column would be copied to each of its uses."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def plain(words: Column) -> Column:
    """Without the sentence ends."""
    return F.filter(words, lambda w: ~w.isin(*MARKS))


def template(raw: Column, languages: Sequence[str] = tuple(UNITS)) -> Column:
    """Placeholders of the tokens, without the sentence ends."""
    units = sorted({unit for language in languages for unit in UNITS[language]})
    number = lambda w: F.substring(w, 1, 1).between("0", "9")

    def slot(w: Column, i: Column) -> Column:
        before, small, head, tail = raw[i - 1], F.lower(w), F.substring(w, 1, 1), F.substring(w, 2, 1 << 30)
        return F.when(number(w), "<number>") \
            .when(small == w, F.when((i > 0) & number(before) & w.isin(units), "<unit>").otherwise(w)) \
            .when((i > 0) & (F.lower(tail) == tail) & (tail != "") & (F.lower(head) != head) & ~before.isin(*MARKS), "<name>").otherwise(small)

    return plain(F.transform(raw, slot))


def window_hashes(text: Column, width: int, languages: Sequence[str] = tuple(UNITS)) -> Column:
    """Hash of each window of ``width`` placeholders, in order."""
    def hashes(slots: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(slots) - (width - 1)), lambda i: F.xxhash64(F.slice(slots, i, width)))
        return F.when(F.size(slots) >= width, each).otherwise(F.array().cast("array<bigint>"))

    return let(tokens(text), lambda raw: let(template(raw, languages), hashes))


def benchmark_windows(benchmark: DataFrame, width: int, literals: int, item: str = "item_id", text: str = "text",
                      languages: Sequence[str] = tuple(UNITS)) -> DataFrame:
    """Windows of the items: item, number of windows, width, place, hash, words and placeholders."""
    items = benchmark.select(col(item).alias("_item"), tokens(col(text)).alias("_tokens")) \
        .select("_item", plain(col("_tokens")).alias("_raw"), template(col("_tokens"), languages).alias("_slot")) \
        .withColumn("_width", F.least(F.lit(width), F.size("_slot"))).where("_width > 0")
    each = items.withColumn("_at", F.explode(F.expr("sequence(0, size(_slot) - _width)"))) \
        .withColumns({"_words": F.expr("slice(_raw, _at + 1, _width)"), "_kinds": F.expr("slice(_slot, _at + 1, _width)"),
                      "_count": F.expr("size(_slot) - _width + 1")}).withColumn("_hash", F.xxhash64("_kinds"))
    return each.where(F.expr(f"size(filter(_kinds, w -> not startswith(w, '<'))) >= {literals}")) \
        .select("_item", "_count", "_width", "_at", "_hash", "_words", "_kinds")


def join_windows(ours: DataFrame, theirs: DataFrame, small: bool) -> DataFrame:
    """Windows of documents that the benchmark has; beyond the bound of a broadcast each hash is shared by ``SALTS`` tasks."""
    on = ["_hash", "_width"]
    if small:
        return ours.join(F.broadcast(theirs), on)
    spread = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return ours.withColumn("_salt", F.pmod(F.hash("_row", "_place"), F.lit(SALTS))).join(spread.hint("shuffle_merge"), [*on, "_salt"]).drop("_salt")


def window_hits(rows: DataFrame, wanted: DataFrame, width: int, small: bool, languages: Sequence[str] = tuple(UNITS)) -> DataFrame:
    """Windows of ``rows`` (``_row``, ``_text``) among the ``wanted``: row, place, width and hash."""
    every = rows.select("_row", F.posexplode(window_hashes(col("_text"), width, languages)).alias("_place", "_hash"))
    return join_windows(every.withColumn("_width", F.lit(width)), wanted.where(col("_width") == width), small) \
        .select("_row", "_place", "_width", "_hash")


def join_rows(docs: DataFrame, rows: DataFrame, how: str, key: str, text: str, broadcast_most: int) -> DataFrame:
    """Documents that are (``left_semi``) or are not (``left_anti``) among the distinct ``_row`` of ``rows``."""
    name = free_name(docs, "_leak")
    among = keep(rows.select(col("_row").alias(name)).distinct(), "rows")
    return docs.join(F.broadcast(among) if among.count() <= broadcast_most else among, F.xxhash64(docs[key], docs[text]) == among[name], how)


def find_items(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               width: int = 8, literals: int = 4, cover: float = 0.3, broadcast_most: int = 1_000_000,
               languages: Sequence[str] = tuple(UNITS)) -> DataFrame:
    """Pairs of a document and an item it contains: ``_row`` (hash of id and text), key, item, ``windows``, ``coverage``, ``exact``."""
    windows = keep(benchmark_windows(benchmark, width, literals, item, item_text, languages), "items")
    wanted = keep(windows.select("_width", "_hash").distinct(), "wanted")
    small = wanted.count() <= broadcast_most
    rows = docs.select(F.xxhash64(col(key), col(text)).alias("_row"), col(key).alias("_id"), col(text).alias("_text"))
    hits = docs.select(F.lit(0).cast("bigint").alias("_row"), F.lit(0).alias("_place"), F.lit(0).alias("_width"),
                       F.lit(0).cast("bigint").alias("_hash")).where(F.lit(False))
    for length in sorted(r["_width"] for r in wanted.select("_width").distinct().collect()):  # ``width`` values at most
        hits = hits.union(window_hits(rows, wanted, length, small, languages))
    hits = keep(hits, "hits")
    # the words of the windows, from the documents that have any
    held = hits.groupBy("_row").agg(F.collect_set(F.struct("_width", "_place", "_hash")).alias("_hits"))
    texts = join_rows(rows, hits, "left_semi", "_id", "_text", broadcast_most).dropDuplicates(["_row"])
    found = let(plain(tokens(col("_text"))), lambda words: F.transform("_hits", lambda h: F.struct(
        h["_width"].alias("_width"), h["_place"].alias("_place"), h["_hash"].alias("_hash"), F.slice(words, h["_place"] + 1, h["_width"]).alias("_found"))))
    said = texts.join(held, "_row").select("_row", "_id", F.explode(found).alias("_hit")).select("_row", "_id", "_hit.*")
    met = join_windows(said, windows, small=False) \
        .select("_row", "_id", "_item", "_count", "_at", (col("_place") - col("_at")).alias("_shift"),
                F.expr("transform(filter(arrays_zip(_kinds, _words, _found), x -> startswith(x._kinds, '<')), "
                       "x -> struct(x._words as said, x._found as found))").alias("_pairs"))
    aligned = met.groupBy("_row", "_id", "_item", "_count", "_shift").agg(
        F.countDistinct("_at").alias("windows"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"))
    one_value_each = F.expr("size(array_distinct(transform(_pairs, p -> p.said))) = size(_pairs)")
    good = aligned.where(one_value_each).where(col("windows") >= F.lit(cover) * col("_count"))
    return good.groupBy("_row", "_id", "_item").agg(
        F.max("windows").alias("windows"), F.max(col("windows") / col("_count")).alias("coverage"),
        F.max(F.expr("forall(_pairs, p -> p.said = p.found)")).alias("exact")) \
        .withColumnRenamed("_id", key).withColumnRenamed("_item", item)


def without_items(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", broadcast_most: int = 1_000_000) -> DataFrame:
    """The documents that contain no item."""
    return join_rows(docs, found, "left_anti", key, text, broadcast_most)
