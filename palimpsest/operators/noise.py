"""Corruption of clean text as recognisers do it, with hashed draws: exactly repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..functions.scripts import TAMIL, ScriptProfile
from .sampling import draw, resampled

#: Effective consonant confusions; fixed values.
CONSONANTS = {
    "ழ": "ள", "ள": "ல", "ண": "ன", "ன": "ண", "ற": "ர", "ர": "ற", "ந": "த", "ம": "ந", "க": "ச", "ங": "க", "ச": "க", "ஞ": "ச", "வ": "ல", "ப": "ல",
    "ல": "ள", "ஐ": "ஜ", "ஜ": "ஐ", "த": "து",
}
#: Short and long vowel signs.
VOWELS = {"ி": "ீ", "ீ": "ி", "ு": "ூ", "ூ": "ு", "ெ": "ே", "ே": "ெ", "ொ": "ோ", "ோ": "ொ"}
#: Signs that recognisers make up.
SPURIOUS = ["ு", "ி", "்", "ூ"]
PULLI = "்"
VOWEL_SIGNS = "[ா-ௌ]"
#: Kinds of error and their weights, in hundredths.
WEIGHTS = [
    ("consonant", 25), ("short_long", 20), ("pulli_drop", 15), ("matra_drop", 10), ("space_insert", 5), ("space_delete", 5), ("spurious_prefix", 10), ("solitary_mark", 10),
]
#: Substitutions of the register noise; fixed values. A string holds a letter's alternatives in order, as the lookup picks one by its place.
CONFUSIONS = {
    "க": "சவ", "ச": "கஜ", "ட": "ண", "ண": "ட", "த": "ந", "ந": "தர", "ப": "வ", "ம": "ன", "ன": "மண", "ர": "ற", "ற": "ர", "ல": "வன", "வ": "பல", "ழ": "ள", "ள": "ழன",
    "ா": "ி", "ி": "ாீ", "ீ": "ி", "ு": "ூ", "ூ": "ு", "ே": "ைொ", "ை": "ே", "ொ": "ோ", "ோ": "ொ",
}
LEAK_TAGS = ["mark", "sub", "sup"]
ERROR_RATES = {"modern": 0.03, "classical": 0.05, "premodern": 0.08}
INJECT_RATES = {"modern": 0.07, "classical": 0.12, "premodern": 0.15}
DEFAULT_ERROR_RATE, DEFAULT_INJECT_RATE = 0.05, 0.07


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def chars(c: Column) -> Column:
    return F.filter(F.split(c, "", -1), lambda x: x != "")


def _pick(options: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def corrupt(c: Column, key: Column, rate: float = 0.15, seed: int = 42) -> Column:
    """Each character errs by itself with probability ``rate``; a kind of error that does not apply changes nothing.

    The kind and the sign are drawn where an error falls only.
    """
    bounds, low = [], 0
    for kind, weight in WEIGHTS:
        low += weight
        bounds.append((kind, low / 100))

    def changed(kind: Column, x: Column, i: Column, at: Column, source: Column) -> Column:
        before = F.when(i > 0, F.get(source, i - 1))
        mark = _pick(SPURIOUS, draw(seed, key, at, F.lit("mark")))
        after = {
            "consonant": F.coalesce(_lookup(CONSONANTS)[x], x),
            "short_long": F.coalesce(_lookup(VOWELS)[x], x),
            "pulli_drop": F.when(x == PULLI, "").otherwise(x),
            "matra_drop": F.when(x.rlike(VOWEL_SIGNS), "").otherwise(x),
            "space_insert": F.when(T.has_script(x), F.concat(x, F.lit(" "))).otherwise(x),
            "space_delete": F.when((x == " ") & (i > 0) & (i < F.size(source) - 1), "").otherwise(x),
            "spurious_prefix": F.when((i == 0) | (before == " "), F.concat(mark, x)).otherwise(x),
            "solitary_mark": F.when(x == " ", F.concat(F.lit(" "), mark, F.lit(" "))).otherwise(x),
        }
        out = F.when(F.lit(False), x)
        for name, high in bounds:
            out = out.when(kind < high, after[name])
        return out

    def one(x: Column, i: Column, source: Column) -> Column:
        at = i.cast("string")
        return F.when(draw(seed, key, at, F.lit("err")) > rate, x).otherwise(let(draw(seed, key, at, F.lit("kind")), lambda kind: changed(kind, x, i, at, source)))

    return F.when(T.strip(c) == "", c).otherwise(let(chars(c), lambda source: F.array_join(F.transform(source, lambda x, i: one(x, i, source)), "")))


def changed_pairs(texts: DataFrame, n: int, rate: float = 0.15, seed: int = 42, least_edits: int = 1, profile: ScriptProfile = TAMIL) -> DataFrame:
    """n pairs (key, input, target) of corrupted and clean texts, drawn with replacement if there are fewer texts; blank ones, those without script and pairs that did not change enough are left out."""
    usable = texts.where((T.strip(F.col("text")) != "") & T.has_script(F.col("text"), profile))
    drawn = resampled(usable, n, seed, "key").withColumn("key", F.concat_ws("#", "key", F.col("copy").cast("string"))).drop("copy")
    made = drawn.select("key", corrupt(F.col("text"), F.col("key"), rate, seed).alias("input"), F.col("text").alias("target"))
    return made.where((F.col("input") != F.col("target")) & T.edits_at_least(F.col("input"), F.col("target"), least_edits))


def register_noise(c: Column, key: Column, rate: Column, seed: int | Column = 42, letters: str = r"\x{0B80}-\x{0BFF}", table: dict[str, str] | None = None) -> Column:
    """max(1, int(n * rate)) errors at the script characters with the lowest draws, 3 in 10 texts with a dense patch besides.

    An error substitutes (75 %, only what the table holds), swaps with the next character (12 %), deletes (8 %) or doubles (5 %).
    """
    table = CONFUSIONS if table is None else table

    def by_draw(tag: str, where: Column) -> Column:
        drawn = F.transform(where, lambda i: F.struct(draw(seed, key, i.cast("string"), F.lit(tag)).alias("u"), i.alias("i")))
        return F.transform(F.array_sort(drawn), lambda s: s["i"])

    def dense(places: Column) -> Column:
        n = F.size(places)
        width = (15 + F.floor(draw(seed, key, F.lit("width")) * 11)).cast("int")
        start = (F.floor(draw(seed, key, F.lit("start")) * (F.greatest(F.lit(0), n - width) + 1)) + 1).cast("int")
        picked = lambda w: F.slice(by_draw("burst", w), F.lit(1), F.greatest(F.lit(2), (F.size(w) * rate * 3).cast("int")))
        return F.when((n >= 10) & (draw(seed, key, F.lit("burst")) < 0.30), let(F.slice(places, start, width), picked)).otherwise(F.array().cast("array<int>"))

    def hits(places: Column) -> Column:
        most = F.greatest(F.lit(1), (F.size(places) * rate).cast("int"))
        both = lambda burst: F.array_union(burst, F.slice(by_draw("plain", F.array_except(places, burst)), F.lit(1), most))
        return F.reverse(F.array_sort(let(dense(places), both)))

    def edit(acc: Column, i: Column) -> Column:
        at = i.cast("string")
        kind, own, more = draw(seed, key, at, F.lit("type")), F.get(acc, i), F.get(acc, i + 1)
        options = _lookup(table)[own]
        which = (F.floor(draw(seed, key, at, F.lit("which")) * F.char_length(options)) + 1).cast("int")
        head, tail = F.slice(acc, F.lit(1), i), F.slice(acc, i + 2, F.size(acc))
        return (
            F.when(kind < 0.75, F.when(options.isNull(), acc).otherwise(F.concat(head, F.array(F.substring(options, which, F.lit(1))), tail)))
            .when(kind < 0.87, F.when(more.isNull(), acc).otherwise(F.concat(head, F.array(more, own), F.slice(acc, i + 3, F.size(acc)))))
            .when(kind < 0.95, F.concat(head, tail))
            .otherwise(F.concat(head, F.array(own, own), tail))
        )

    def whole(source: Column) -> Column:
        places = F.filter(F.transform(source, lambda x, i: F.when(x.rlike(f"[{letters}]"), i)), lambda i: i.isNotNull())
        return F.array_join(F.aggregate(let(places, hits), source, edit), "")

    return F.when(c.rlike(f"[{letters}]"), let(chars(c), whole)).otherwise(c)


def inject_tags(c: Column, key: Column, seed: int = 42, letters: str = r"\x{0B80}-\x{0BFF}") -> Column:
    """One to three leak tags around script characters; 3 in 10 take in the next one too."""

    def hits(places: Column) -> Column:
        most = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.size(places) / 50).cast("int")))
        count = (1 + F.floor(draw(seed, key, F.lit("tags")) * most)).cast("int")
        order = F.array_sort(F.transform(places, lambda i: F.struct(draw(seed, key, i.cast("string"), F.lit("tag")).alias("u"), i.alias("i"))))
        return F.reverse(F.array_sort(F.transform(F.slice(order, F.lit(1), count), lambda s: s["i"])))

    def wrap(acc: Column, i: Column) -> Column:
        at = i.cast("string")
        tag = _pick(LEAK_TAGS, draw(seed, key, at, F.lit("name")))
        more = F.get(acc, i + 1)
        two = (draw(seed, key, at, F.lit("two")) < 0.3) & F.coalesce(more.rlike(f"^[{letters}]$"), F.lit(False))
        inner = F.when(two, F.concat(F.get(acc, i), more)).otherwise(F.get(acc, i))
        whole = F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
        return F.concat(F.slice(acc, F.lit(1), i), F.array(whole), F.slice(acc, F.when(two, i + 3).otherwise(i + 2), F.size(acc)))

    def whole(source: Column) -> Column:
        places = F.filter(F.transform(source, lambda x, i: F.when(x.rlike(f"[{letters}]"), i)), lambda i: i.isNotNull())
        return F.array_join(let(places, lambda p: F.aggregate(hits(p), source, wrap)), "")

    return F.when(c.rlike(f"[{letters}]"), let(chars(c), whole)).otherwise(c)


def training_pairs(lines: Column, key: Column, register: Column, seed: int = 42, letters: str = r"\x{0B80}-\x{0BFF}", table: dict[str, str] | None = None, error_rate: float | None = None) -> Column:
    """The noisy side of a pair: up to five seeds until something changes, then leak tags at the register's rate; ``error_rate`` stands in for the registers' own."""
    rate = F.lit(error_rate) if error_rate is not None else F.coalesce(_rates(ERROR_RATES)[register], F.lit(DEFAULT_ERROR_RATE))
    seeds = F.sequence(F.lit(seed * 100), F.lit(seed * 100 + 4))
    noisy = F.aggregate(seeds, lines, lambda acc, s: F.when(acc != lines, acc).otherwise(register_noise(lines, key, rate, s, letters, table)))
    inject = F.coalesce(_rates(INJECT_RATES)[register], F.lit(DEFAULT_INJECT_RATE))
    return F.when(draw(seed, key, F.lit("inject")) < inject, inject_tags(noisy, key, seed, letters)).otherwise(noisy)


def _rates(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
