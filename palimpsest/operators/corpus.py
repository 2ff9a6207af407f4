"""Source-aware corpus cleaners and their counters, combining and sentence extraction.

Each cleaner is one pass over a line table (keys, line_no, line) that adds the cleaned line, null if dropped, the rule
that dropped it and notes of what was changed; counters are sums over those, so cleaning and reporting share one scan.
Lines come stripped and without blanks, as :func:`..operators.lines.load_lines` gives them.

A line's steps are bound one inside another and unpacked from a row of their own: each is computed once, whatever is
filtered later.
"""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scripts import TAMIL, ScriptProfile
from .lines import keep_first
from .sampling import first_rows, order_key


def _judged(lines: DataFrame, verdict: Column) -> DataFrame:
    """Adds what a verdict holds."""
    return lines.select(*lines.columns, F.inline(F.array(verdict)))


def _verdict(line: Column, drops: list[tuple[str, Column]], notes: list[tuple[str, Column]]) -> Column:
    """drops: rules in order, of which the first that holds drops the line; notes: what was changed before any drop."""
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in drops])
    noted = F.array_compact(F.array(*[F.when(changed, F.lit(name)) for name, changed in notes]))
    return T.let(reason, lambda r: F.struct(r.alias("reason"), noted.alias("notes"), F.when(r.isNull(), line).alias("cleaned")))


def _foreign_letters(c: Column, p: ScriptProfile) -> Column:
    """Letters outside the profile: ASCII letters for a profile without them, else letters that are not the profile's."""
    if "A-Z" not in p.letters:
        return T.count_latin(c)
    others = F.char_length(T.replace(c, rf"[^\p{{L}}]|[{p.letters}]")).cast("long")
    return F.when(F.octet_length(c) == F.char_length(c), F.lit(0).cast("long")).otherwise(others)  # ASCII letters are all the profile's


def clean_web(lines: DataFrame, profile: ScriptProfile = TAMIL) -> DataFrame:
    """Web text: entities, tags, bracketed English and list markers go; foreign, junk and short lines are dropped."""
    brackets = (lambda c: T.replace_if(c, "(", T.BRACKETED_ENGLISH)) if profile is TAMIL else (lambda c: c)

    def verdict(raw, tags, bare, marker, line):
        drops = [
            ("foreign_heavy", T.ratio(_foreign_letters(marker, profile), marker) > 0.30), ("web_junk", T.is_web_junk(marker)), ("too_short", ~T.has_letters(line, 15, profile)),
        ]
        return _verdict(line, drops, [("html_tags", tags != raw), ("bracket_english", bare != tags), ("list_marker", marker != bare)])

    return _judged(lines, _bound(F.col("line"), [T.decode_entities, lambda c: T.replace_if(c, "<", T.ANY_TAG), brackets, T.strip_list_marker, _collapsed], verdict))


def _collapsed(c: Column) -> Column:
    return T.strip(T.replace_if(c, "  ", " {2,}", " "))


def _bound(first: Column, steps: list, use) -> Column:
    """``use`` of the values of all steps, each made of the one before and computed once."""

    def grow(values: list[Column], left: list) -> Column:
        return use(*values) if not left else T.let(left[0](values[-1]), lambda v: grow([*values, v], left[1:]))

    return T.let(steps[0](first), lambda v: grow([v], steps[1:]))


def clean_verse(lines: DataFrame, profile: ScriptProfile = TAMIL) -> DataFrame:
    """Verse collections: run-together stanzas are split; numbers, headings, chapter ends and commentary go.

    Adds ``part``, the stanza's place in its line. What is noted of a whole line stands at part 0; a line without any
    stanza is one row, dropped as ``no_stanza``.
    """

    def split(raw, tags, pieces):
        many = F.size(pieces) > 1
        stanzas = F.when(many, F.filter(F.transform(pieces, T.strip), lambda x: x != "")).otherwise(F.array(tags))
        notes = F.array_compact(F.array(
            F.when(raw.contains("&nbsp;") | raw.contains("&amp;"), F.lit("html_decoded")), F.when(tags != raw, F.lit("html_tags")), F.when(many, F.lit("stanzas_split")),
        ))
        return T.let(
            F.when(F.size(stanzas) > 0, stanzas).otherwise(F.array(F.lit(None).cast("string"))),
            lambda all_: F.transform(all_, lambda x, i: F.struct(i.alias("part"), x.alias("__stanza"), F.when(i == 0, notes).otherwise(F.array().cast("array<string>")).alias("__noted"))),
        )

    def verdict(stanza, lead, bare, line):
        drops = [
            ("no_stanza", stanza.isNull()), ("section_header", T.is_section_header(bare, profile)), ("chapter_end", T.is_chapter_end(bare, profile)), ("editorial", T.is_editorial(bare, profile)),
            ("too_short", ~T.has_letters(line, 10, profile)),
        ]
        return _verdict(line, drops, [("leading_number", lead != stanza), ("trailing_number", bare != lead)])

    parts = _bound(F.col("line"), [T.decode_entities, lambda c: T.replace_if(c, "<", T.ANY_TAG), lambda c: F.split(c, T.STANZA_GAP, -1)], split)
    exploded = lines.select(*lines.columns, F.inline(parts))
    steps = [lambda c: c, lambda c: T.replace(c, T.LEADING_STANZA), lambda c: T.replace(c, T.TRAILING_STANZA), _collapsed]
    out = _judged(exploded, _bound(F.col("__stanza"), steps, verdict))
    return out.withColumn("notes", F.concat("__noted", "notes")).withColumnRenamed("__stanza", "stanza").drop("__noted")


def clean_print(lines: DataFrame, profile: ScriptProfile = TAMIL) -> DataFrame:
    """Old prints: page numbers and short headings are dropped, footnote marks go."""

    def verdict(raw, mark, line):
        heading = T.is_page_number(raw) | T.is_short_header(raw)
        drops = [("page_number", T.is_page_number(raw)), ("header", heading), ("too_short", ~T.has_letters(line, 15, profile))]
        return _verdict(line, drops, [("footnote", (mark != raw) & ~heading)])

    return _judged(lines, _bound(F.col("line"), [lambda c: c, T.strip_footnote, _collapsed], verdict))


def clean_report(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Per key: lines in and out, and lines per reason, in long form: (keys, counter, lines). A line's stanzas are one line in."""
    first = F.col("part") == 0 if "part" in cleaned.columns else F.lit(True)
    came = F.array(F.when(first, F.lit("input")), F.coalesce(F.concat(F.lit("drop:"), F.col("reason")), F.lit("output")))
    names = F.concat(F.array_compact(came), F.transform("notes", lambda n: F.concat(F.lit("note:"), n)))
    return cleaned.select(*keys, F.explode(names).alias("counter")).groupBy(*keys, "counter").agg(F.count("*").alias("lines"))


def drop_rates(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Per key: lines in, lines out, the difference and its share of the lines in, in percent."""
    first = F.col("part") == 0 if "part" in cleaned.columns else F.lit(True)
    counts = cleaned.groupBy(*keys).agg(F.count_if(first).alias("input"), F.count_if(F.col("reason").isNull()).alias("output"))
    dropped = F.col("input") - F.col("output")
    return counts.withColumn("dropped", dropped).withColumn("dropped_pct", F.round(100 * dropped / F.greatest(F.col("input"), F.lit(1)), 1))


#: What a cleaner may drop a line for, and what it may note.
DROPS = {
    "web": ("foreign_heavy", "web_junk", "too_short"), "verse": ("no_stanza", "section_header", "chapter_end", "editorial", "too_short"), "print": ("page_number", "header", "too_short"),
}
NOTES = {
    "web": ("html_tags", "bracket_english", "list_marker"), "verse": ("html_decoded", "html_tags", "stanzas_split", "leading_number", "trailing_number"), "print": ("footnote",),
}


def observed(cleaned: DataFrame, kind: str) -> tuple[DataFrame, Observation]:
    """``cleaned`` and an observation of it: whatever pass reads the lines first counts them too, see :func:`counters`."""
    seen = Observation(f"clean-{kind}-{uuid.uuid4().hex}")
    first = F.col("part") == 0 if "part" in cleaned.columns else F.lit(True)
    counts = {"input": first, "output": F.col("reason").isNull()}
    counts |= {f"drop:{r}": F.col("reason") == r for r in DROPS[kind]}
    sums = [F.count_if(c).alias(n) for n, c in counts.items()]
    held = lambda note: F.size(F.filter("notes", lambda n: n == note))  # noqa: E731  a line may hold a note more than once
    sums += [F.coalesce(F.sum(held(note)), F.lit(0)).alias(f"note:{note}") for note in NOTES[kind]]
    return cleaned.observe(seen, *sums), seen


def counters(seen: Observation) -> dict[str, int]:
    """What was counted, as :func:`clean_report` gives it: counters of nothing are left out. Waits until the observed pass is over."""
    return {name: n for name, n in seen.get.items() if n}


def rates(counted: dict[str, int]) -> dict[str, float]:
    """Lines in, out, dropped, and the share dropped in percent, as :func:`drop_rates` gives them."""
    came, went = counted.get("input", 0), counted.get("output", 0)
    return {"input": came, "output": went, "dropped": came - went, "dropped_pct": float((Decimal(100 * (came - went)) / max(came, 1)).quantize(Decimal("0.1"), ROUND_HALF_UP))}


def combine(sources: list[tuple[str, DataFrame]], *order: str) -> DataFrame:
    """The cleaned lines of all sources, each once (its first place stays), in seeded order: source, order, line, shuffle_key."""
    parts = [
        df.where("cleaned is not null").select(F.lit(rank).alias("rank"), F.lit(name).alias("source"), *order, F.col("cleaned").alias("line")) for rank, (name, df) in enumerate(sources)
    ]
    return keep_first(reduce(DataFrame.unionByName, parts), "line", "rank", *order).drop("rank").withColumn("shuffle_key", order_key(42, "line"))


def combine_stats(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per source, and one of all (``combined``): lines before and after each distinct line is kept once."""
    parts = [df.where("cleaned is not null").select(F.lit(name).alias("source"), F.col("cleaned").alias("line")) for name, df in sources]
    of_line = reduce(DataFrame.unionByName, parts).groupBy("line").agg(*[F.count_if(F.col("source") == name).alias(name) for name, _ in sources])
    # A line is kept by the first source that has it.
    kept, earlier, columns = [], F.lit(False), []
    for name, _ in sources:
        kept.append(F.count_if((F.col(name) > 0) & ~earlier))
        earlier = earlier | (F.col(name) > 0)
    for (name, _), own in zip(sources, kept, strict=True):
        columns.append(F.struct(F.lit(name).alias("source"), F.coalesce(F.sum(name), F.lit(0)).alias("lines"), own.alias("kept")))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(name), F.lit(0)) for name, _ in sources])
    columns.append(F.struct(F.lit("combined").alias("source"), total.alias("lines"), F.count("*").alias("kept")))
    return of_line.agg(F.array(*columns).alias("rows")).select(F.inline("rows")).withColumn("removed", F.col("lines") - F.col("kept"))


def sentences(docs: DataFrame, key: str = "doc_id", profile: ScriptProfile = TAMIL, most: int | None = None) -> DataFrame:
    """Valid cleaned sentences: key, sentence_no, sentence; with ``most`` the first so many of all by key and number."""
    found = F.transform(T.split_sentences(F.col("text")), lambda x, i: F.struct(i.alias("sentence_no"), T.clean_sentence(x, profile).alias("sentence")))
    valid = F.filter(found, lambda s: T.is_valid_sentence(s["sentence"], profile))
    out = docs.select(key, F.inline(valid))
    return out if most is None else first_rows(out, most, key, "sentence_no")


def page_text(extract: Column, wikitext: Column, profile: ScriptProfile = TAMIL) -> Column:
    """The plain extract if it holds 100 script characters, else the stripped wikitext."""
    return F.when(T.has_letters(F.coalesce(extract, F.lit("")), 100, profile), extract).otherwise(T.strip_wikitext(wikitext))


def crawl_lines(pages: DataFrame, key: str, text: str, profile: ScriptProfile = TAMIL, seen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Lines of pages with 100 script characters, cleaned, with 10 of their own, each once; pages in ``seen`` are left out, lines beyond ``most`` in order too."""
    fresh = pages if seen is None else pages.join(seen.select(key), key, "left_anti")
    kept = fresh.where(T.has_letters(F.col(text), 100, profile))
    cleaned = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), T.clean_crawled_line(x).alias("line")))
    lines = kept.select(key, F.inline(F.filter(cleaned, lambda s: T.has_letters(s["line"], 10, profile))))
    first = keep_first(lines, "line", key, "line_no")
    return first if most is None else first_rows(first, most, key, "line_no")


def append_distinct(existing: DataFrame, new: DataFrame, value: str, order: str) -> DataFrame:
    """``existing`` and the values of ``new`` it does not hold, each once at its first place: value, rank (0 existing, 1 new), order."""
    parts = [df.select(F.lit(rank).alias("rank"), F.col(order).alias(order), value) for rank, df in enumerate((existing, new))]
    return keep_first(reduce(DataFrame.unionByName, parts), value, "rank", order)


def validate(lines: DataFrame, value: str = "line") -> DataFrame:
    """One row: how many entities, wiki braces and tags are left; all must be 0."""
    c = F.col(value)
    total = lambda pattern: F.coalesce(F.sum(F.regexp_count(c, F.lit(pattern))), F.lit(0)).cast("long")
    return lines.agg(total("&nbsp;|&amp;|&quot;").alias("entities"), total(r"\{\{|\}\}").alias("wiki"), total("(?i)<[a-z]+[^>]*>").alias("tags"))
