"""Scalar text functions as column expressions: no shuffle, no Python worker, all inside code generation."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import BLANKS, LINE_END, TAMIL, ScriptProfile

# Fixed patterns of the cleaning rules.
INLINE_TAGS = r"(?i)</?(?:b|i|u|mark|sub|sup|em|strong|span)\b[^>]*>"
ANY_TAG = r"<[^>]+>"
LEADING_NUMBER = r"^\d{1,3}\s+"
BRACKETED_ENGLISH = r"""\(["']?[a-zA-Z][a-zA-Z\s\-',.]{2,}["']?\)"""
LIST_MARKER = r"^\s*\d+[.\-)]\s*"
WEB_JUNK = r"(https?://|www\.|\.com|\.org|javascript|function\(|var\s|<script)"
STANZA_GAP = r"\s{3,}\d{1,4}\s+"
LEADING_STANZA, TRAILING_STANZA = r"^\s*\d{1,4}\s+", r"\s+\d{1,4}\s*$"
SECTION_HEADER = r"^\d+\.\d+(\.\d+)?\s+"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
ROMAN_NUMBER = r"^\s*[ivxlcdmIVXLCDM]{1,8}\s*$"
FOOTNOTE = r"\s*[*†‡§]\d*\s*$"
ONLY_POINTS = r"^[\s\d.\-*()]+$"
SENTENCE_END = r"(?<=[.!?।\n])\s+"
LABELLED_PAGE = r"(?i)^(([0-9]+)|((page|p|பக்கம்|p\.)\s*[0-9]+)|([ivxlcdm]+))$"
#: Sentence enders: . ! ? danda, straight and curly quotes, ellipsis.
ENDERS = ".!?।\"'”’‘“…"
MATH, URL = r"(?s)<math[^>]*>.*?</math>", r"(?i)\b(?:https?://|www\.)[^\s]+"
WATERMARK = r"(?i)^\s*(?:www\.[\w.]+|படிப்பகம்|padippakam)\s*$"
GARBAGE = r"^\s*(?:[()\[\]{}•\-_.,:;\\|/\s]{1,10}|[ÇЭЊ₩]+[\s\-.,]*|\d{1,2}\.\d{2}(?:<br>\d{1,2}\.\d{2})?|[oO0])\s*$"
ONLY_BREAKS = r"(?i)^\s*(<br\s*/?>\s*)*$"
NOISE = r"<br>|\||\[\s*\]|\{.*\}|_{2,}|\.{3,}"
METRIC_NOISE = r"^(Indic OCR Output|Languages:|Pages processed:|Tamil OCR Output)|^=+$|^PAGE\s+\d+|^\d{1,4}$|^#+\s"
MODEL_TAGS = r"<2[a-z]{2}>|</?s>"
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: A character reference as HTML 5 reads it, at the start of what begins with its ampersand.
REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: One that its semicolon closes.
CLOSED_REFERENCE = REFERENCE.replace(";?", ";")


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after another, each on the value of the one before, computed once."""
    for step in steps:
        c = let(c, step)
    return c


def replace_if(c: Column, sign: str, pattern: str, by: str = "") -> Column:
    """A replacement of what holds ``sign`` only; c should be bound, as it is named three times."""
    return F.when(c.contains(sign), replace(c, pattern, by)).otherwise(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of spaces become one, ends are stripped."""
    return strip(replace(c, " {2,}", " "))


def letters(p: ScriptProfile) -> str:
    return f"[{p.letters}]"


def has_script(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return c.rlike(letters(p))


def has_english(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def count_script(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return F.char_length(replace(c, f"[^{p.letters}]")).cast("long")


def has_letters(c: Column, least: int, p: ScriptProfile = TAMIL) -> Column:
    """Whether ``count_script`` is ``least`` or more, without making the text anew: the search ends at that letter."""
    return c.rlike(rf"^(?:[^{p.letters}]*+[{p.letters}]){{{least}}}")


def count_latin(c: Column) -> Column:
    return F.char_length(replace(c, "[^A-Za-z]")).cast("long")


def has_text(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """Letters of the profile or ASCII letters."""
    return c.rlike(f"[{p.letters}A-Za-z]")


def ratio(part: Column, c: Column) -> Column:
    return F.when(F.char_length(c) > 0, part / F.char_length(c)).otherwise(F.lit(0.0))


def strip_inline_tags(c: Column) -> Column:
    return replace(c, INLINE_TAGS)


def strip_tags(c: Column) -> Column:
    return replace(c, ANY_TAG)


def strip_stray_scripts(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return collapse(replace(c, f"[{p.stray}]"))


def strip_leading_number(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """A number of up to three digits before text goes; alone it stays."""
    bare = lambda x: let(replace(x, LEADING_NUMBER), lambda rest: F.when(has_text(rest, p), strip(rest)).otherwise(x))
    return let(c, lambda x: F.when(x.rlike(LEADING_NUMBER), bare(x)).otherwise(x))


def is_garbage(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return let(strip(c), lambda s: (F.char_length(s) > 2) & ~has_text(s, p))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def line_steps(p: ScriptProfile = TAMIL) -> list[Callable[[Column], Column]]:
    """The cleaning of a line, step by step: each is given a bound value; the last leaves null for garbage and blanks."""
    return [
        lambda x: replace_if(x, "<", INLINE_TAGS),
        lambda x: F.when(_ascii(x), x).otherwise(replace(x, f"[{p.stray}]")),  # no stray script is ASCII
        lambda x: strip(replace_if(x, "  ", " {2,}", " ")),
        lambda x: strip_leading_number(x, p),
        strip,
        lambda s: F.when((s != "") & ((F.char_length(s) <= 2) | has_text(s, p)), s),
    ]


def clean_line(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """Tags, stray scripts and leading numbers go; null for what is garbage or blank."""
    return chain(c, *line_steps(p))


def split_lines(c: Column) -> Column:
    """As str.splitlines: any line end, no empty line after the last."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_numbered(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of the lines between newlines: array of (line_no, line)."""
    return F.transform(F.split(c, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), use(x).alias("line")))


def clean_text(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """Cleaned lines; blank lines go too."""
    parts = let(c, split_lines)
    for step in line_steps(p):
        parts = F.transform(parts, step)
    return strip(F.array_join(parts, "\n"))


def change_log(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """What cleaning a line changed, in order: array of (kind, original, cleaned)."""

    def entry(kind: str, when: Column, before: Column, after: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), before.alias("original"), after.alias("cleaned")))

    def entries(line: Column, tags: Column, stray: Column, number: Column) -> Column:
        return F.array_compact(
            F.array(
                entry("HTML_TAG", tags != line, line, tags),
                entry("FOREIGN_CHAR", stray != tags, tags, stray),
                entry("PAGE_NUM", stray.rlike(LEADING_NUMBER) & (number != stray), stray, number),
                entry("DROP", is_garbage(number, p), number, F.lit(None).cast("string")),
            )
        )

    return let(
        c, lambda line: let(strip_inline_tags(line), lambda tags: let(strip_stray_scripts(tags, p), lambda stray: let(strip_leading_number(stray, p), lambda number: entries(line, tags, stray, number))))
    )


def tidy(c: Column) -> Column:
    """Blanks to one space and none before punctuation."""
    return strip(replace(replace(c, "[ \t]+", " "), r" ([.,!?])", "$1"))


def post_clean(c: Column, p: ScriptProfile = TAMIL) -> Column:
    """The cleaning of recognised pages: lines are cleaned, then blanks tidied."""
    return tidy(clean_text(c, p))


def decode_xml_entities(c: Column) -> Column:
    for entity, char in XML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference, by the rules of HTML 5."""
    windows = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}
    digits = replace(ref, "[&#xX;]")
    number = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    # More digits than any code point has are beyond the last one.
    bound = let(replace(number, "^0+"), lambda d: F.when(F.char_length(d) > 9, F.lit(0x7FFFFFFF)).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))))
    control = lambda n: n.between(0x1, 0x8) | n.between(0xB, 0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return let(
        bound,
        lambda n: F.when(n == 0x0D, F.lit("\r")).when(n.between(0x80, 0x9F), F.try_element_at(_map(windows), n.cast("string")))
        .when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(control(n), F.lit("")).otherwise(char(n)),
    )


def _named(ref: Column) -> Column:
    """The characters of a named reference: the whole name, or its longest beginning that needs no semicolon; else it stays."""
    short = {k: v for k, v in html5.items() if not k.endswith(";")}
    name = F.substring(ref, F.lit(2), F.char_length(ref))
    begins = F.transform(F.sequence(F.char_length(ref) - 2, F.lit(2), F.lit(-1)), lambda k: F.substring(ref, F.lit(2), k))
    known = lambda n: F.get(F.filter(n, lambda b: F.map_contains_key(_map(short), b)), 0)
    cut = F.when(F.char_length(ref) >= 4, let(known(begins), lambda b: F.concat(F.try_element_at(_map(short), b), F.substring(ref, F.char_length(b) + 2, F.char_length(ref)))))
    return F.coalesce(F.try_element_at(_map(html5), name), cut, ref)


def decode_entities(c: Column, closed: bool = False) -> Column:
    """All character references of HTML 5, as html.unescape; texts without an ampersand cost a search for one.

    With ``closed`` only those that end in a semicolon: once tags are stripped, what follows an open one may be another element's text.
    """

    def reference(ref: Column) -> Column:
        named = F.coalesce(F.try_element_at(_map(html5), F.substring(ref, F.lit(2), F.char_length(ref))), ref) if closed else _named(ref)
        out = F.when(ref.startswith("&#"), _numbered(ref)).otherwise(named)
        for entity, char in [*XML_ENTITIES, ("&nbsp;", "\u00a0")]:
            out = F.when(ref == entity, F.lit(char)).otherwise(out)
        return out

    def part(x: Column) -> Column:
        whole = lambda ref: F.when(ref == "", x).otherwise(F.concat(reference(ref), F.substring(x, F.char_length(ref) + 1, F.char_length(x))))
        return let(F.regexp_extract(x, CLOSED_REFERENCE if closed else REFERENCE, 0), whole)

    return let(c, lambda x: F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "(?=&)", -1), part), "")).otherwise(x))


def strip_bracketed_english(c: Column) -> Column:
    return replace(c, BRACKETED_ENGLISH)


def strip_list_marker(c: Column) -> Column:
    return replace(c, LIST_MARKER)


def is_web_junk(c: Column) -> Column:
    return c.rlike(WEB_JUNK)


def split_stanzas(c: Column) -> Column:
    """Stanzas run together are cut at a gap and number; empty parts go."""
    return F.filter(F.transform(F.split(c, STANZA_GAP, -1), strip), lambda x: x != "")


def strip_stanza_numbers(c: Column) -> Column:
    return strip(replace(replace(c, LEADING_STANZA), TRAILING_STANZA))


def is_section_header(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return c.rlike(SECTION_HEADER) | c.rlike(rf"^[{p.letters}\s]+\d+\.\d+")


def is_chapter_end(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return c.rlike(f"(?iu){p.chapter_end}") & (F.char_length(c) < 60)


def is_editorial(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return c.rlike(f"(?iu){p.editorial}")


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def is_short_header(c: Column) -> Column:
    return (F.char_length(c) < 25) & ~c.rlike("[.!?,;:]")


def strip_footnote(c: Column) -> Column:
    return replace(c, FOOTNOTE)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END, -1), strip), lambda x: x != "")


def clean_sentence(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return chain(
        c,
        lambda x: replace_if(x, "[", r"\[.*?\]"),  # numbers in brackets too
        lambda x: replace_if(x, "http", r"http\S+"),
        lambda x: F.when(_ascii(x), x).otherwise(replace(x, rf"[^{p.letters}\x00-\x7F\s.!?,;:\-\"'()]")),
        lambda x: strip(replace(x, r"\s+", " ")),
    )


def is_valid_sentence(c: Column, p: ScriptProfile = TAMIL) -> Column:
    return let(strip(c), lambda s: F.char_length(s).between(20, 500) & (ratio(count_script(s, p), s) >= 0.40))


#: Pattern and replacement of each step that turns wikitext to plain text, after the templates are gone.
WIKITEXT_STEPS = [
    (r"(?i)\[\[(?:Category|பகுப்பு):.*?\]\]", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"(?i)\[\[(?:File|Image|படிமம்):.*?\]\]", ""),
    (r"\[https?://\S+\s+([^\]]*)\]", "$1"), (r"\[https?://\S+\]", ""), (ANY_TAG, ""), (r"'{2,}", ""), (r"(?m)^[=]+\s*", ""), (r"(?m)\s*[=]+$", ""),
    (r"(?m)^\*+\s*", ""), (r"(?m)^#+\s*", ""), (r"(?m)^:+\s*", ""), (r"(?m)^\{\|.*$", ""), (r"(?m)^\|\}.*$", ""), (r"(?m)^\|.*$", ""), (r"(?m)^!.*$", ""),
    (r"__[A-Z]+__", ""), (r" {2,}", " "), (r"\n{3,}", "\n\n"),
]
TEMPLATE = r"\{\{[^{}]*\}\}"


def strip_wikitext(c: Column) -> Column:
    for _ in range(5):  # nested templates, from the inside
        c = replace(c, TEMPLATE)
    for pattern, by in WIKITEXT_STEPS:
        c = replace(c, pattern, by)
    return strip(c)


def is_page_label(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")).rlike(LABELLED_PAGE)


def is_numeral_line(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER) | c.rlike(ROMAN_NUMBER)


def ends_sentence(c: Column) -> Column:
    s = F.rtrim(c)  # cheap enough to be named twice
    return (s != "") & F.lit(ENDERS).contains(F.right(s, F.lit(1)))


def strip_artifacts(c: Column) -> Column:
    """Math blocks and URLs go, then lines that are watermarks, garbage or blank."""
    lines = F.split(replace(let(c, lambda x: replace_if(x, "<math", MATH)), URL), "\n", -1)
    kept = F.filter(lines, lambda x: let(strip(x), lambda s: ~s.rlike(f"{WATERMARK}|(?-i:{GARBAGE})|{ONLY_BREAKS.removeprefix('(?i)')}")))
    return F.array_join(kept, "\n")


def metric_text(c: Column) -> Column:
    """Text as it is scored: output headers, dividers, page numbers, headings and fragments go, words are joined by single spaces."""
    lines = F.transform(split_lines(F.ltrim(F.coalesce(c, F.lit("")), F.lit("﻿"))), strip)
    kept = F.filter(lines, lambda x: ~x.rlike(METRIC_NOISE) & ~((F.char_length(x) <= 2) & (x != "")))
    return strip(replace(F.array_join(kept, " "), r"\s+", " "))


def prediction_text(c: Column) -> Column:
    c = replace(c, r"^Tamil OCR Output — .*\nPages processed: \d+\n={60}\n\n")
    return strip(replace(replace(c, r"={60}\nPAGE \d+\n={60}\n", " "), r"\s+", " "))


def strip_leak_tags(c: Column) -> Column:
    return replace(c, "</?(mark|sub|sup)>")


def is_noisy(c: Column) -> Column:
    return c.rlike(NOISE)


def edits_at_least(a: Column, b: Column, k: int) -> Column:
    """Whether the edit distance reaches ``k``, without computing more of it than that."""
    return F.lit(True) if k <= 0 else F.levenshtein(a, b, k - 1) == -1


def fits(c: Column, most: int = 1024) -> Column:
    return F.octet_length(c) <= most


def strip_model_tags(c: Column) -> Column:
    return strip(replace(c, MODEL_TAGS))


def safe_stem(c: Column) -> Column:
    return replace(c, "[:/]", "_")


def clean_crawled_line(c: Column) -> Column:
    return let(strip(c), lambda s: F.when(s.rlike(PAGE_NUMBER) | s.rlike(ONLY_POINTS), F.lit("")).otherwise(collapse(strip_footnote(s))))


#: Menu labels and codes of the languages.
LANGUAGES = {
    "Tamil (தமிழ்)": "ta", "Hindi (हिन्दी)": "hi", "Telugu (తెలుగు)": "te", "Bengali (বাংলা)": "bn", "Kannada (ಕನ್ನಡ)": "kn", "Malayalam (മലയാളം)": "ml",
    "Gujarati (ગુજરાતી)": "gu", "Marathi (मराठी)": "mr", "Punjabi (ਪੰਜਾਬੀ)": "pa", "Odia (ଓଡ଼ିଆ)": "or", "English": "en",
}


def language_codes(labels: Column) -> Column:
    """Codes of an array of labels: Tamil if none is known, English always, each once and in order."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    codes = F.array_compact(F.transform(labels, lambda x: table[x]))
    codes = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("ta")))
    return F.array_distinct(F.concat(codes, F.array(F.lit("en"))))


ROUTING = "doc_type string, detected_language string, noise_level int, estimated_columns int, routing_reason string"


def routing_decision(raw: Column) -> Column:
    """A model's routing answer: fences go, unreadable answers become the default, unknown languages Tamil."""
    s = strip(raw)
    fenced = replace(F.element_at(F.split(s, "```", -1), F.lit(2)), "^json")
    body = F.when(s.startswith("```"), fenced).otherwise(s)
    d = F.from_json(body, ROUTING)
    bad = d.isNull() | (d["doc_type"].isNull() & d["detected_language"].isNull() & d["noise_level"].isNull())
    known = F.coalesce(d["detected_language"].isin(sorted(LANGUAGES.values())), F.lit(False))
    default = lambda field, value: F.when(bad, F.lit(value)).otherwise(F.coalesce(d[field], F.lit(value)))
    return F.struct(
        default("doc_type", "historical_scan").alias("doc_type"), F.when(~bad & known, d["detected_language"]).otherwise("ta").alias("detected_language"),
        default("noise_level", 5).alias("noise_level"), default("estimated_columns", 1).alias("estimated_columns"),
        F.when(bad, F.lit("fallback")).otherwise(F.coalesce(d["routing_reason"], F.lit(""))).alias("routing_reason"),
    )


def prompt(text: Column, scores: Column, language: Column) -> Column:
    """The question put to a reviewing model: first 20 scores, first 3000 characters, language."""
    shown = F.array_join(F.transform(F.slice(scores, 1, 20), lambda x: F.format_string("%.3f", x.cast("double"))), ", ")
    return F.concat(F.lit("Language: "), language, F.lit("\nScores: ["), shown, F.lit("]\nText:\n"), F.substring(text, 1, 3000))


def words(c: Column) -> Column:
    """White-space words, as str.split has them."""
    return F.filter(F.split(c, f"[{BLANKS}]+", -1), lambda w: w != "")


#: Code points there are without surrogates, those before the first printable one, and the first surrogate with their number.
CODES, FIRST_CODE, SURROGATES, SURROGATE_COUNT = 0x10FFFF + 1 - 0x800, 0x20, 0xD800, 0x800


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance in words: each different word of the two texts becomes one code point, and the strings of these are compared.

    An error for two texts of more than 1.1 million different words, as there are no more code points.
    """

    def coded(side: Column, known: Column) -> Column:
        place = F.transform(side, lambda w: F.array_position(known, w).cast("int") + FIRST_CODE)
        points = F.transform(place, lambda n: F.lpad(F.hex(n + F.when(n >= SURROGATES, SURROGATE_COUNT).otherwise(0)), 8, "0"))
        return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")

    def distance(both: Column) -> Column:
        fits = F.size(both["known"]) < CODES - FIRST_CODE
        # A text without words is an empty string; the decoder is not asked for it.
        sides = [F.when(F.size(both[s]) > 0, coded(both[s], both["known"])).otherwise("") for s in "ab"]
        return F.when(fits, F.levenshtein(*sides)).otherwise(F.raise_error(F.lit("more different words than code points")).cast("int"))

    sides = let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda s: let(F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("known")), distance))
    return F.when(a.isNotNull() & b.isNotNull(), sides)
