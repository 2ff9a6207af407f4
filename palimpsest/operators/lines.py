"""Line tables. Lines live in arrays as long as they can: order is free there, and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scripts import TAMIL, ScriptProfile


def explode_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per line: the keys, line_no from 0, line."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def load_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Lines stripped, blank ones dropped; the numbers of the others stay."""
    numbered = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), T.strip(x).alias("line")))
    return docs.select(*keys, F.inline(F.filter(numbered, lambda s: s["line"] != "")))


def keep_first(lines: DataFrame, value: str, *order: str) -> DataFrame:
    """The first row of each value in the given order.

    All columns are pre-aggregated with the place, so rows are made once and a value that a third of all rows hold is no task of its own.
    """
    rest = [c for c in lines.columns if c != value]
    first = lines.groupBy(value).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(value, "__first.*").select(*lines.columns)


def clean_lines(docs: DataFrame, *keys: str, profile: ScriptProfile = TAMIL) -> DataFrame:
    """The cleaned lines with their numbers; each step is computed once a line, in arrays."""
    found = T.split_numbered(F.col("text"), lambda x: T.clean_line(x, profile))
    return docs.select(*keys, F.inline(F.filter(found, lambda s: s["line"].isNotNull())))


def reflow(c: F.Column, threshold: int = 18) -> F.Column:
    """Short lines join the line before them; blank runs become one blank."""
    lines = F.transform(T.split_lines(c), T.strip)
    text = F.array_join(lines, "\n")
    # A short line after a line with text: its line end becomes a space. Runs of short lines are taken from the left.
    joined = F.regexp_replace(text, rf"(?<=[^\n])\n(?=[^\n]{{1,{threshold - 1}}}(?:\n|$))", " ")
    return T.strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def paragraphs(c: F.Column) -> F.Column:
    """Lines up to one that ends a sentence make a paragraph."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), T.strip), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(x.rlike("[.!?။]$"), F.concat(x, F.lit("\n\n"))).otherwise(F.concat(x, F.lit(" "))))
    return F.regexp_replace(F.array_join(marked, ""), r"(\n\n| )$", "")


def collapse_blank_lines(c: F.Column) -> F.Column:
    """Trailing blanks go, runs of blank lines become one, none is left at the ends."""
    trimmed = F.regexp_replace(c, r"(?m)[ \t\r\x0B\f]+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def merge_short_lines(c: F.Column, least: int = 30) -> F.Column:
    """Short lines that end no sentence take the next line in, unless that starts a turn of speech; a fold over the lines."""
    lines = F.split(c, "\n", -1)
    speech = r"^['\"‘’“”«—]"

    def step(acc, line):
        s = T.strip(line)
        last = F.element_at(acc, -1)
        open_ = (
            (F.size(acc) > 0) & (s != "") & (T.strip(last) != "") & (F.char_length(last) < least) & ~T.ends_sentence(last) & ~s.rlike(speech)
            & ~last.rlike("(''|’’|\"|”)$") & ~((F.char_length(last) < 8) & ~s.rlike(r"^[\x{0B80}-\x{0BFF}]"))
        )
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(open_, grown).otherwise(F.concat(acc, F.array(F.when(s == "", line).otherwise(s))))

    merged = F.aggregate(lines, F.array().cast("array<string>"), step)
    return F.when(F.size(lines) <= 1, c).otherwise(F.array_join(merged, "\n"))


def ordered_join(df: DataFrame, keys: list[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """The texts of each key in order, joined: text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("text"))
