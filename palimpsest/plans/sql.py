"""DuckDB spellings of the text rules. The cleaners' patterns are spelled here again, in DuckDB's syntax; the rest takes the fixed patterns from the functions."""

from __future__ import annotations

from ..functions import text as T
from ..functions.scripts import BLANKS, LATIN, LINE_END


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by.replace('$', chr(92)))}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern.replace('(?iu)', '(?i)'))})"


def strip(x: str) -> str:
    return f"trim({x}, {lit(BLANKS)})"


def collapse(x: str) -> str:
    return strip(rep(x, " {2,}", " "))


def script(x: str, letters: str = LATIN.letters) -> str:
    return has(x, f"[{letters}]")


def count_script(x: str, letters: str = LATIN.letters) -> str:
    return f"CAST(length({rep(x, f'[^{letters}]')}) AS BIGINT)"


def stray(x: str, p=LATIN) -> str:
    return collapse(rep(x, f"[{p.stray}]"))


def leading(x: str, p=LATIN) -> str:
    rest = rep(x, T.LEADING_NUMBER)
    return f"CASE WHEN {has(x, T.LEADING_NUMBER)} AND ({script(rest, p.letters)} OR {has(rest, '[A-Za-z]')}) THEN {strip(rest)} ELSE {x} END"


def garbage(x: str, p=LATIN) -> str:
    s = strip(x)
    return f"(length({s}) > 2 AND NOT {script(s, p.letters)} AND NOT {has(s, '[A-Za-z]')})"


def lines(table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "lines") -> str:
    return (
        f"{name}_a AS (SELECT {key}, string_split({text}, chr(10)) AS xs FROM {table}), "
        f"{name} AS (SELECT {key}, unnest(range(len(xs))) AS line_no, unnest(xs) AS line FROM {name}_a)"
    )


def loaded(table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "lines") -> str:
    """Lines stripped, without blanks."""
    return f"{lines(table, key, text, name + '_all')}, {name} AS (SELECT * FROM (SELECT {key}, line_no, {strip('line')} AS line FROM {name}_all) WHERE line <> '')"


#: Letters of the two profiles, and what the cleaners look for, in DuckDB's spelling.
LETTERS = {"latin": r"A-Za-z\x{C0}-\x{24F}", "tamil": r"\x{B80}-\x{BFF}"}
CHAPTER_END = {
    "latin": "the end|finis|end of chapter",
    "tamil": r"முற்றிற்று|இல்லறவியல்\s+முற்றிற்று|அரசியல்\s+முற்றிற்று|அமைச்சியல்\s+முற்றிற்று|துறவறவியல்\s+முற்றிற்று|ஊழியல்\s+முற்றிற்று|அறத்துப்பால்\s+முற்றிற்று|பொருட்பால்\s+|காமத்துப்பால்\s+|அங்கவியல்\s+முற்றிற்று",
}
EDITORIAL = {"latin": r"note\s*:|meaning\s*:|preface|afterword|author\s*:", "tamil": r"பொருள்\s*:|குறிப்பு\s*:|விளக்கம்\s*:|முன்னுரை|பின்னுரை|ஆசிரியர்\s+குறிப்பு|ஆசிரியர்\s*:"}
BRACKETS = r"""\(["']?[a-zA-Z][a-zA-Z\s\-',.]{2,}["']?\)"""


def letters_in(x: str, script_: str) -> str:
    return f"length({rep(x, f'[^{LETTERS[script_]}]')})"


def _judged(steps: str, drops: list[tuple[str, str]], notes: list[tuple[str, str]], value: str) -> str:
    reason = "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in drops) + " END"
    noted = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in notes) + "], lambda v: v IS NOT NULL)"
    return f"{steps}, f AS (SELECT *, {reason} AS reason, {noted} AS notes, {value} AS cleaned FROM w)"


def web(source: str, script_: str = "latin") -> str:
    """CTEs from ``lines`` to f: reason, notes, cleaned."""
    foreign = f"length({rep('m', '[^A-Za-z]')})" if script_ == "tamil" else f"length({rep('m', f'[^{chr(92)}p{{L}}]|[{LETTERS[script_]}]')})"
    bare = rep("t", BRACKETS) if script_ == "tamil" else "t"
    return _judged(
        f"{source}, w0 AS (SELECT *, {entities('line')} AS raw FROM lines), w1 AS (SELECT *, {rep('raw', '<[^>]+>')} AS t FROM w0), w2 AS (SELECT *, {bare} AS b FROM w1), "
        + f"w AS (SELECT *, {rep('b', '^' + chr(92) + 's*[0-9]+[.)-]' + chr(92) + 's*')} AS m FROM w2)",
        [
            ("foreign_heavy", f"length(m) > 0 AND {foreign} / length(m) > 0.30"), ("web_junk", has("m", r"https?://|www\.|\.com|\.org|javascript|function\(|var\s|<script")),
            ("too_short", f"{letters_in(collapse('m'), script_)} < 15"),
        ],
        [("html_tags", "t <> raw"), ("bracket_english", "b <> t"), ("list_marker", "m <> b")],
        collapse("m"),
    )


def verse(source: str, script_: str = "latin") -> str:
    gap = r"\s{3,}[0-9]{1,4}\s+"
    return _judged(
        f"{source}, v0 AS (SELECT *, {entities('line')} AS raw FROM lines), v1 AS (SELECT *, {rep('raw', '<[^>]+>')} AS t FROM v0), "
        + f"v2 AS (SELECT *, string_split_regex(t, {lit(gap)}) AS all_ps FROM v1), "
        + f"v3 AS (SELECT *, CASE WHEN len(all_ps) < 2 THEN [t] ELSE list_filter(list_transform(all_ps, lambda v: {strip('v')}), lambda v: v <> '') END AS ps FROM v2), "
        + "v4 AS (SELECT *, unnest(range(greatest(1, len(ps)))) AS part FROM v3), v5 AS (SELECT *, ps[part + 1] AS stanza FROM v4), "
        + f"v6 AS (SELECT *, {rep('stanza', '^' + chr(92) + 's*[0-9]{1,4}' + chr(92) + 's+')} AS lead FROM v5), "
        + f"w AS (SELECT *, {rep('lead', chr(92) + 's+[0-9]{1,4}' + chr(92) + 's*$')} AS b FROM v6)",
        [
            ("no_stanza", "stanza IS NULL"), ("section_header", f"{has('b', r'^[0-9]+[.][0-9]+([.][0-9]+)?' + chr(92) + 's+')} OR {has('b', f'^[{LETTERS[script_]}{chr(92)}s]+[0-9]+[.][0-9]+')}"),
            ("chapter_end", f"{has('b', f'(?i)({CHAPTER_END[script_]})')} AND length(b) < 60"), ("editorial", has("b", f"(?i)^{chr(92)}s*({EDITORIAL[script_]})")),
            ("too_short", f"{letters_in(collapse('b'), script_)} < 10"),
        ],
        [
            ("html_decoded", "part = 0 AND (contains(raw, '&nbsp;') OR contains(raw, '&amp;'))"), ("html_tags", "part = 0 AND t <> raw"), ("stanzas_split", "part = 0 AND len(all_ps) > 1"),
            ("leading_number", "lead <> stanza"), ("trailing_number", "b <> lead"),
        ],
        collapse("b"),
    )


def prints(source: str, script_: str = "latin") -> str:
    heading = f"length(line) < 25 AND NOT {has('line', '[.!?,;:]')}"
    number = has("line", r"^\s*[0-9]{1,4}\s*$")
    return _judged(
        f"{source}, w AS (SELECT *, {rep('line', chr(92) + 's*[*†‡§][0-9]*' + chr(92) + 's*$')} AS m FROM lines)",
        [("page_number", number), ("header", heading), ("too_short", f"{letters_in(collapse('m'), script_)} < 15")],
        [("footnote", f"m <> line AND NOT ({number} OR {heading})")],
        collapse("m"),
    )


def report(f: str, keys: str, first: str = "true") -> str:
    """Long-form counters of the rows of f."""
    return (
        f"{f}, n AS (SELECT {keys}, 'input' AS counter FROM f WHERE {first} UNION ALL SELECT {keys}, coalesce('drop:' || reason, 'output') FROM f "
        f"UNION ALL SELECT {keys}, 'note:' || unnest(notes) FROM f) SELECT {keys}, counter, count(*) AS lines FROM n GROUP BY ALL"
    )


def split_lines(x: str) -> str:
    parts = f"string_split_regex({x}, {lit(LINE_END)})"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END"


def cleaned(line: str = "line", p=LATIN) -> tuple[str, str]:
    """CTE steps that add c3, the line before the garbage rule, and the final value."""
    steps = (
        f"s1 AS (SELECT *, {rep(line, T.INLINE_TAGS)} AS c1 FROM lines), s2 AS (SELECT *, {stray('c1', p)} AS c2 FROM s1), s3 AS (SELECT *, {leading('c2', p)} AS c3 FROM s2)"
    )
    return steps, f"CASE WHEN NOT {garbage('c3', p)} AND {strip('c3')} <> '' THEN {strip('c3')} END"


def draw(seed: int, *key: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def entities(x: str) -> str:
    for a, b in T.XML_ENTITIES:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def sentences(x: str, ender: str = r"([.!?।\n])\s+") -> str:
    return f"list_filter(list_transform(string_split({rep(x, ender, '$1' + chr(1))}, chr(1)), lambda v: {strip('v')}), lambda v: v <> '')"
