"""Writing systems as regular-expression classes: what counts as text of the corpus, and what is stray."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """letters: inside of a character class; stray: scripts whose characters are deleted; enders: chapter-end and editorial markers."""

    name: str
    letters: str
    stray: str
    chapter_end: str
    editorial: str


#: Code-point ranges, inclusive; fixed values.
TAMIL_LETTERS = r"\x{0B80}-\x{0BFF}"
LATIN_LETTERS = r"A-Za-z\x{00C0}-\x{024F}"
INDIC_AND_OTHERS = (
    r"\x{0900}-\x{097F}\x{0D00}-\x{0D7F}\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{0600}-\x{06FF}"
    r"\x{4E00}-\x{9FFF}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0A00}-\x{0A7F}\x{0A80}-\x{0AFF}\x{0B00}-\x{0B7F}"
)

TAMIL = ScriptProfile(
    "tamil",
    TAMIL_LETTERS,
    INDIC_AND_OTHERS,
    r"(முற்றிற்று|இல்லறவியல்\s+முற்றிற்று|அரசியல்\s+முற்றிற்று|அமைச்சியல்\s+முற்றிற்று|துறவறவியல்\s+முற்றிற்று|ஊழியல்\s+முற்றிற்று"
    r"|அறத்துப்பால்\s+முற்றிற்று|பொருட்பால்\s+|காமத்துப்பால்\s+|அங்கவியல்\s+முற்றிற்று)",
    r"^\s*(பொருள்\s*:|குறிப்பு\s*:|விளக்கம்\s*:|முன்னுரை|பின்னுரை|ஆசிரியர்\s+குறிப்பு|ஆசிரியர்\s*:)",
)
#: The same rules for texts in Latin letters, as the driver's tables hold them.
LATIN = ScriptProfile("latin", LATIN_LETTERS, INDIC_AND_OTHERS + TAMIL_LETTERS, r"(the end|finis|end of chapter)", r"^\s*(note\s*:|meaning\s*:|preface|afterword|author\s*:)")

#: White space as Python's str.strip knows it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Line ends as str.splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{0085}\x{2028}\x{2029}]"
