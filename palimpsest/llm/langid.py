"""Language identification of mixed-language text.

The script of a word (by code-point ranges) narrows the candidates to the languages that were seen to use it. Each
word gets a score per language from its letters' byte trigrams, and Viterbi over a document's words, with a
penalty for each switch of language, labels spans. A document's language is the one with the most letters in spans.

Defined cases: a null text, and a text without a letter, is ``und`` with score 0 and has no span; ties go to the
language whose name sorts first; rows without lang, text or doc_id are not learned from; with nothing to
learn from, all is ``und``. Repeated rows count each time; very long texts are labelled whole, in one path; an empty table gives an
empty result; further columns are not read. Languages are few by nature, and more than MAX_LANGUAGES are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import LOWER, column_bytes, slices, word_bounds
from .tables import counted

#: First code points of the ranges and the script of each (0: any other); fixed values of the Unicode blocks.
SCRIPT_RANGES = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"), (0x00C0, "Latin"), (0x0250, "Latin"),
    (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"),
    (0x2C00, "Other"), (0x3000, "Common"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Common"), (0xFE70, "Arabic"),
    (0xFF00, "Common"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_FIRST = np.array([p for p, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])

#: Hashed trigrams per language, the cost of a switch in nats, and the least share of a language's words that a script needs.
TRIGRAMS, SWITCH, SCRIPT_SHARE = 1 << 16, 8.0, 0.001
#: Text bytes whose words go through Viterbi in lockstep.
BATCH_BYTES = 12 << 20
MAX_LANGUAGES = 512

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
_HAS_LETTER = regex.compile(r"\p{L}")


def _scripts(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character."""
    b = [body[np.minimum(starts + k, len(body) - 1)].astype(np.int64) for k in range(4)]
    point = np.where(
        b[0] < 0x80, b[0],
        np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)),
    )
    return _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]


def word_features(body: np.ndarray, offs: np.ndarray):
    """Words of a slice: starts, ends, words before each document, scripts, the trigrams of all word bytes and where each word's begin."""
    body = LOWER[body]
    letters = LETTER[body]
    starts, ends, firsts = word_bounds(letters, offs)
    c = np.zeros(len(body) + 2, np.uint32)
    c[1:-1] = np.where(letters, body, 0)
    at = np.flatnonzero(letters)
    before, after = c[at], c[at + 2]
    edge = np.zeros(len(body) + 1, bool)
    edge[offs] = True
    before[edge[at]] = 0
    after[edge[at + 1]] = 0
    grams = (before * np.uint32(0x9E3779B1) + c[at + 1] * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    begins = np.concatenate(([0], np.cumsum(ends - starts)[:-1])) if len(starts) else np.empty(0, np.int64)
    return starts, ends, firsts, _scripts(body, starts) if len(starts) else starts, grams, begins


class Model:
    """Trigram scores of each language and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        n = len(languages)
        grams = counts[: n * TRIGRAMS].reshape(n, TRIGRAMS) + 0.5
        self.languages = languages
        self.scores = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32) if n else grams.astype(np.float32)
        words = counts[n * TRIGRAMS :].reshape(n, len(SCRIPTS))
        allowed = words.T > SCRIPT_SHARE * words.sum(axis=1)
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)

    def word_scores(self, scripts: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = np.empty((len(begins), len(self.languages)), np.float32)
        for k, table in enumerate(self.scores):
            out[:, k] = np.add.reduceat(table[grams], begins)
        out += self.barred[scripts]
        return out - out.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word; words ``firsts[d]`` to ``firsts[d + 1]`` are document d's. All documents advance together."""
    n_words = np.diff(firsts)
    order = np.argsort(-n_words, kind="stable")
    begin, size = firsts[:-1][order], n_words[order]
    n_lang = scores.shape[1]
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(n_lang, dtype=np.int16)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # documents with more than t words
    best = np.empty((0, n_lang), np.float32)
    final = np.zeros(len(size), np.int64)
    for t, count in enumerate(live.tolist()):
        rows = begin[:count] + t
        if t == 0:
            best = scores[rows].copy()
        else:
            if count < len(best):
                final[count : len(best)] = best[count:].argmax(axis=1)
                best = best[:count]
            top = best.argmax(axis=1)
            moved = best[np.arange(count), top] - switch
            turn = moved[:, None] > best
            back[rows] = np.where(turn, top[:, None], own)
            best = np.where(turn, moved[:, None], best) + scores[rows]
    final[: len(best)] = best.argmax(axis=1)
    labels = np.zeros(len(scores), np.int64)
    state = np.zeros(len(size), np.int64)
    for t in range(len(live) - 1, -1, -1):
        count = live[t]
        ends = np.flatnonzero(size[:count] == t + 1)
        state[ends] = final[ends]
        rows = begin[:count] + t
        labels[rows] = state[:count]
        state[:count] = back[rows, state[:count]]
    return labels


def train(docs: DataFrame) -> Model:
    """Learn from (text, lang): hashed trigram and script counts over all given rows."""
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {name: i for i, name in enumerate(languages)}
    n = len(languages)
    size = n * (TRIGRAMS + len(SCRIPTS))

    def count(batches):
        grams_of, words_of = np.zeros((n, TRIGRAMS), np.int64), np.zeros((n, len(SCRIPTS)), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            body, offs = column_bytes(batch.column("text"))
            for lo, hi, part, po in slices(body, offs):
                starts, ends, firsts, scripts, grams, begins = word_features(part, po)
                of_word = np.repeat(lang[lo:hi], np.diff(firsts))
                of_gram = np.repeat(of_word, ends - starts)
                for k in np.unique(of_word):
                    grams_of[k] += np.bincount(grams[of_gram == k], minlength=TRIGRAMS)
                    words_of[k] += np.bincount(scripts[of_word == k], minlength=len(SCRIPTS))
        return np.concatenate((grams_of.ravel(), words_of.ravel()))

    return Model(languages, counted(known, size, count) if n else np.zeros(0, np.int64))


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score and (if wanted) the spans (lang, start, end in bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x (2**16 + scripts) numbers, a checked bound
    fields = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:long,end:long>>" * spans
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def labelled(ids, texts, parts):
        names = shared.value.languages
        n_lang = max(1, len(names))
        starts, ends, scores = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        counts = np.concatenate([p[3] for p in parts])
        firsts = np.concatenate(([0], np.cumsum(counts)))
        labels = viterbi(scores, firsts) if names else np.zeros(len(scores), np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        held = np.bincount(doc * n_lang + labels, weights=ends - starts, minlength=len(counts) * n_lang).reshape(-1, n_lang)
        total, top = held.sum(axis=1), held.argmax(axis=1)
        known = (total > 0) & bool(names)
        for d in np.flatnonzero(known & ~np.concatenate([p[4] for p in parts])):
            known[d] = _HAS_LETTER.search(texts[int(d)].as_py()) is not None
        columns = {
            "doc_id": ids, "lang_pred": pa.array([names[t] if k else "und" for t, k in zip(top, known, strict=True)], pa.string()),
            "score": pa.array(np.where(known, held.max(axis=1) / np.maximum(total, 1), 0.0)),
        }
        if spans:
            new = np.concatenate(([True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1]))) if len(labels) else np.empty(0, bool)
            head = np.flatnonzero(new)
            tail = np.concatenate((head[1:], [len(labels)])) - 1 if len(head) else head
            rows: list[list[dict]] = [[] for _ in counts]
            for h, t in zip(head.tolist(), tail.tolist(), strict=True):
                if known[doc[h]]:
                    rows[doc[h]].append({"lang": names[labels[h]], "start": int(starts[h]), "end": int(ends[t])})
            columns["spans"] = pa.array(rows, span_type)
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        model = shared.value
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            body, offs = column_bytes(column)
            parts, begin, size = [], 0, 0
            for lo, hi, part, po in slices(body, offs):
                starts, ends, firsts, scripts, grams, begins = word_features(part, po)
                scores = model.word_scores(scripts, grams, begins) if len(begins) and model.languages else np.zeros((len(begins), max(1, len(model.languages))), np.float32)
                ascii_letters = np.concatenate(([0], np.cumsum(LETTER[part] & (part < 0x80))))
                plain = ascii_letters[po[1:]] > ascii_letters[po[:-1]]
                at = np.repeat(po[:-1], np.diff(firsts))
                parts.append((starts - at, ends - at, scores, np.diff(firsts), plain))
                size += len(part)
                if size >= BATCH_BYTES or hi == batch.num_rows:
                    yield labelled(ids.slice(begin, hi - begin), column.slice(begin, hi - begin), parts)
                    parts, begin, size = [], hi, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def fold(column: str, parts: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those whose CRC modulo 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, model, spans=False).select("doc_id", held_out, "lang_pred", "score")
