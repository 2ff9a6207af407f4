"""The few functions without a built-in: Arrow-batched, and only where native expressions cannot say it.

The functions are wrapped when they are called, so that workers can import this module.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _byte_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [b + 3 for b in t.encode()[:1023]] + [1], na_action="ignore")


def _chunks(text: str, size: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            newline = text.rfind("\n", at, end)
            end = newline + 1 if newline > at else end
        out.append(text[at:end])
        at = end
    return out


def _chunk_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _chunks(t, 5000), na_action="ignore")


def nfc(c: Column | str) -> Column:
    """Unicode normal form C."""
    return F.pandas_udf(_nfc, "string")(c)


def byte_tokens(c: Column | str) -> Column:
    """UTF-8 bytes plus 3, cut at 1023 and closed by 1: ids of a byte-level model."""
    return F.pandas_udf(_byte_tokens, "array<int>")(c)


def chunk_text(c: Column | str) -> Column:
    """Pieces of up to 5000 characters, cut after the last newline of each where there is one."""
    return F.pandas_udf(_chunk_text, "array<string>")(c)


#: Texts of up to so many characters are compared in batches, longer ones pair by pair by Spark's own function.
MOST_CHARS = 2048


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the places where each begins."""
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())]).astype(np.int64)


def _padded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.arange(int(lengths.max()))
    return np.where(at < lengths[:, None], flat[np.minimum(starts[:, None] + at, len(flat) - 1)], 0)


def _distances(patterns: np.ndarray, m: np.ndarray, texts: np.ndarray, n: np.ndarray, letters: int) -> np.ndarray:
    """Edit distances of pairs by Myers' bit vectors, 64 rows of the matrix a word; all pairs take a step at once, ``n`` falls."""
    count, words = len(m), -(-patterns.shape[1] // 64)
    pairs, one = np.arange(count), np.uint64(1)
    equal = np.zeros((words, count, letters), np.uint64)
    for i in range(patterns.shape[1]):
        some = pairs[i < m]
        equal[i // 64, some, patterns[some, i]] |= one << np.uint64(i % 64)
    last = np.where((m - 1) // 64 == np.arange(words)[:, None], one << ((m - 1) % 64).astype(np.uint64), np.uint64(0))
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    score = m.astype(np.int64)
    active = np.searchsorted(-n, -np.arange(texts.shape[1]), "left")
    for j, k in enumerate(active.tolist()):
        more, less, letter = np.ones(k, np.uint64), np.zeros(k, np.uint64), texts[:k, j]
        for w in range(words):
            eq, pv, mv = equal[w, pairs[:k], letter], up[w, :k], down[w, :k]
            xv = eq | mv
            eq |= less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score[:k] += ((ph & last[w, :k]) != 0).astype(np.int64) - ((mh & last[w, :k]) != 0)
            more_, less_ = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | more, (mh << one) | less
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            more, less = more_, less_
    return score


def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    (x, xs), (y, ys) = (_codes(pc.fill_null(s, "")) for s in (a, b))
    letters, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = codes[: len(x)], codes[len(x) :]
    m, n = np.diff(xs), np.diff(ys)
    out = np.maximum(m, n)  # what a text without characters costs
    width = -(-m // 64)
    width = np.where(width > 4, 1 << np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64), width)
    some = np.flatnonzero(known & (m > 0) & (n > 0))
    for words in np.unique(width[some]).tolist():
        group = some[width[some] == words]
        group = group[np.argsort(-n[group], kind="stable")]
        step = max(1, min(1024, (1 << 22) // (words * len(letters))))  # tables that stay in the cache, 32 MB at most
        for lo in range(0, len(group), step):
            g = group[lo : lo + step]
            out[g] = _distances(_padded(x, xs[g], m[g]), m[g], _padded(y, ys[g], n[g]), n[g], len(letters))
    return pa.array(out.astype(np.int32), mask=~known)


def edits(a: Column, b: Column) -> Column:
    """Edit distance in characters, as F.levenshtein has it."""
    short = (F.char_length(a) <= MOST_CHARS) & (F.char_length(b) <= MOST_CHARS)
    return F.coalesce(F.arrow_udf(_edits, "int")(F.when(short, a), F.when(short, b)), F.levenshtein(a, b))
