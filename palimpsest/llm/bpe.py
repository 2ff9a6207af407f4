"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the split pattern can cross (a white-space character after another
character), so that each piece is encoded by itself, in bounded memory, with the tokens of the whole text.
Decoding joins the tokens' raw bytes; it never goes through text.

Null texts are empty texts: no token, the digests of nothing. Ids, further columns, repeated rows and ties are
carried through or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters encoded at a time, at least; the cut comes at the next safe boundary.
PIECE_CHARS = 1 << 16
#: A rank file is broadcast, so its size is checked.
MAX_RANK_BYTES = 64 << 20

_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only before white space that follows another character.

    White space stands only at the start of a match of the pattern or makes up a whole match, and no match looks
    behind itself, so no match crosses such a place and none changes for it.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than the {MAX_RANK_BYTES} bytes that may be broadcast")
    return data


class Codec:
    """Encodes texts to ids and ids to bytes by the ranks of a file's content."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        parts = [self.encoding.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in pieces(text or "")]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4")

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids if isinstance(ids, list) else [int(i) for i in ids] if not isinstance(ids, np.ndarray) else ids.tolist())


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    ranks, pattern = shared.value
    key = hash((ranks, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    column = batch.column("text")
    for i in range(len(column)):
        yield i, column[i].as_py()


def encode(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, the ids (if kept) and the digests of ids and decoded bytes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_ranks(rank_path), pattern))
    fields = "doc_id long, n_tokens long, " + "token_ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, ids_out, ids_sha, text_sha = [], [], [], []
                for _, text in _texts(part):
                    ids = codec.encode(text)
                    counts.append(len(ids))
                    ids_out.append(ids.astype(np.int32) if keep_ids else None)
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())}
                if keep_ids:
                    columns["token_ids"] = pa.array(ids_out, pa.list_(pa.int32()))
                columns |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def decode(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The raw bytes of each row's ``token_ids`` (doc_id, token_ids -> doc_id, content binary); null ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast((load_ranks(rank_path), pattern))

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            content = [codec.decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "content": pa.array(content, pa.binary())})

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, content binary")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public multilingual vocabulary installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary(), keep_ids=False)
