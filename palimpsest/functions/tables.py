"""Table functions for SQL: a row a piece, by lateral join.

    register(spark)
    spark.sql("SELECT doc_id, chunk_no, chunk FROM documents, LATERAL chunk_text(text)")

They are Arrow-batched and take whole columns; texts that are null give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .scripts import BLANKS
from .text import SENTENCE_END
from .udfs import _chunks


class _ChunkText:
    """(chunk_no, chunk): pieces of up to 5000 characters, cut after the last newline of each where there is one."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(_chunks(text, 5000))


class _SplitSentences:
    """(sentence_no, sentence): what stands between sentence ends, stripped, without blanks."""

    def __init__(self) -> None:
        self.end = re.compile(SENTENCE_END, re.ASCII)  # white space as Java has it

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(s for s in (part.strip(BLANKS) for part in self.end.split(text)) if s)


chunk_text = udtf(_ChunkText, returnType="chunk_no int, chunk string", useArrow=True)
split_sentences = udtf(_SplitSentences, returnType="sentence_no int, sentence string", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make both known to SQL by their names."""
    spark.udtf.register("chunk_text", chunk_text)
    spark.udtf.register("split_sentences", split_sentences)
