"""The queries of this subpackage and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, linededup, minhash, resampling, vectors, warc
from .alignment import op13_align
from .bpe import op4_bpe
from .decontaminate import op3_decontaminate
from .langid import op1_langid
from .linededup import op11_lines
from .minhash import op8_minhash
from .passages import op2_passages
from .quality import op5_quality
from .resampling import op12_resample
from .sharding import op9_sharding
from .suffixes import op6_suffixes
from .vectors import op10_vectors
from .warc import op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_langid, op2_passages, op3_decontaminate, op4_bpe, op5_quality, op6_suffixes, op7_warc, op8_minhash, op9_sharding, op10_vectors, op11_lines, op12_resample, op13_align,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": decontaminate.ORACLE, "op7_warc": warc.ORACLE, "op8_minhash": minhash.ORACLE, "op10_vectors": vectors.ORACLE, "op11_lines": linededup.ORACLE, "op12_resample": resampling.ORACLE}
