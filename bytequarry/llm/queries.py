"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .chunks import op5_chunks
from .covertree import op7_covertree
from .language import op8_language
from .licenses import op3_licenses
from .media import op10_media
from .minhash import op1_minhash
from .packing import op4_packing
from .parsing import op2_parsing
from .phrases import op9_phrases
from .reputation import OP6_SQL, op6_reputation

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_parsing": op2_parsing,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_chunks": op5_chunks,
    "op6_reputation": op6_reputation,
    "op7_covertree": op7_covertree,
    "op8_language": op8_language,
    "op9_phrases": op9_phrases,
    "op10_media": op10_media,
}
ORACLES: dict[str, str] = {"op6_reputation": OP6_SQL}
