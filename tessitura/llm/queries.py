"""The operators' queries over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontamination
from .jpeg import op10_media
from .language import op4_language
from .infill import OP12_SQL, op12_infill
from .lines import OP9_SQL, op9_line_dedup
from .merkle import OP11_SQL, op11_merkle
from .mixing import op5_mixing
from .neardup import op8_near_duplicates
from .sharding import op2_sharding
from .suffixes import OP3_SQL, op3_suffix_dedup
from .tokens import op6_tokens
from .toxicity import op13_toxicity
from .urls import OP7_SQL, op7_urls

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_tokens": op6_tokens,
    "op7_urls": op7_urls,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_line_dedup": op9_line_dedup,
    "op10_media": op10_media,
    "op11_merkle": op11_merkle,
    "op12_infill": op12_infill,
    "op13_toxicity": op13_toxicity,
}
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op7_urls": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle": OP11_SQL, "op12_infill": OP12_SQL}
