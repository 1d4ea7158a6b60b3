"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bm25, line_dedup, pii, quality_rules
from .minhash_dedup import op8_minhash_dedup
from .packing import op3_packing
from .quality_classifier import op10_quality_classifier
from .token_counts import op2_token_counts
from .tokens import op7_bpe
from .url_filters import op5_url_filters

QUERIES = {
    "op1_bm25": bm25.op1_bm25,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_pii": pii.op9_pii,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_bm25": bm25.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
}
