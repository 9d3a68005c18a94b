"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import maxscore, negatives
from .bpe import op6_bpe
from .chat import op7_chat_formatting
from .classifier import op8_quality_classifier
from .maxscore import op12_exact_topk
from .minhash import op10_jaccard_join
from .mixing import op1_lm_scoring
from .negatives import op13_hard_negatives
from .packing import op2_packing
from .quality import op5_quality_rules
from .secrets import op4_secret_scans
from .spelling import op11_spelling_variants
from .vectors import op3_embedding_dedup
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_topk": op12_exact_topk,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op12_exact_topk": maxscore.SQL, "op13_hard_negatives": negatives.SQL}
