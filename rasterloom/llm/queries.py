"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import REPEATED_STRINGS, WINNOWING
from .packing import op5_best_fit_packing
from .quality import op1_quality_rules
from .sharding import op7_hypergeometric_shards
from .simhash import op6_simhash_covering
from .substrings import op4_suffix_array_spans
from .token_counts import op9_token_counts
from .token_files import op2_bit_packed_ids
from .toxicity import op10_toxicity_nnpu
from .urls import op3_url_rules
from .winnow import op8_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bit_packed_ids": op2_bit_packed_ids,
    "op3_url_rules": op3_url_rules,
    "op4_suffix_array_spans": op4_suffix_array_spans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_covering": op6_simhash_covering,
    "op7_hypergeometric_shards": op7_hypergeometric_shards,
    "op8_winnowing": op8_winnowing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity_nnpu": op10_toxicity_nnpu,
}

ORACLES: dict[str, str] = {
    "op4_suffix_array_spans": REPEATED_STRINGS,
    "op8_winnowing": WINNOWING,
}
