"""Queries of this subpackage, and the SQL of those that SQL can express."""

from . import oracles
from .language import op4_language_id
from .mixing import op10_mixing
from .near_duplicates import op7_near_duplicates
from .packing import op1_best_fit_packing
from .secrets import op3_secret_scans
from .substrings import op2_substring_dedup
from .suffixes import op5_suffix_array_dedup
from .toxicity import op6_toxicity
from .vectors import op8_exact_top_k, op9_nearest_neighbours

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_language_id": op4_language_id,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_mixing": op10_mixing,
}

#: The others can't be told in SQL (models, token ids, random rounding, classes); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.REPEATED_WORDS,
    "op5_suffix_array_dedup": oracles.REPEATED_BYTES,
    "op8_exact_top_k": oracles.EXACT_TOP_K,
}
