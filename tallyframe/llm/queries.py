"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .ann import op9_nearest_vectors
from .byte_bpe import op8_byte_bpe
from .chat_format import ORACLE_OP6, op6_chat_format
from .exact_dedup import ORACLE_OP7, op7_exact_dedup
from .html_extract import op1_html_extract
from .langid import op5_language_id
from .ngram_lm import op3_lm_score
from .packing import op10_best_fit_packing
from .simhash import op4_simhash
from .substring_dedup import ORACLE_OP2, op2_substring_dedup

_ALL = (op1_html_extract, op2_substring_dedup, op3_lm_score, op4_simhash, op5_language_id, op6_chat_format, op7_exact_dedup, op8_byte_bpe, op9_nearest_vectors, op10_best_fit_packing)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_substring_dedup": ORACLE_OP2, "op6_chat_format": ORACLE_OP6, "op7_exact_dedup": ORACLE_OP7}
