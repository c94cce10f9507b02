"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from .bpe import op10_bpe
from .divergence import op6_quality_rules
from .packing import op1_best_fit_packing
from .passages import OP7_SQL, op7_substring_dedup
from .pii import op9_pii
from .rules import op5_quality_classifier
from .secrets import op2_secret_scans
from .simhash import op8_simhash_near_dedup
from .topk import OP3_SQL, op3_exact_top_k
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scans, op3_exact_top_k, op4_toxicity, op5_quality_classifier, op6_quality_rules, op7_substring_dedup, op8_simhash_near_dedup, op9_pii, op10_bpe)}

ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": OP3_SQL, "op7_substring_dedup": OP7_SQL}
