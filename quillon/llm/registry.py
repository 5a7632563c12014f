"""The operators' queries, and SQL where SQL can express one."""

from __future__ import annotations

from .knn_join import OP10_SQL, op10_voronoi_knn
from .line_dedup import op1_line_dedup
from .mixing import op9_low_discrepancy_mix
from .near_dedup import op7_bag_minhash
from .packing import op6_best_fit_packing
from .quality_rules import op4_decision_list
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_counts import op2_token_counts
from .toxicity import op3_ftrl_toxicity
from .warc import OP8_SQL, op8_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_ftrl_toxicity, op4_decision_list, op5_substring_dedup, op6_best_fit_packing, op7_bag_minhash, op8_warc_round_trip, op9_low_discrepancy_mix, op10_voronoi_knn)}
ORACLES: dict[str, str] = {"op10_voronoi_knn": OP10_SQL, "op8_warc_round_trip": OP8_SQL, "op5_substring_dedup": OP5_SQL}
