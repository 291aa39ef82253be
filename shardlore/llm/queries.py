"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .conversations import op3
from .decontaminate import OP7_SQL, op7
from .jaccard import op10
from .packing import op2
from .planes import op4
from .quality import op5
from .secrets import op1
from .substrings import OP9_SQL, op9
from .suffixes import op6
from .toxicity import op8

QUERIES = {"op1_secret_forest": op1, "op2_harmonic_packing": op2, "op3_quotation_linking": op3, "op4_plane_files": op4, "op5_decision_lists": op5, "op6_induced_sorting": op6, "op7_benchmark_decontamination": op7, "op8_multiple_instance": op8, "op9_count_min": op9, "op10_adaptive_prefixes": op10}
ORACLES: dict[str, str] = {"op7_benchmark_decontamination": OP7_SQL, "op9_count_min": OP9_SQL}
