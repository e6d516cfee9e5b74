"""The registered queries of the llm operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

from legajo.llm.chat_format import op2_chat_format
from legajo.llm.decontaminate import op1_decontaminate
from legajo.llm.hilbert import op3_hilbert_sharding
from legajo.llm.jaccard_join import op4_jaccard_join
from legajo.llm.language_id import op5_language_id
from legajo.llm.mixture import op10_pareto_mix
from legajo.llm.oracles import ORACLES
from legajo.llm.perplexity import op7_perplexity
from legajo.llm.quality_rules import op9_quality_rules
from legajo.llm.substring_dedup import op8_substring_dedup
from legajo.llm.token_counts import op6_token_counts

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_chat_format, op3_hilbert_sharding, op4_jaccard_join, op5_language_id, op6_token_counts, op7_perplexity, op8_substring_dedup, op9_quality_rules, op10_pareto_mix)}

__all__ = ["ORACLES", "QUERIES"]
