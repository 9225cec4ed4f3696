"""The registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from chorus.llm.alignment import op12_pair_hash_alignment
from chorus.llm.ann import op1_multi_index_hashing
from chorus.llm.containment import OP7_SQL, op7_containment_search
from chorus.llm.dac import op6_directly_addressable_codes
from chorus.llm.jaccard import op5_grouped_prefix_join
from chorus.llm.lm import op9_backoff_automaton
from chorus.llm.packing import op3_best_fit_packing
from chorus.llm.pii import op10_candidate_boosting
from chorus.llm.quality import op4_bradley_terry_quality
from chorus.llm.toolcalls import OP2_SQL, op2_tool_call_linking
from chorus.llm.toxicity import op11_toxicity_grammar
from chorus.llm.whitening import op13_qdwh_whitening
from chorus.llm.wordpiece import op8_longest_match_counts

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_bradley_terry_quality": op4_bradley_terry_quality,
    "op5_grouped_prefix_join": op5_grouped_prefix_join,
    "op6_directly_addressable_codes": op6_directly_addressable_codes,
    "op7_containment_search": op7_containment_search,
    "op8_longest_match_counts": op8_longest_match_counts,
    "op9_backoff_automaton": op9_backoff_automaton,
    "op10_candidate_boosting": op10_candidate_boosting,
    "op11_toxicity_grammar": op11_toxicity_grammar,
    "op12_pair_hash_alignment": op12_pair_hash_alignment,
    "op13_qdwh_whitening": op13_qdwh_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op2_tool_call_linking": OP2_SQL,
    "op7_containment_search": OP7_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
