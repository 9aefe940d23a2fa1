"""The registered queries of this package, one per operator, and their SQL."""
from __future__ import annotations

from stockboard.llm import (collocations, conversation_repair, decontaminate, exact_dedup, jaccard_join, line_dedup,
                            minhash_dedup, ngram_lm, packing, secrets, substring_dedup, token_counts, toxicity)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_lm_scoring": ngram_lm.op3_lm_scoring,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_minhash_near_dedup": minhash_dedup.op11_minhash_near_dedup,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLE_SQL = {"op2_substring_dedup": substring_dedup.ORACLE, "op5_benchmark_decontamination": decontaminate.ORACLE,
              "op6_line_dedup": line_dedup.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE,
              "op12_phrase_collocations": collocations.ORACLE}
