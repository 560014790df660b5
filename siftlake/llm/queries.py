"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from siftlake.llm.bpe import op4_bpe_encode_decode
from siftlake.llm.exact_dedup import SQL_OP6, op6_exact_dedup
from siftlake.llm.langid import op3_language_id
from siftlake.llm.licenses import op2_license_scan
from siftlake.llm.lm import op1_lm_scoring
from siftlake.llm.packing import op7_best_fit_packing
from siftlake.llm.prefix_trie import op12_conversation_trie
from siftlake.llm.quality import op9_quality_rules
from siftlake.llm.simhash import op10_simhash_near_dedup
from siftlake.llm.structure_repair import op13_structure_repair
from siftlake.llm.substrings import op11_substring_dedup
from siftlake.llm.token_output import op8_token_output
from siftlake.llm.toxicity import op5_toxicity
from siftlake.session import shipped


def queries():
    found = {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_license_scan": op2_license_scan,
        "op3_language_id": op3_language_id,
        "op4_bpe_encode_decode": op4_bpe_encode_decode,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_token_output": op8_token_output,
        "op9_quality_rules": op9_quality_rules,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_structure_repair": op13_structure_repair,
        "pipeline": corpus_pipeline.run,
    }
    return {name: shipped(f) for name, f in found.items()}


def oracle_sql():
    found = {"op6_exact_dedup": SQL_OP6}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
