"""The registered queries of this folder, and the SQL that checks those SQL can express."""

from __future__ import annotations

from siftstone.llm.bpe import op3_byte_bpe
from siftstone.llm.decontaminate import op6_block_max_wand
from siftstone.llm.lm import op8_backoff_automaton
from siftstone.llm.minhash import op7_circulant_minhash
from siftstone.llm.pii import op5_disclosure_pii
from siftstone.llm.quality import op10_quality_ratio
from siftstone.llm.sharding import op4_hash_tree_sharding
from siftstone.llm.token_index import op9_token_index
from siftstone.llm.token_count import op2_viterbi_counts
from siftstone.llm.toxicity import op1_toxic_clauses

QUERIES = {
    "op1_toxic_clauses": op1_toxic_clauses,
    "op2_viterbi_counts": op2_viterbi_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_disclosure_pii": op5_disclosure_pii,
    "op6_block_max_wand": op6_block_max_wand,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op8_backoff_automaton": op8_backoff_automaton,
    "op9_token_index": op9_token_index,
    "op10_quality_ratio": op10_quality_ratio,
}

ORACLE_SQL: dict[str, str] = {}
