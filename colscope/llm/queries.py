"""The registered queries of the operators, each over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

import corpus_pipeline
from colscope.llm import ann, byte_bpe, exact_dedup, line_dedup, minhash, mixing, negatives, quality, sharding, simhash, token_counts, toxicity, trie

QUERIES = {
    "op1_nearest": ann.op1_nearest,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
    "op11_minhash": minhash.op11_minhash,
    "op12_trie": trie.op12_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op6_token_counts": token_counts.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_minhash": minhash.SQL,
    "op12_trie": trie.SQL,
    "op13_hard_negatives": negatives.SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
