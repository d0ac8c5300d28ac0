"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from chunkloom.llm import (
    bpe, divergence, embedding_dedup, exact_dedup, hard_negatives, html_main, language_id, minhash_dedup, mixing, packing, substring_dedup, token_output, warc,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": substring_dedup.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_token_output": token_output.op9_token_output,
    "op10_html": html_main.op10_html,
    "op11_mixing": mixing.op11_mixing,
    "op12_divergence": divergence.op12_divergence,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op5_warc": warc.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_mixing": mixing.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
