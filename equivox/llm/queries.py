"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from equivox.llm import decontaminate, fingerprints, html_blocks, mixing, repeats, secrets_forest, sharding, simhash, tokens, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1,
    "op2_secrets": secrets_forest.op2,
    "op3_html_blocks": html_blocks.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_toxicity": toxicity.op5,
    "op6_simhash": simhash.op6,
    "op7_mixing": mixing.op7,
    "op8_token_counts": tokens.op8,
    "op9_sharding": sharding.op9,
    "op10_suffix_array": repeats.op10,
}

ORACLE = {
    "op4_decontamination": decontaminate.ORACLE_OP4,
    "op9_sharding": sharding.ORACLE_OP9,
}
