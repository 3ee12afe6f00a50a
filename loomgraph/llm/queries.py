"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from loomgraph.llm import cotraining, decontaminate, langid, mixing, ngram_join, quality_rules, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality": cotraining.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": langid.op8_language_id,
    "op9_warc": warc.op9_warc,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLES = {
    "op1_sharding": sharding.OP1_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op9_warc": warc.OP9_SQL,
}
