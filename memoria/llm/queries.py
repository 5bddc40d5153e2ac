"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, divergence, filter_audit, near_duplicates, nearest, quality, repeats, sentencepiece, sharding, token_store, top_products, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality": quality.op3_quality,
    "op4_token_ids": token_store.op4_token_ids,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_nearest": nearest.op6_nearest,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_warc": warc.op8_warc,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_repeats": repeats.op10_repeats,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_divergence": divergence.op12_divergence,
    "op13_top_products": top_products.op13_top_products,
}
ORACLES = {"op8_warc": warc.OP8_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op12_divergence": divergence.OP12_SQL, "op13_top_products": top_products.OP13_SQL}
