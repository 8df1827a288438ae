"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from loomgraph.llm import decontaminate, license_scan, line_dedup, lm_score, minhash_dedup, sentencepiece_sampling, suffix_dedup, topk, toxicity, url_filter

QUERIES = {
    "op1_lm_score": lm_score.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_url_filter": url_filter.op5,
    "op6_sentencepiece": sentencepiece_sampling.op6,
    "op7_license_scan": license_scan.op7,
    "op8_topk_search": topk.op8,
    "op9_minhash_dedup": minhash_dedup.op9,
    "op10_toxicity": toxicity.op10,
}

ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op7_license_scan": license_scan.SQL,
    "op8_topk_search": topk.SQL,
    "op9_minhash_dedup": minhash_dedup.SQL,
}
