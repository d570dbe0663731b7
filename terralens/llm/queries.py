"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from terralens.llm import bpe, fingerprints, kneser_ney, mixing, sharding, simhash, substring, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_kneser_ney": kneser_ney.op4_kneser_ney,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_topk": topk.op7_topk,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_bpe": bpe.op9_bpe,
    "op10_substring": substring.op10_substring,
}

ORACLE_SQL = {"op2_sharding": sharding.SQL, "op10_substring": substring.SQL, "op1_mixing": mixing.SQL, "op5_warc": warc.SQL, "op7_topk": topk.SQL}
