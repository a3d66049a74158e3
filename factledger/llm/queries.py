"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from factledger.llm import bpe, chat, divergence, exact_dedup, langid, lm, minhash, mixing, packing, quality, resampling, sharding, topk
from factledger.llm.shared import documents


def op3(spark, sf_dir):
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_minhash_dedup": minhash.op1,
    "op2_language_id": langid.op2,
    "op3_source_mix": op3,
    "op4_packing": packing.op4,
    "op5_lm_score": lm.op5,
    "op6_topk": topk.op6,
    "op7_chat_format": chat.op7,
    "op8_quality": quality.op8,
    "op9_shard_placement": sharding.op9,
    "op10_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_groups(documents(spark, sf_dir)),
    "op11_bpe": bpe.op11,
    "op12_divergence": divergence.op12,
    "op13_resampling": resampling.op13,
}

ORACLES = {
    "op3_source_mix": mixing.ORACLE,
    "op6_topk": topk.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
