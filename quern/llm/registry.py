"""Queries and oracle SQL of the training-data operators, for ``__spark_entry__``."""

from . import ann, bpe, fim, jaccard, langid, merkle, mixing, quality, suffix_dedup, tokenfile, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_topk": topk.op1_exact_topk,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_bpe_codec": bpe.op3_bpe_codec,
        "op4_ann_graph": ann.op4_ann_graph,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_token_files": tokenfile.op8_token_files,
        "op9_language_id": langid.op9_language_id,
        "op10_warc": warc.op10_warc,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_fill_in_middle": fim.op13_fill_in_middle,
    }


def oracle_sql() -> dict:
    return {"op1_exact_topk": topk.ORACLE, "op7_mix_sources": mixing.ORACLE, "op10_warc": warc.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_fill_in_middle": fim.ORACLE}
