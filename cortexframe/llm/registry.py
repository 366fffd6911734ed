"""Registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import collocations, htmltext, langid, media, minhash, mixing, neardup_vectors, packing, perplexity, pii, resampling, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_media_columns": media.op3_media_columns,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_collision_counting": neardup_vectors.op5_collision_counting,
        "op6_language_bitmask": langid.op6_language_bitmask,
        "op7_line_blocks": htmltext.op7_line_blocks,
        "op8_order_minhash": minhash.op8_order_minhash,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_kneser_ney": perplexity.op10_kneser_ney,
        "op11_collocations": collocations.op11_collocations,
        "op12_target_resampling": resampling.op12_target_resampling,
        "op13_personal_data": pii.op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_collocations": collocations.SQL,
        "op12_target_resampling": resampling.SQL,
        "op13_personal_data": pii.SQL,
    }
