"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio_fingerprint, compression_quality, divergence, exact_dedup, html_lstm, jaccard_join, license_scan, packing, piece_codec, token_bits, token_count, toxic_crf, whitening


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_audio_fingerprint": audio_fingerprint.op2_audio_fingerprint,
        "op3_quality": compression_quality.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_piece_codec": piece_codec.op5_piece_codec,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_toxicity": toxic_crf.op8_toxicity,
        "op9_html_extract": html_lstm.op9_html_extract,
        "op10_token_count": token_count.op10_token_count,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_token_bits": token_bits.op12_token_bits,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": jaccard_join.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op13_source_divergence": divergence.ORACLE}
