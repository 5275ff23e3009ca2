"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import annulus, chat, exact_dedup, html_extraction, line_dedup, matroska, mixing, ngram_join, packing, quality, sanitising, toxicity, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_nnls_packing": packing.op2_nnls_packing,
    "op3_cube_mixing": mixing.op3_cube_mixing,
    "op4_block_naming_dedup": exact_dedup.op4_block_naming_dedup,
    "op5_string_kernel_toxicity": toxicity.op5_string_kernel_toxicity,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_pairwise_quality": quality.op7_pairwise_quality,
    "op8_winnowing_line_dedup": line_dedup.op8_winnowing_line_dedup,
    "op9_matroska_media": matroska.op9_matroska_media,
    "op10_template_extraction": html_extraction.op10_template_extraction,
    "op11_information_sanitising": sanitising.op11_information_sanitising,
    "op12_jacobi_whitening": whitening.op12_jacobi_whitening,
    "op13_annulus_clustering": annulus.op13_annulus_clustering,
}
ORACLES = {
    "op4_block_naming_dedup": exact_dedup.ORACLE_SQL,
    "op6_chat_formatting": chat.ORACLE_SQL,
    "op13_annulus_clustering": annulus.ORACLE_SQL,
}
