"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tracekit.llm import (bpe, centroids, decontaminate, embed_dup, html_text, language_model, licenses, mixing, near_dup, quality, sharding,
                          token_align, url_filter)

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_licenses": licenses.op2_licenses,
    "op3_language_model": language_model.op3_language_model,
    "op4_embedding_duplicates": embed_dup.op4_embedding_duplicates,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_near_duplicates": near_dup.op9_near_duplicates,
    "op10_mixing": mixing.op10_mixing,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_centroids": centroids.op12_centroids,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}

ORACLE = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
}
