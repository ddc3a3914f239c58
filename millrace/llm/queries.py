"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from millrace.llm import byte_bpe, decontamination, exact_dedup, html_extraction, language_id, line_dedup, ngram_join, periodic_runs, quality, secret_scan, sharding, token_files, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_resampling": quality.op7_quality_resampling,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_token_files": token_files.op10_token_files,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
}
