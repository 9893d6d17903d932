"""Registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
from hirelake.llm import (alignment, decontam, licenses, lines, mixing, pii, quality, ranked, secretscan, simhash, suffix,
                          tokens, urlfilter)

QUERIES = {
    "op1_decontaminate": decontam.query,
    "op2_mix_sources": mixing.query,
    "op3_token_counts": tokens.query,
    "op4_license_scan": licenses.query,
    "op5_simhash_dedup": simhash.query,
    "op6_pii": pii.query,
    "op7_line_dedup": lines.query,
    "op8_suffix_dedup": suffix.query,
    "op9_url_filter": urlfilter.query,
    "op10_quality_rules": quality.query,
    "op11_ranked_search": ranked.query,
    "op12_token_alignment": alignment.query,
    "op13_secret_scan": secretscan.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op9_url_filter": urlfilter.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_ranked_search": ranked.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
