"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, fill_middle, filter_audit, html_extract, jaccard_join, language_id, line_dedup, lm_score, quality_rules, secrets, source_mix, url_filter

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_bpe": bpe.op13_bpe,
}

#: DuckDB SQL where SQL can express the whole result.
ORACLE_SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
