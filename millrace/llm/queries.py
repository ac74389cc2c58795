"""Queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    op1_language_id,
    op2_ppm_scoring,
    op3_threshold_topk,
    op4_simhash_vptree,
    op5_exact_dedup,
    op6_byte_bpe,
    op7_bm25_packing,
    op8_line_dedup,
    op9_secret_scan,
    op10_license_scan,
    op11_substring_dedup,
    op12_fill_in_middle,
    op13_join_maintenance,
)

QUERIES = {
    "op1_language_id": op1_language_id.op1_language_id,
    "op2_ppm_scoring": op2_ppm_scoring.op2_ppm_scoring,
    "op3_threshold_topk": op3_threshold_topk.op3_threshold_topk,
    "op4_simhash_vptree": op4_simhash_vptree.op4_simhash_vptree,
    "op5_exact_dedup": op5_exact_dedup.op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe.op6_byte_bpe,
    "op7_bm25_packing": op7_bm25_packing.op7_bm25_packing,
    "op8_line_dedup": op8_line_dedup.op8_line_dedup,
    "op9_secret_scan": op9_secret_scan.op9_secret_scan,
    "op10_license_scan": op10_license_scan.op10_license_scan,
    "op11_substring_dedup": op11_substring_dedup.op11_substring_dedup,
    "op12_fill_in_middle": op12_fill_in_middle.op12_fill_in_middle,
    "op13_join_maintenance": op13_join_maintenance.op13_join_maintenance,
}

#: The others have no SQL: hashes and models that DuckDB lacks. Their tests hold them against brute force.
ORACLE_SQL = {
    "op3_threshold_topk": op3_threshold_topk.SQL,
    "op5_exact_dedup": op5_exact_dedup.SQL,
    "op11_substring_dedup": op11_substring_dedup.SQL,
    "op12_fill_in_middle": op12_fill_in_middle.SQL,
    "op13_join_maintenance": op13_join_maintenance.SQL,
}
