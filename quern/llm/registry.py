"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import decontaminate, exact_dedup, html_extract, license_scan, lm_score, near_dedup, packing, pii, quality, sharding

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_packing": packing.op5_packing,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op1_license_scan": license_scan.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
}
