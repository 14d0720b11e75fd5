"""Registered queries of the training-data operators with their oracle SQL."""

from __future__ import annotations

from catalith.llm import canonical, groups, leakage, linkage, oracles_p1, packing, survivors, truncation

P7_TOTALS_SQL = r"""
SELECT container_name, source, count(DISTINCT doc_id) AS documents, sum(coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+'))))::BIGINT AS tokens, 0 AS overfull, 0 AS mixed
FROM documents CROSS JOIN (SELECT DISTINCT container_name FROM containers WHERE capacity >= 1 AND container_name IS NOT NULL) GROUP BY ALL
"""

QUERIES = {
    "p1_found": survivors.p1_found,
    "p1_records": survivors.p1_records,
    "p2_found": canonical.p2_found,
    "p2_unmatched": canonical.p2_unmatched,
    "p3_found": groups.p3_found,
    "p5_found": linkage.p5_found,
    "p5_confidence": linkage.p5_confidence,
    "p7_packed": packing.p7_packed,
    "p7_totals": packing.p7_totals,
    "p8_found": leakage.p8_found,
    "p9_found": truncation.p9_found,
    "p9_sources": truncation.p9_sources,
    "p9_reasons": truncation.p9_reasons,
}
ORACLES = {
    "p1_found": oracles_p1.P1_FOUND_SQL,
    "p1_records": oracles_p1.P1_RECORDS_SQL,
    "p7_totals": P7_TOTALS_SQL,
}
