"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from kindframe.llm import bitslice_topk, cotraining, fingerprints, html_text, jaccard_join, line_dedup, packing, secret_scan, source_mix, warc_zip

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_bitslice_topk": bitslice_topk.op3_bitslice_topk,
    "op4_packing": packing.op4_packing,
    "op5_warc_zip": warc_zip.op5_warc_zip,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_cotraining": cotraining.op9_cotraining,
    "op10_html_text": html_text.op10_html_text,
}
ORACLES = {"op1_line_dedup": line_dedup.OP1_SQL, "op3_bitslice_topk": bitslice_topk.OP3_SQL, "op5_warc_zip": warc_zip.OP5_SQL, "op7_jaccard_join": jaccard_join.OP7_SQL, "op8_secret_scan": secret_scan.OP8_SQL}
