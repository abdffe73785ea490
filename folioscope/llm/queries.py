"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_quality, op2_token_counts, op3_decontaminate, op4_neighbours, op5_bpe, op6_token_output, op7_language, op8_url_filters, op9_minhash, op10_license_scan

QUERIES = {
    "op1_quality": op1_quality.op1_quality,
    "op2_token_counts": op2_token_counts.op2_token_counts,
    "op3_decontaminate": op3_decontaminate.op3_decontaminate,
    "op4_neighbours": op4_neighbours.op4_neighbours,
    "op5_bpe": op5_bpe.op5_bpe,
    "op6_token_output": op6_token_output.op6_token_output,
    "op7_language": op7_language.op7_language,
    "op8_url_filters": op8_url_filters.op8_url_filters,
    "op9_minhash": op9_minhash.op9_minhash,
    "op10_license_scan": op10_license_scan.op10_license_scan,
}
ORACLES = {
    "op8_url_filters": op8_url_filters.ORACLE,
    "op9_minhash": op9_minhash.ORACLE,
    "op10_license_scan": op10_license_scan.ORACLE,
}
