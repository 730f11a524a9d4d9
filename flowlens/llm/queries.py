"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, licenses, pii, quality, repeats, sentencepieces, simhash, tokens, url_filter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffix_dedup": repeats.op6_suffix_dedup,
    "op7_personal_data": pii.op7_personal_data,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_ids": tokens.op9_token_ids,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
}

SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_suffix_dedup": repeats.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
}
