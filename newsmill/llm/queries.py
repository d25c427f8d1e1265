"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from newsmill.llm import decontaminate, fingerprints, language, language_model, near_duplicates, packing, secrets, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_warc": warc.op3_warc,
    "op4_gated_lm": language_model.op4_gated_lm,
    "op5_ngram_jaccard_join": near_duplicates.op5_ngram_jaccard_join,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_packing": packing.op8_packing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_language_id": language.op10_language_id,
}

SQL = {
    "op3_warc": warc.SQL,
    "op7_url_filters": url_filters.SQL,
}
