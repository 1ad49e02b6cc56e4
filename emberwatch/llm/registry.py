"""The operators' queries by name, and the SQL of those that SQL can express."""

from emberwatch.llm import bpe, fill_middle, filter_audit, fingerprint, language_id, license_scan, line_dedup, near_dedup, packing, topk, unigram, url_filter, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_document_fingerprints": fingerprint.op2_document_fingerprints,
    "op3_warc": warc.op3_warc,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_counts": unigram.op8_token_counts,
    "op9_language_id": language_id.op9_language_id,
    "op10_top_k": topk.op10_top_k,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_license_scan": license_scan.op13_license_scan,
}
SQL = {
    "op3_warc": warc.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op10_top_k": topk.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_license_scan": license_scan.SQL,
}
