"""The registered queries of this subpackage and their DuckDB SQL."""

from siftwell.llm import centroids, decontaminate, exactdedup, langid, packing, periods, quality, secrets, simhash, substrings, tokenfile, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_packing": packing.op6_packing,
    "op7_token_file": tokenfile.op7_token_file,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "quality_ablations": quality.quality_ablations,
    "quality_errors": quality.quality_errors,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_exact_dedup": exactdedup.op11_exact_dedup,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

#: Queries not listed here have no SQL form that is exact on whole tables; their tests compare
#: them with brute force, round trips or held-out accuracy.
ORACLE_SQL = {
    "op1_url_filter": urlfilter.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
    "quality_errors": quality.ERRORS_SQL,
    "op11_exact_dedup": exactdedup.OP11_SQL,
    "op12_centroid_clusters": centroids.OP12_SQL,
}
