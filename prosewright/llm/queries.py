"""The registered queries of this subpackage and their DuckDB twins."""

from prosewright.llm import archive, bpe, exact_dedup, line_dedup, mixing, near_dedup, outliers, quality, token_counts, urls

QUERIES = {
    "op1_url_host_words": urls.op1_url_host_words,
    "op2_quality_attention_mil": quality.op2_quality_attention_mil,
    "op3_token_length_histogram": token_counts.op3_token_length_histogram,
    "op4_line_dedup_chunks": line_dedup.op4_line_dedup_chunks,
    "op5_exact_dedup_bloom": exact_dedup.op5_exact_dedup_bloom,
    "op6_warc_from_arc": archive.op6_warc_from_arc,
    "op7_temperature_mixing": mixing.op7_temperature_mixing,
    "op8_near_dedup_chosen_path": near_dedup.op8_near_dedup_chosen_path,
    "op9_quality_mcd_outliers": outliers.op9_quality_mcd_outliers,
    "op10_bpe_speculate_verify": bpe.op10_bpe_speculate_verify,
}

ORACLE_SQL = {
    "op5_exact_dedup_bloom": exact_dedup.ORACLE_SQL,
    "op6_warc_from_arc": archive.ORACLE_SQL,
    "op8_near_dedup_chosen_path": near_dedup.ORACLE_SQL,
}
