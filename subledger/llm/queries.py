"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from subledger.llm import (
    byte_bpe,
    decontamination,
    filter_audit,
    licenses,
    mixing_coder,
    ngram_join,
    pair_index,
    quality,
    secrets,
    spelling,
    substring_dedup,
    token_counts,
    topk,
)


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_token_output": mixing_coder.op6_token_output,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_exact_topk": topk.op9_exact_topk,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_pair_index_bpe": pair_index.op13_pair_index_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op5_ngram_join": ngram_join.OP5_SQL,
        "op9_exact_topk": topk.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
    }
