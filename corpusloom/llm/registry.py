"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from . import bpe, chat_format, chat_repair, exact_dedup, html_extract, line_dedup, merkle, mixing, ngram_join, quality_rules, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_html_crf": html_extract.op1_html_crf,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_url_templates": url_filter.op3_url_templates,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_entropy_mixing": mixing.op5_entropy_mixing,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_conversation_repair": chat_repair.op11_conversation_repair,
    "op12_chat_windows": chat_format.op12_chat_windows,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "ablation_quality_rules": quality_rules.ablation_quality_rules,
}
ORACLES = {
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op3_url_templates": url_filter.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_conversation_repair": chat_repair.ORACLE,
    "op12_chat_windows": chat_format.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
    "ablation_quality_rules": quality_rules.ABLATION_ORACLE,
}
