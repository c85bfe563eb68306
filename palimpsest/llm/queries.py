"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from palimpsest.llm import (
    bpe, chat, decontamination, exact_dedup, filter_audit, packing, pitman_yor, quality_rules, simhash, spelling_variants, suffix_dedup, token_counts, warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_pitman_yor": pitman_yor.op6_pitman_yor,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op9_chat": chat.op9_chat,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op9_chat": chat.OP9_SQL,
    "op11_spelling_variants": spelling_variants.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
