"""The operators as named queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from keepwise.llm import (
    bpe,
    chat,
    exact_topk,
    filter_audit,
    hilbert_ann,
    license_scan,
    mixing,
    near_dup,
    oracle,
    quality,
    source_audit,
    substring_dedup,
    toxicity,
    warc,
)
from keepwise.llm.common import table


def op1_tensored_minhash(spark, sf_dir):
    return near_dup.op1(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark, sf_dir):
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_block_topk(spark, sf_dir):
    return exact_topk.op4(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark, sf_dir):
    return chat.op5(table(spark, sf_dir, "conversations"))


def op6_block_anchors(spark, sf_dir):
    return substring_dedup.op6(table(spark, sf_dir, "documents"))


def op7_quality_ftrl(spark, sf_dir):
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hilbert_ann(spark, sf_dir):
    return hilbert_ann.op8(table(spark, sf_dir, "embeddings"))


def op9_word_table_bpe(spark, sf_dir):
    return bpe.op9(table(spark, sf_dir, "documents"))


def op10_cube_mix(spark, sf_dir):
    return mixing.op10(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return source_audit.op11(table(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    return toxicity.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_tensored_minhash": op1_tensored_minhash,
    "op2_license_scan": op2_license_scan,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_block_topk": op4_block_topk,
    "op5_chat_format": op5_chat_format,
    "op6_block_anchors": op6_block_anchors,
    "op7_quality_ftrl": op7_quality_ftrl,
    "op8_hilbert_ann": op8_hilbert_ann,
    "op9_word_table_bpe": op9_word_table_bpe,
    "op10_cube_mix": op10_cube_mix,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {
    "op1_tensored_minhash": oracle.NEAR_DUPLICATES,
    "op3_warc_revisits": oracle.REVISITS,
    "op4_block_topk": exact_topk.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_block_anchors": oracle.REPEATED_PASSAGES,
    "op11_source_divergence": source_audit.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
