"""One query per operator (contract columns), and the pipeline."""

from __future__ import annotations

from bayes_ops.llm import (audit, chat, decontaminate, langid, lattice, lines, mixing, ngram_join, pack, quality, simhash, urls, whitening)
from bayes_ops.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return lines.dedup(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return pack.assign(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_lm_scoring, op3_simhash, op4_line_dedup, op5_language_id, op6_sharding,
    op7_chat_format, op8_mixing, op9_url_filter, op10_decontamination,
    op11_filter_audit, op12_whitening, op13_ngram_join)}
