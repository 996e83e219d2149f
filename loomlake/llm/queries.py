"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import ann, bpe, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, suffix_dedup, url_filter
from .common import read

VOCAB = "byte_bpe_50k.tiktoken"


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.find(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.report(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), public_tokenizers.PATTERN)


def op6_line_dedup(spark, sf_dir):
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.report(read(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.report(read(spark, sf_dir, "pages"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark, sf_dir):
    return ann.report(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_suffix_dedup, op3_pii, op4_quality_rules, op5_byte_bpe, op6_line_dedup, op7_mixing, op8_url_filter, op9_ngram_join, op10_nearest_neighbours)}
ORACLES = {"op4_quality_rules": quality_rules.oracle(), "op7_mixing": mixing.oracle(), "op8_url_filter": url_filter.oracle()}
