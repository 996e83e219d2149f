"""A training corpus out of ``documents``: quality rules, line dedup, near duplicates, mixing, tokens.

Each stage gets all rows its predecessor kept and returns rows with the columns of
``documents``, but for the last, which returns token ids. ORACLE_SQL is None: links of
near duplicates and BPE have no SQL form; tests hold run() against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from loomlake.llm.common import Scratch, content_key, read

VOCAB = "byte_bpe_50k.tiktoken"
_held: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """A new stage's tables; those of finished stages, whose output is written, go."""
    while _held:
        _held.pop().clear()
    _held.append(Scratch(spark))
    return _held[-1]


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    counted = rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
    return counted.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; documents that fail the rules or are depleted go."""
    _scratch(spark)
    return _as_documents(quality_rules.clean(docs), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; documents of which nothing is left go."""
    rows = line_dedup.dedup(docs, scratch=_scratch(spark))
    return _as_documents(rows.where("n_removed_lines = 0 OR n_removed_lines < n_lines"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; rows without an id stay. Rows equal
    in id and text are one document; different texts under one id are decided apart, and in one
    group the one with the smallest hash of its text goes before the others."""
    key = ["doc_id", "ck1", "ck2", "void"]
    c1, c2 = content_key(F.col("text"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", c1, c2, F.col("text").isNull().alias("void"))
    groups = ngram_join.link(keyed, scratch=_scratch(spark), carry=tuple(key[1:]))
    later = groups.where("doc_id IS NOT NULL AND NOT leads").select(*key).distinct()
    kept = keyed.where("doc_id IS NOT NULL").join(later, key, "left_anti").dropDuplicates(key)
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that kept tokens have the raked proportions."""
    return mixing.sample(docs, scratch=_scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, packed ids, and digests of the ids and of their decoded bytes."""
    _scratch(spark)
    vocab = public_tokenizers.path(VOCAB)
    encoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab, public_tokenizers.PATTERN), vocab)
    return encoded.select("doc_id", "lang", "source", F.expr("bigint(length(ids_le) / 4)").alias("n_tokens"), "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, kept = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = kept.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
