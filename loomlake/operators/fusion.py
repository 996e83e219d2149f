"""Rank fusion and the rules that reorder its result. Rank is always a column, from 0.

A citation row: question_id, list_idx, rank, doc_id?, heading_path, snippet, score,
relative_path?, source, topic_match, chunk_id?, document_date?. Operators keep other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

RRF_K, LIMIT, FINAL, KEEP, DATE_PINS, WEIGHTS = 60, 50, 10, 3, 5, {"meta": 1.5, "vector": 1.0, "bm25": 1.2}
FRESH_MAX, FRESH_DAYS, TOOL_BUDGET = 0.010, 90, 1200
# fixed value: sources in order of trust
SOURCES = ["READ_FILE", "GREP", "METADATA", "BM25", "VECTOR", "RRF", "GLOB", "FOLDER", "UNKNOWN"]


def dedupe_key(doc_id: Column, heading_path: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("::"), F.coalesce(heading_path, F.lit("")))


def freshness(day: Column, as_of: Column) -> Column:
    return F.when(day.isNull(), 0.0).otherwise(FRESH_MAX * F.exp(-F.greatest(F.datediff(as_of, day), F.lit(0)) / FRESH_DAYS))


def renumbered(rows: DataFrame, *order: Column | str, most: int | None = None) -> DataFrame:
    out = rows.withColumn("_place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    return (out if most is None else out.where(F.col("_place") <= most)).withColumn("rank", F.col("_place") - 1).drop("_place")


def rrf(rows: DataFrame, weights: list[float] | None = None, k: int = RRF_K, most: int | None = LIMIT, key: Column | None = None, bonus: Column | None = None) -> DataFrame:
    """Weighted reciprocal ranks summed over every occurrence of a key; the first seen row (lowest
    list, then rank) gives the payload and breaks ties."""
    if weights is not None and not weights:
        raise ValueError("no weights")
    weight = F.get(F.array(*map(F.lit, weights)), F.col("list_idx")) if weights else F.lit(1.0)
    if weights is not None:
        weight = F.when(F.col("list_idx") < len(weights), weight).otherwise(F.raise_error(F.lit("as many weights as lists are needed")).cast("double"))
    payload = [c for c in rows.columns if c not in ("question_id", "list_idx", "rank", "score")]
    keyed = rows.withColumn("_key", dedupe_key(F.col("doc_id"), F.col("heading_path")) if key is None else key)
    out = keyed.groupBy("question_id", "_key").agg(
        F.sum(weight / (k + F.col("rank") + 1)).alias("score"),
        F.min_by(F.struct("list_idx", F.col("rank").alias("first_rank"), *payload), F.struct("list_idx", "rank")).alias("p"),
    )
    out = out.select("question_id", "score", "p.*")
    if bonus is not None:
        out = out.withColumn("score", F.col("score") + bonus)
    return renumbered(out, F.desc(F.round("score", 9)), "list_idx", "first_rank", most=most).drop("list_idx", "first_rank")


def collapse(rows: DataFrame) -> DataFrame:
    """One row per document at its best place. The payload is the first topic match, else the best
    row; a date that only another row of the document knows is kept. Rows without a document pass."""
    group = Window.partitionBy("question_id", "doc_id")
    payload = [c for c in rows.columns if c not in ("question_id", "doc_id", "rank")]
    chosen = F.min_by(F.struct(*payload), F.struct(~F.coalesce("topic_match", F.lit(False)), F.col("rank")))
    dated = rows.withColumn("_day", F.min_by("document_date", F.when(F.col("document_date").isNotNull(), F.col("rank"))).over(group)) if "document_date" in payload else rows
    with_doc = dated.where("doc_id IS NOT NULL")
    extra = [F.first("_day").alias("_day")] if "document_date" in payload else []
    kept = with_doc.groupBy("question_id", "doc_id").agg(F.min("rank").alias("rank"), chosen.alias("p"), *extra).select("question_id", "doc_id", "rank", "p.*", *(["_day"] if extra else []))
    if extra:
        kept = kept.withColumn("document_date", F.coalesce("document_date", "_day")).drop("_day")
    return renumbered(kept.unionByName(rows.where("doc_id IS NULL")), "rank")


def identity_rerank(rows: DataFrame, most: int = FINAL) -> DataFrame:
    return rows.where(F.col("rank") < most)


def topic_first(rows: DataFrame, most: int = FINAL) -> DataFrame:
    return renumbered(rows, F.desc(F.coalesce("topic_match", F.lit(False))), "rank", most=most)


def keep_top(merged: DataFrame, reranked: DataFrame, keep: int = KEEP, most: int = FINAL) -> DataFrame:
    """The first ``keep`` fused documents that reranking dropped replace its last ones."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("heading_path"))
    held = reranked.withColumn("_k", key)
    lost = merged.where(F.col("rank") < keep).withColumn("_k", key).join(held.select("question_id", "_k"), ["question_id", "_k"], "left_anti")
    n = lost.groupBy("question_id").agg(F.count("*").alias("_n"))
    stay = held.join(n, "question_id", "left").where(F.col("rank") < most - F.coalesce("_n", F.lit(0))).drop("_n")
    both = stay.withColumn("_late", F.lit(0)).unionByName(lost.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return renumbered(both, "_late", "rank").drop("_late", "_k")


def pinned(reranked: DataFrame, merged: DataFrame, hits: DataFrame, order: str, pins: int, most: int = FINAL, drop_scope: DataFrame | None = None) -> DataFrame:
    """Puts the best ``pins`` of ``hits`` (citation rows with column ``order``) first: by their rank
    after reranking, then after fusion, then ``order``. Their other rows go; so do rows of
    ``drop_scope`` documents."""
    worst = F.lit(2**31 - 1)
    r = reranked.groupBy("question_id", "doc_id").agg(F.min("rank").alias("_r"))
    m = merged.groupBy("question_id", "doc_id").agg(F.min("rank").alias("_m"))
    top = hits.join(r, ["question_id", "doc_id"], "left").join(m, ["question_id", "doc_id"], "left")
    w = Window.partitionBy("question_id").orderBy(F.coalesce("_r", worst), F.coalesce("_m", worst), order, "doc_id")
    top = top.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= pins).drop("_r", "_m", order)
    gone = (top if drop_scope is None else drop_scope).select("question_id", "doc_id").distinct()
    rest = reranked.join(gone, ["question_id", "doc_id"], "left_anti").withColumn("_p", worst)
    return renumbered(top.drop("rank").withColumn("rank", F.lit(0)).unionByName(rest, allowMissingColumns=True), "_p", "rank", most=most).drop("_p")


def date_pins(reranked: DataFrame, merged: DataFrame, hits: DataFrame, order: str = "document_date") -> DataFrame:
    return pinned(reranked, merged, hits.withColumn("_o", F.col(order)), "_o", DATE_PINS)


def folder_pins(reranked: DataFrame, merged: DataFrame, scope: DataFrame) -> DataFrame:
    """``scope``: rows of every document under the folder."""
    return pinned(reranked, merged, scope.withColumn("_o", F.col("relative_path")), "_o", FINAL, drop_scope=scope)


def within_budget(rows: DataFrame, cost: Column, budget: int) -> DataFrame:
    """A prefix by rank; the row that crosses the budget is still taken."""
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).where(F.col("_spent") < budget).drop("_spent")


def integrate(rows: DataFrame, budget: int = TOOL_BUDGET) -> DataFrame:
    """Tool results: per key the most trusted source, then the higher score, then the earlier row;
    ordered by trust and score, cut by tokens."""
    trust = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    keyed = rows.withColumns({"_t": trust, "_k": dedupe_key(F.col("doc_id"), F.col("heading_path"))})
    w = Window.partitionBy("question_id", "_k").orderBy("_t", F.desc("score"), "rank")
    best = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")
    ordered = renumbered(best.withColumnRenamed("rank", "_seq"), "_t", F.desc("score"), "_seq").drop("_t", "_seq")
    return within_budget(ordered, token_estimate(F.col("heading_path"), F.col("snippet")) + 5, budget)


def hybrid(bm25: DataFrame, vector: DataFrame, folders: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """Unweighted fusion of chunks plus freshness, then up to five folder hits after the cut."""
    both = bm25.withColumn("list_idx", F.lit(0)).unionByName(vector.withColumn("list_idx", F.lit(1)), allowMissingColumns=True)
    fused = rrf(both, None, most=most, key=F.col("chunk_id").cast("string"), bonus=freshness(F.col("document_date"), as_of))
    tail = folders.where(F.col("rank") < 5).withColumn("_late", F.lit(1))
    return renumbered(fused.withColumn("_late", F.lit(0)).unionByName(tail, allowMissingColumns=True), "_late", "rank").drop("_late")
