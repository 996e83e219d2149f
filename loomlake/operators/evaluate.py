"""Retrieval and answer metrics over labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def per_case(cases: DataFrame, results: DataFrame, k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """One row per case: precision and recall at k, reciprocal rank, candidate recall.
    ``cases``: (case_id, expected array<string>, unanswerable); ``results``: (case_id, rank,
    relative_path?). Duplicates of a hit count once, but every row counts in precision's
    divisor; ranks skip rows without a path; paths compare without case."""
    if k <= 0:
        raise ValueError("k must be positive")
    want = cases.select("case_id", F.array_distinct(F.transform(F.coalesce("expected", F.array().cast("array<string>")), F.lower)).alias("want"), "unanswerable")
    top = results.where(F.col("rank") < k).groupBy("case_id").agg(F.count("*").alias("rows"), F.transform(F.array_sort(F.collect_list(F.when(F.col("relative_path").isNotNull(), F.struct("rank", F.lower("relative_path").alias("p"))))), lambda x: x["p"]).alias("paths"))
    pool = (results if candidates is None else candidates).where("relative_path IS NOT NULL").groupBy("case_id").agg(F.collect_set(F.lower("relative_path")).alias("pool"))
    none = F.array().cast("array<string>")
    c = want.join(top, "case_id", "left").join(pool, "case_id", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "paths": F.coalesce("paths", none), "pool": F.coalesce("pool", none)})
    c = c.withColumn("hits", F.array_intersect("want", "paths"))
    n_want, n_hits = F.size("want"), F.size("hits")
    first = F.array_min(F.transform(F.col("hits"), lambda h: F.array_position(F.col("paths"), h)))
    found = F.size(F.array_intersect("want", F.array_union("pool", "hits")))
    return c.select(
        "case_id",
        "unanswerable",
        F.when(F.col("rows") > 0, n_hits / F.col("rows")).otherwise((n_want == 0).cast("double")).alias("precision"),
        F.when(n_want > 0, n_hits / n_want).otherwise(1.0).alias("recall"),
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.when(n_want > 0, found / n_want).otherwise(1.0).alias("candidate_recall"),
        F.array_sort("hits").alias("hits"),
        F.array_sort(F.array_except("want", "hits")).alias("missed"),
        F.array_sort(F.array_intersect(F.array_except("want", "hits"), "pool")).alias("dropped"),
    )


def macro(cases: DataFrame) -> DataFrame:
    """Averages over answerable cases."""
    mean = lambda c: F.coalesce(F.avg(F.when(~F.coalesce("unanswerable", F.lit(False)), F.col(c))), F.lit(0.0))
    return cases.agg(F.count("*").alias("cases"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("candidate_recall").alias("candidate_recall"))


def best_scores(cases: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """(case_id, expected_score, other_score) of vector hits (case_id, relative_path, score)."""
    want = cases.select("case_id", F.transform("expected", F.lower).alias("want"))
    good = F.array_contains("want", F.lower("relative_path"))
    return vector_hits.join(want, "case_id").groupBy("case_id").agg(F.max(F.when(good, F.col("score"))).alias("expected_score"), F.max(F.when(~good, F.col("score"))).alias("other_score"))


def answers(cases: DataFrame, given: DataFrame) -> DataFrame:
    """Per case with an answer: fact_recall (null without facts), complete, abstained, declined."""
    facts = cases.select("case_id", "unanswerable", F.explode_outer("facts").alias("fact")).join(given.select("case_id", "answer"), "case_id")
    hit = facts.withColumn("hit", F.when(F.col("fact").isNotNull(), T.has_fact_of(F.col("answer"), F.col("fact"))))
    return hit.groupBy("case_id", "unanswerable", "answer").agg(F.avg(F.col("hit").cast("double")).alias("fact_recall")).select("case_id", "unanswerable", "fact_recall", (F.col("fact_recall") == 1).alias("complete"), T.is_abstention(F.col("answer")).alias("abstained"), T.is_declined(F.col("answer")).alias("declined"))


def answer_summary(judged: DataFrame) -> DataFrame:
    plain = ~F.coalesce("unanswerable", F.lit(False))
    scored = plain & F.col("fact_recall").isNotNull()
    return judged.agg(
        F.count_if(scored).alias("answered"),
        F.coalesce(F.avg(F.when(scored, F.col("fact_recall"))), F.lit(0.0)).alias("fact_recall"),
        F.coalesce(F.avg(F.when(scored, F.col("complete").cast("double"))), F.lit(0.0)).alias("accuracy"),
        F.count_if(plain & F.col("abstained")).alias("abstentions"),
        F.coalesce(F.avg(F.when(~plain, F.col("declined").cast("double"))), F.lit(0.0)).alias("decline_rate"),
    )


def report(summary: DataFrame, cases: DataFrame, k: int = 10) -> str:
    """A Markdown report of the metrics (a bounded number of labelled cases)."""
    m = summary.first()
    rows = cases.orderBy("case_id").collect()
    lines = ["# Retrieval report", "", f"- cases: {m.cases}", f"- P@{k}: {m.precision:.2f}", f"- R@{k}: {m.recall:.2f}", f"- MRR: {m.mrr:.2f}", f"- candidate recall: {m.candidate_recall:.2f}", "", "| case | P | R | RR | missed |", "|-|-|-|-|-|"]
    return "\n".join(lines + [f"| {r.case_id} | {r.precision:.2f} | {r.recall:.2f} | {r.reciprocal_rank:.2f} | {', '.join(r.missed)} |" for r in rows]) + "\n"
