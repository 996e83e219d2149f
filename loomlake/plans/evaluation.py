"""Runs labelled questions through search or the whole agent and scores them."""

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import DataFrame

from ..operators import evaluate
from . import agent
from .search import Index, Models, search

RESULTS = "case_id string, rank int, relative_path string"
RUNS = "case_id string, answer string, duration_ms long, error string"


def run(index: Index, cases: DataFrame, tree: str, today: date, k: int = 10, models: Models | None = None, answers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per-case metrics, runs). A case that fails has no results and its error; the others go on.
    Labelled cases are few, and each is a plan of its own, so the driver steps through them."""
    results, runs = [], []
    for case in cases.select("case_id", "query").orderBy("case_id").collect():
        began, answer, error = time.time(), None, None
        try:
            if answers:
                got = agent.ask(index, case.query, tree, today, models)
                rows, answer = got.rows, got.context
            else:
                rows = [r.asDict() for r in search(index, case.query, tree, today, models).rows.orderBy("rank").collect()]
            results += [(case.case_id, i, r.get("relative_path")) for i, r in enumerate(rows)]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:300]
        runs.append((case.case_id, answer, int((time.time() - began) * 1000), error))
    spark = cases.sparkSession
    return evaluate.per_case(cases, spark.createDataFrame(results, RESULTS), k), spark.createDataFrame(runs, RUNS)


def observed(steps: list[tuple[str, str]], full: int = 2, short: int = 120) -> list[str]:
    """What a planner sees of its (call, result) steps: the newest in full, older ones cut."""
    return [f"{call}: {result if i >= len(steps) - full else result[:short]}" for i, (call, result) in enumerate(steps)]


def suggestions(days: list[date], topics: list[str], today: date, last_month: str, this_month: str, topic: str, fallback: list[str]) -> list[str]:
    """Example questions: a period that has notes, up to two topics, and one fixed one; all fixed ones if there are none."""
    before = (today.year - (today.month == 1), (today.month - 2) % 12 + 1)
    months = {(d.year, d.month) for d in days}
    period = [last_month] if before in months else [this_month] if (today.year, today.month) in months else []
    found = period + [topic.format(t) for t in topics[:2]]
    return found + fallback[:1] if found else fallback


def expansion_prompt(query: str, most: int = 8) -> str:
    return f"Write up to {most} short search queries for the question below as a JSON array of strings.\nQuestion: {query}"


def hypothetical_prompt(query: str, chars: int = 280) -> str:
    return f"Write a note of at most {chars} characters that would answer the question below.\nQuestion: {query}"


def rerank_prompt(query: str, snippets: list[str], most: int = 10) -> str:
    listed = "\n".join(f"[{i}] {s[:300]}" for i, s in enumerate(snippets))
    return f"List the numbers of the {most} most useful passages, best first, as a JSON array.\nQuestion: {query}\n{listed}"
