"""The driver's contract, and SQL equality of a few registered queries on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["question_id", "rank", "doc_id", "chunk_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_top_docs", "rrf_weighted", "collapse_by_doc", "session_summary", "snapshot_diff", "ngram_tokens", "retrieval_metrics"])
def test_queries_equal_their_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    assert got == sorted(repr([plain(r[at.index(c)]) for c in cols]) for r in cur.fetchall())
