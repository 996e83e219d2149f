"""Embedding plug-ins and the evaluation runner."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from loomlake.operators import embedding
from loomlake.plans import evaluation, search


def fragile(texts):
    if any("bad" in t for t in texts):
        raise ValueError("no")
    return [[float(len(t)), 1.0] for t in texts]


def test_batches_fall_back_to_items(spark):
    chunks = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(1, 12)], "chunk_id long, text string").repartition(1)
    got = {r.chunk_id: r.embedding for r in embedding.embed_chunks(chunks, fragile).collect()}
    assert set(got) == set(range(1, 12)) - {3} and got[5] == [5.0, 1.0]


def test_byte_codec_and_pooling(spark):
    r = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(embedding.to_bytes(F.col("v")).alias("b")).select("b", embedding.from_bytes(F.col("b")).alias("v")).collect()
    assert bytes(r[0].b) == np.array([1.5, -2.0], "<f4").tobytes() and r[0].v == [1.5, -2.0] and r[1].v is None
    pooled = embedding.mean_pool(np.array([[[3.0, 0.0], [9.0, 9.0]], [[0.0, 0.0], [1.0, 1.0]]]), np.array([[1, 0], [1, 0]]))
    assert pooled.tolist() == [[1.0, 0.0], [0.0, 0.0]]


def test_backfill_and_folders(spark):
    docs = spark.createDataFrame([("u1", None, "a/x.md", None), ("u2", date(2024, 1, 1), "a/y.md", ["H"])], "file_uri string, document_date date, relative_path string, headings array<string>")
    scan = spark.createDataFrame([("u1", date(2023, 1, 1)), ("u2", date(2023, 1, 1))], "file_uri string, document_date date")
    assert {r.file_uri: r.document_date.year for r in embedding.backfilled(docs, scan, ["document_date"]).collect()} == {"u1": 2023, "u2": 2024}
    old = spark.createDataFrame([("kept", [1.0])], "path string, embedding array<double>")
    assert [r.path for r in embedding.rebuilt_folders(old, docs, fragile).collect()] == ["a"]

    def broken(texts):
        raise ValueError

    assert [r.path for r in embedding.rebuilt_folders(old, docs, broken).collect()] == ["kept"]


def test_runner_goes_on_after_a_failure(spark):
    docs = spark.createDataFrame([(1, "t", "a.md", "n/a.md", None, "apple pie")], "doc_id long, tree string, file_name string, relative_path string, document_date date, content string")
    index = search.Index(docs, docs.select((F.col("doc_id") * 10).alias("chunk_id"), "doc_id", F.lit("n/a.md").alias("heading_path"), F.col("content").alias("text")))

    class Odd(search.NoModels):
        def expand(self, query):
            if query == "boom":
                raise RuntimeError("down")
            return [query]

    cases = spark.createDataFrame([("ok", "apple", ["n/a.md"], [], False), ("fails", "boom", ["n/a.md"], [], False)], "case_id string, query string, expected array<string>, facts array<string>, unanswerable boolean")
    scored, runs = evaluation.run(index, cases, "t", date(2025, 1, 1), models=Odd())
    assert {r.case_id: r.recall for r in scored.collect()} == {"ok": 1.0, "fails": 0.0}
    assert {r.case_id: r.error for r in runs.collect()} == {"ok": None, "fails": "RuntimeError: down"}


def test_suggestions_and_observations():
    make = lambda days, topics: evaluation.suggestions(days, topics, date(2025, 1, 10), "last", "this", "about {}", ["f1", "f2"])
    assert make([date(2024, 12, 3)], ["x", "y", "z"]) == ["last", "about x", "about y", "f1"] and make([date(2025, 1, 3)], []) == ["this", "f1"] and make([], []) == ["f1", "f2"]
    assert evaluation.observed([("a", "r" * 500), ("b", "s" * 500), ("c", "t" * 500)])[0] == "a: " + "r" * 120
