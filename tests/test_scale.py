"""What registered queries read and write, and that the smaller ways give the results of the larger ones."""

import re

import pytest
from pyspark.sql import functions as F

from loomlake.functions import markdown
from loomlake.functions import text as T
from loomlake.operators import lexical
from loomlake.plans import catalog
from loomlake.sources import notes

WORDS = ["collapse_by_doc", "bm25_headings", "rrf_freshness", "bm25_multi_query", "bm25_topk", "grep_scoped"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_are_those_of_the_pattern(spark):
    text = "".join(map(chr, [*range(0x3100), *range(0xFE00, 0x10000), 0x20BB7, 0x1F600]))
    parts = spark.createDataFrame([(c,) for c in re.findall("(?s).{1,50}", re.sub("[\ud800-\udfff]", "", text))], "c string")
    old = F.lower(F.regexp_replace("c", r"[\x00-\x7F&&[^A-Za-z0-9]]|\s|　", " "))
    assert parts.where(~T.normalised(F.col("c")).eqNullSafe(old)).count() == 0


@pytest.mark.parametrize("text", ["", " ,", "a B  a.", "école à l'eau", "Hello 歯車 x", "あいう、えお 𠮷野", None])
def test_bag_holds_the_tokens(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.sort_array(T.tokens(F.col("t"))), F.sort_array(T.token_bag(F.col("t")))).first()
    assert row[0] == row[1]


def test_index_of_asked_terms_scores_as_the_whole_one(spark, small, tmp_path):
    docs, chunks, q = catalog._model(spark, small)
    chunks = chunks.withColumn("heading_path", F.when(F.col("chunk_id") % 3 == 0, F.lit("de la Eau")).when(F.col("chunk_id") % 3 == 1, F.lit("")))
    whole, asked = lexical.index(chunks), notes.store_asked(chunks, q, str(tmp_path / "asked"))
    assert asked.stats.collect() == whole.stats.collect()
    terms = {t for v in catalog.ASKED.values() for t in v.split()}
    assert {r.term for r in asked.postings.select("term").distinct().collect()} <= terms
    rows = lambda i: sorted((*r[:4], round(r[4], 9)) for r in lexical.bm25(chunks, docs, q, words=i).select("question_id", "rank", "chunk_id", "doc_id", "score").collect())
    assert rows(asked) == rows(whole) == rows(None) and len(rows(asked)) > 20


def test_no_chunks_at_all(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, doc_id long, heading_path string, text string")
    q = spark.createDataFrame([("q", "a", "t")], "question_id string, text string, tree string")
    assert notes.store_asked(none, q, str(tmp_path / "none")).stats.collect() == [(0, 1.0, 1.0)]


@pytest.mark.parametrize("name", WORDS)
def test_texts_are_read_once_and_no_more_by_the_plan(spark, small, name):
    """Once what is asked is stored, a query reads no text to score or to place a chunk."""
    assert "text:string" not in plan(catalog.QUERIES[name](spark, small))


def test_postings_are_of_asked_terms(spark, small):
    assert catalog._words(spark, small).postings.select("term").distinct().count() <= 10


def test_notes_reach_python_by_the_hundred(spark):
    """A batch of long notes does not grow with the table: no Arrow batches, and the chunks are those of the function."""
    texts = {1: "# A\n" + "x y " * 600, 2: "", 3: None, 4: "---\nk: v\n---\nplain"}
    notes_ = spark.createDataFrame([(k, f"n/{k}.md", v) for k, v in texts.items()] + [(k, "p.md", "b " * 500) for k in range(5, 305)], "doc_id long, relative_path string, content string")
    out = markdown.chunk_notes(notes_)
    assert "BatchEvalPython" in plan(out) and "MapInPandas" not in plan(out) and "Arrow" not in plan(out)
    got = sorted(out.select("doc_id", "idx", "heading_path", "text").collect())
    assert got == sorted((r.doc_id, i, h, t) for r in notes_.collect() for i, (h, t) in enumerate(markdown.chunks(r.content or "", r.relative_path)))


@pytest.mark.parametrize("name", ["date_pins", "keep_rrf_top", "folder_pins"])
def test_fused_rows_are_made_once(spark, small, name):
    """Fusion is asked for two or three times by the rules after it; vectors and the index are not read again for each."""
    read = catalog.QUERIES[name](spark, small).inputFiles()
    assert any("/rows-" in f for f in read) and not any("embeddings" in f or "/words-" in f for f in read)


def test_headings_come_with_their_windows(spark, small):
    """A chunk's heading path is of its own row; no join moves the texts."""
    docs, chunks = notes.from_tables(spark, small, headings=True)
    assert "Exchange" not in plan(chunks) and "Join" not in plan(chunks)
    joined = notes.from_tables(spark, small)[1].drop("heading_path").join(docs.select("doc_id", F.regexp_extract("relative_path", "^(.*)/", 1).alias("heading_path")), "doc_id")
    cols = ["chunk_id", "doc_id", "heading_path", "text"]
    assert sorted(chunks.select(cols).collect()) == sorted(joined.select(cols).collect())
