"""Golden cases of the operators on small fixtures."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import chatlog, evaluate, fusion, lexical, relational, vector
from loomlake.plans import agent, search
from loomlake.sources import notes
from loomlake.streaming import incremental

CITE = "question_id string, list_idx int, rank int, doc_id long, heading_path string, source string, topic_match boolean, document_date string, snippet string"


def first(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, tokens", [("歯", ["歯"]), ("あいうえお", ["あ", "い", "う", "え", "お", "あい", "いう", "うえ", "えお"]), ("Hello 歯車", ["hello", "歯", "車", "歯車"]), ("école", ["é", "cole"]), (" ,. ", [])])
def test_tokens(spark, text, tokens):
    assert first(spark, T.tokens(F.lit(text))) == tokens


@pytest.mark.parametrize("text, tokens", [("歯", ["歯"]), ("C 言語", ["c", "言語"]), ("a a b", ["a", "b"])])
def test_query_tokens(spark, text, tokens):
    assert first(spark, T.query_tokens(F.lit(text))) == tokens


def test_match_expressions(spark):
    assert first(spark, T.match_expression(F.lit('hello"world'))) == '"hello" OR "world"'
    assert first(spark, T.match_expression(F.lit("!?"))) is None


def test_scalars(spark):
    assert first(spark, T.token_estimate(F.lit("abcd"), F.lit("日本語"))) == 7
    assert first(spark, T.snippet_date(F.lit("[日付: 2026-09-01] 冒頭"))) == "2026-09-01"
    assert first(spark, T.snippet_body(F.lit("[日付: 2026-09-01] 冒頭"))) == "冒頭"
    assert first(spark, T.dated_snippet(F.lit(date(2026, 9, 1)), F.lit("x"))) == "[日付: 2026-09-01] x"
    assert first(spark, T.session_title(F.lit("a" * 41))) == "a" * 40 + "…"
    assert first(spark, T.is_negative(F.lit("  分かりません。"))) and not first(spark, T.is_negative(F.lit("あ" * 90 + "分かりません")))
    assert first(spark, T.is_abstention(F.lit("情報が見つかりませんでした"))) and not first(spark, T.is_abstention(F.lit("あ" * 160 + "わかりません"))) and first(spark, T.is_declined(F.lit("あ" * 160 + "わかりません")))
    assert first(spark, T.stem(F.lit("a/b.MD"))) == "b"


def bm25_fixture(spark):
    docs = spark.createDataFrame([(1, "1", "a/1.md"), (2, "1", "b/2.md")], "doc_id long, tree string, relative_path string")
    chunks = spark.createDataFrame([(1, 1, "title", "apple cherry"), (2, 1, "title", "banana apple apple apple apple apple"), (3, 2, "title", "banana banana")], "chunk_id long, doc_id long, heading_path string, text string")
    return docs, chunks


def ask(spark, text, tree="1"):
    return spark.createDataFrame([("q", text, tree)], "question_id string, text string, tree string")


def test_bm25_order(spark):
    docs, chunks = bm25_fixture(spark)
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert ids(lexical.bm25(chunks, docs, ask(spark, "banana"))) == [3, 2]
    assert ids(lexical.bm25(chunks, docs, ask(spark, "banana"), 1)) == [3]
    assert ids(lexical.bm25(chunks, docs, ask(spark, "banana", "2"))) == []
    assert ids(lexical.bm25(chunks, docs, ask(spark, "title"))) == [1, 2, 3]  # the heading alone qualifies; ties by id
    assert ids(lexical.grep(chunks, docs, ask(spark, "banana"), "a")) == [2]
    assert lexical.unindexed(chunks, lexical.postings(chunks.where("chunk_id < 3"))).count() == 1


def test_dot_needs_equal_lengths(spark):
    assert first(spark, vector.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vector.dot(F.col("a"), F.col("b"))).collect()


def test_top_k_and_folders(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, qvec array<double>")
    assert [r.vec_id for r in vector.top_k(v, q, 2).orderBy("rank").collect()] == [1, 3] and vector.top_k(v, q, 0).count() == 0
    folders = vector.folder_vectors(spark.createDataFrame([("a", [2.0, 0.0]), ("a", [4.0, 0.0]), ("b", [0.0, 0.0])], "path string, embedding array<double>"))
    assert {r.path: r.embedding for r in folders.collect()} == {"a": [1.0, 0.0], "b": [0.0, 0.0]}
    assert vector.nearest_folders(folders, q).first().path == "a"


def listed(spark, *rows):
    return spark.createDataFrame([("q", li, rk, d, h, s, False, None, "") for li, rk, d, h, s in rows], CITE)


def test_rrf_sums(spark):
    rows = listed(spark, (0, 0, 1, "x", "METADATA"), (0, 1, 2, "x", "METADATA"), (1, 0, 1, "x", "BM25"))
    out = fusion.rrf(rows).orderBy("rank").collect()
    assert out[0].score == pytest.approx(2 / 61) and out[1].score == pytest.approx(1 / 62) and out[0].source == "METADATA"
    assert fusion.rrf(rows, k=10).orderBy("rank").first().score == pytest.approx(2 / 11)
    assert fusion.rrf(rows, [1.5, 1.2]).orderBy("rank").first().score == pytest.approx(2.7 / 61)
    twice = listed(spark, (0, 0, 1, "x", "BM25"), (0, 1, 1, "x", "BM25"), (0, 2, 2, "y", "BM25"))
    assert fusion.rrf(twice).orderBy("rank").first().score == pytest.approx(1 / 61 + 1 / 62)
    with pytest.raises(Exception, match="as many weights"):
        fusion.rrf(rows, [1.0]).collect()


def test_collapse(spark):
    rows = [
        ("q", 0, 0, 1, "a#2", "VECTOR", False, None, "test"), ("q", 0, 1, 2, "b#1", "BM25", False, None, "test"), ("q", 0, 2, 1, "a#1", "METADATA", True, None, "test"), ("q", 0, 3, None, "フォルダ: x", "FOLDER", False, None, ""),
        ("q", 0, 4, 3, "c#1", "VECTOR", False, None, "関係する本文"), ("q", 0, 5, 3, "c#2", "METADATA", False, "2026-09-01", "冒頭"), ("q", 0, 6, 2, "b#2", "VECTOR", False, None, "test"),
    ]
    out = fusion.collapse(spark.createDataFrame(rows, CITE)).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 2, None, 3]
    assert out[0].heading_path == "a#1" and out[0].topic_match and out[1].heading_path == "b#1"
    assert (out[3].heading_path, out[3].snippet, out[3].document_date) == ("c#1", "関係する本文", "2026-09-01")


def ranked(spark, ids):
    return spark.createDataFrame([("q", i, d, f"h{d}") for i, d in enumerate(ids)], "question_id string, rank int, doc_id long, heading_path string")


def ids(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_keep_top(spark):
    assert ids(fusion.keep_top(ranked(spark, range(12)), ranked(spark, [0, 4, 6, 7, 9, 11, 2, 3, 8, 10]))) == [0, 4, 6, 7, 9, 11, 2, 3, 8, 1]


def test_date_pins(spark):
    hits = spark.createDataFrame([("q", d, f"2026-09-{d:02d}", 0) for d in (1, 2, 3, 4, 5, 6, 24)], "question_id string, doc_id long, document_date string, rank int")
    got = ids(fusion.date_pins(ranked(spark, [24]), ranked(spark, [24]), hits))
    assert got == [24, 1, 2, 3, 4]


def test_folder_pins(spark):
    paths = {1: "travel/京都", 2: "travel/沖縄", 3: "travel/キャンプ/長野", 4: "journal/2025-07", 5: "travel-plan/欧州"}
    scope = spark.createDataFrame([("q", d, p, 0) for d, p in paths.items() if p.startswith("travel/")], "question_id string, doc_id long, relative_path string, rank int")
    assert ids(fusion.folder_pins(ranked(spark, [4, 1]), ranked(spark, [4, 1]), scope)) == [1, 3, 2, 4]


def test_integration_budget(spark):
    rows = spark.createDataFrame([("q", 0, 1, "h", "x" * 40, 0.5, "BM25"), ("q", 1, 1, "h", "y", 0.1, "GREP"), ("q", 2, 2, "h", "z" * 400, 0.9, "VECTOR"), ("q", 3, 3, "h", "w", 0.5, "VECTOR")], "question_id string, rank int, doc_id long, heading_path string, snippet string, score double, source string")
    out = fusion.integrate(rows, 20).orderBy("rank").collect()
    assert [(r.doc_id, r.source) for r in out] == [(1, "GREP"), (2, "VECTOR")]  # the row that crosses the budget is in


def test_freshness(spark):
    f = lambda d: first(spark, fusion.freshness(F.lit(d).cast("date"), F.lit(date(2026, 1, 1))))
    assert f("2026-01-01") == pytest.approx(0.01) and f("2030-01-01") == pytest.approx(0.01) and f(None) == 0 and f("2025-01-01") == pytest.approx(0.00017, abs=1e-5)


def test_sessions(spark):
    s = spark.createDataFrame([(1, "Old", 1000), (2, "New", 2000), (3, "Q", 100), (4, "Empty", 50)], "session_id long, title string, created_at long")
    m = spark.createDataFrame([(1, 1, "user", "x", 3000), (2, 3, "user", "q1", 2000), (3, 3, "assistant", "a1", 3000), (4, 3, "user", "q2", 4000), (5, 3, "assistant", "a2", 5000)], "message_id long, session_id long, role string, content string, created_at long")
    out = {r.session_id: r for r in chatlog.summaries(s, m).collect()}
    assert out[1].updated_at == 3000 and out[2].updated_at == 2000 and (out[3].message_count, out[3].last_answer) == (4, "a2") and (out[4].message_count, out[4].last_answer) == (0, None)
    assert sorted(r.message_id for r in chatlog.without_last_exchange(m).collect()) == [2, 3]
    assert [r.message_id for r in chatlog.recent_messages(m, 2).where("session_id = 3").orderBy("turn_no").collect()] == [4, 5]
    day = 86_400_000
    b = lambda ms: first(spark, chatlog.bucket(F.lit(ms), F.lit(date(1970, 1, 31))))
    assert [b(n * day) for n in (40, 30, 29, 24, 23)] == ["TODAY", "TODAY", "YESTERDAY", "LAST_7_DAYS", "OLDER"]
    kept, msgs = chatlog.delete_sessions(s, m, s.where("session_id = 3").select("session_id"))
    assert kept.count() == 3 and msgs.count() == 1 and chatlog.restore(msgs, m, "message_id").count() == 5


def test_metrics(spark):
    cases = spark.createDataFrame([("a", ["X.md"], False, ["120000円", "b|c"]), ("none", [], False, []), ("none2", [], True, [])], "case_id string, expected array<string>, unanswerable boolean, facts array<string>")
    results = spark.createDataFrame([("a", 0, "p.md"), ("a", 1, None), ("a", 2, "x.MD"), ("none2", 0, "y.md")], "case_id string, rank int, relative_path string")
    out = {r.case_id: r for r in evaluate.per_case(cases, results).collect()}
    assert out["a"].precision == pytest.approx(1 / 3) and out["a"].recall == 1 and out["a"].reciprocal_rank == pytest.approx(1 / 2)
    assert (out["none"].precision, out["none"].recall) == (1, 1) and (out["none2"].precision, out["none2"].recall) == (0, 1)
    m = evaluate.macro(evaluate.per_case(cases, results)).first()
    assert m.cases == 3 and m.precision == pytest.approx((1 / 3 + 1) / 2)
    assert "| a |" in evaluate.report(evaluate.macro(evaluate.per_case(cases, results)), evaluate.per_case(cases, results))
    judged = evaluate.answers(cases, spark.createDataFrame([("a", "１２０，０００円でした"), ("none2", "わかりません")], "case_id string, answer string"))
    s = evaluate.answer_summary(judged).first()
    assert (s.answered, s.fact_recall, s.accuracy, s.decline_rate) == (1, 0.5, 0, 1)
    with pytest.raises(ValueError):
        evaluate.per_case(cases, results, 0)
    assert tuple(relational.upper_median(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), "v").first()) == (1, 3, 4)


@pytest.fixture()
def vault(tmp_path):
    for path, text in {"a.md": "﻿# A\nbanana", "sub/B.MD": "# B\n2024-05-06 apple", "_plan/c.md": "cherry", ".hidden/d.md": "no", "sub/.e.md": "no", "f.txt": "no"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    return f"file://{tmp_path}"


def test_scan(spark, vault, monkeypatch):
    rows = {r.relative_path: r for r in notes.scan(spark, vault).collect()}
    assert set(rows) == {"a.md", "sub/B.MD", "_plan/c.md"} and rows["a.md"].content == "# A\nbanana" and rows["sub/B.MD"].file_name == "B.MD"
    meta = {r.relative_path: r for r in notes.with_metadata(notes.scan(spark, vault), F.lit(date(2025, 1, 1))).collect()}
    assert meta["sub/B.MD"].document_date == date(2024, 5, 6) and meta["a.md"].headings == ["A"] and meta["a.md"].first_para == "banana"
    monkeypatch.setattr(notes, "MAX_BYTES", 10)
    assert {r.relative_path for r in notes.scan(spark, vault).collect()} == {"_plan/c.md"}
    with pytest.raises(Exception):
        notes.scan(spark, vault + "/missing")


def test_index_lifecycle(spark, vault):
    have = incremental.Tables(spark.createDataFrame([], "doc_id long, file_uri string, relative_path string, content_hash string"), spark.createDataFrame([], "chunk_id long, doc_id long, heading_path string, text string"))
    scan = notes.scan(spark, vault)
    one = incremental.refresh(have, scan)
    assert one.docs.count() == 3 and one.chunks.count() == 3
    ids_before = {r.file_uri: r.doc_id for r in one.docs.collect()}
    changed = scan.where("relative_path <> 'a.md'").withColumn("content", F.when(F.col("relative_path") == "_plan/c.md", "new text").otherwise(F.col("content")))
    two = incremental.refresh(one, changed)
    rows = {r.file_uri: r for r in two.docs.collect()}
    assert len(rows) == 2 and all(rows[u].doc_id == ids_before[u] for u in rows) and {r.text for r in two.chunks.collect()} == {"new text", "2024-05-06 apple"}
    partial = incremental.Tables(one.docs, one.chunks.where("text <> 'banana'"))
    assert incremental.refresh(partial, scan).chunks.count() == 3


def test_index_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"file_uri":"u1","relative_path":"a.md","content":"one","last_modified":1}\n{"file_uri":"u2","relative_path":"b.md","content":"two","last_modified":1}\n')
    go = lambda: incremental.index_stream(incremental.note_stream(spark, str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "in/2.json").write_text('{"file_uri":"u1","relative_path":"a.md","content":"three","last_modified":2}\n')
    go()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "ix/v1/chunks")).collect()} == {"two", "three"}


def test_citation_codec(spark):
    raw = '[{"heading_path":"h","snippet":"s","score":0.5,"source":"ODD"},{"heading_path":"g","source":"GREP","topic_match":true}]'
    got = first(spark, notes.citations_from(F.lit(raw)))
    assert [(c.source, c.topic_match) for c in got] == [("UNKNOWN", False), ("GREP", True)]
    assert first(spark, notes.citations_from(F.lit("{oops"))) == []


def test_eval_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id":"a","query":"q","expected":["x.md"],"note":"skip"}]')
    r = notes.eval_cases(spark, str(tmp_path / "c.json")).first()
    assert (r.case_id, r.expected, r.facts, r.unanswerable) == ("a", ["x.md"], [], False)
    (tmp_path / "d.json").write_text('[{"id":" ","query":"q"}]')
    with pytest.raises(Exception, match="without"):
        notes.eval_cases(spark, str(tmp_path / "d.json")).collect()


@pytest.fixture()
def index(spark):
    docs = spark.createDataFrame([(1, "t", "kyoto.md", "travel/kyoto.md", date(2024, 3, 5), "temple walk"), (2, "t", "camp.md", "travel/camp.md", date(2024, 7, 1), "tent fire"), (3, "t", "work.md", "work/work.md", None, "budget temple")], "doc_id long, tree string, file_name string, relative_path string, document_date date, content string")
    chunks = docs.select((F.col("doc_id") * 10).alias("chunk_id"), "doc_id", F.col("relative_path").alias("heading_path"), F.col("content").alias("text"))
    return search.Index(docs, chunks)


def test_search_and_ask(index):
    today = date(2025, 6, 10)
    assert ids(search.search(index, "temple", "t", today).rows)[:2] == [1, 3]
    assert ids(search.search(index, "去年の3月の temple", "t", today).rows)[0] == 1
    assert ids(search.search(index, "travelフォルダの temple", "t", today).rows)[:2] == [1, 2]
    assert ids(search.search(index, "temple", "other", today).rows) == []
    answer = agent.ask(index, "temple", "t", today)
    assert answer.kind == "MEMORY_SEARCH" and "temple walk" in answer.context and answer.rows[0]["heading_path"] == "全文"
    assert agent.ask(index, "temple の仕組み", "t", today).kind == "GENERAL_KNOWLEDGE"


def test_tools_and_loop(index):
    class Planned(search.NoModels):
        def __init__(self):
            self.plans = ["?", "TOOL: glob\nPATTERN: travel/*", "TOOL: read_file\nDOC_ID: 3", "TOOL: read_file\nPATH: nothing", "ACTION: finalize"]

        def plan(self, query, seen):
            return self.plans.pop(0)

    tools = agent.Tools(index, "t", date(2025, 6, 10), Planned())
    assert [r.heading_path for r in tools.list_dir("/").orderBy("rank").collect()] == ["travel", "work"]
    assert ids(tools.timeline_search("2024-01-01", "2024-12-31")) == [1, 2]
    assert ids(tools.grep("temple", "work")) == [3]
    out = agent.loop(tools, "q").orderBy("rank").collect()
    assert [(r.doc_id, r.source) for r in out] == [(3, "READ_FILE"), (1, "GLOB"), (2, "GLOB")]
    assert agent.hints("3月5日 kyoto.md を", index.docs, date(2024, 6, 1))["stems"] == ["travel/kyoto.md"]


def test_relational_rules(spark, index):
    docs = index.docs
    assert [tuple(r) for r in relational.list_dir(docs, "travel").orderBy("name").collect()] == [("file", "camp.md"), ("file", "kyoto.md")]
    assert relational.resolve_path(docs, "kyoto").first().doc_id == 1 and relational.resolve_path(docs, "nowhere").count() == 0
    assert relational.folder_groups(docs).count() == 2
    assert docs.where(T.under_folder(F.col("relative_path"), "trav")).count() == 0 and docs.where(T.under_prefix(F.col("relative_path"), "TRAV")).count() == 2
    assert [r.topic for r in relational.suggestion_topics(docs.withColumn("last_modified", F.col("doc_id"))).collect()] == ["work", "camp"]


def test_results_do_not_depend_on_partitions(spark):
    docs, chunks = bm25_fixture(spark)
    a = lexical.bm25(chunks.repartition(1), docs, ask(spark, "banana apple")).collect()
    b = lexical.bm25(chunks.repartition(7), docs.repartition(3), ask(spark, "banana apple")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
