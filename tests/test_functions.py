"""Golden values of the pure text, date and Markdown functions."""

from datetime import date

import pytest

from loomlake.functions import dates as D
from loomlake.functions import markdown as M
from loomlake.functions import text as T

TODAY = date(2025, 6, 10)


@pytest.mark.parametrize(
    "question, start, end",
    [
        ("Q1", "2025-01-01", "2025-03-31"), ("Q2", "2025-04-01", "2025-06-10"), ("去年のQ3", "2024-07-01", "2024-09-30"), ("FY2024Q3", "2024-07-01", "2024-09-30"), ("第1四半期", "2025-01-01", "2025-03-31"),
        ("令和6年3月のメモ", "2024-03-01", "2024-03-31"), ("平成30年", "2018-01-01", "2018-12-31"), ("昭和60年", "1985-01-01", "1985-12-31"), ("令和元年5月のメモ", "2019-05-01", "2019-05-31"), ("R6年の夏", "2024-06-01", "2024-08-31"),
        ("2024年冬", "2024-12-01", "2025-02-28"), ("一昨年の3月", "2023-03-01", "2023-03-31"), ("昨年の3月5日に行った店", "2024-03-05", "2024-03-05"), ("去年の年末年始に何した？", "2024-12-25", "2025-01-07"), ("去年の年末調整の書類どこ？", "2024-01-01", "2024-12-31"),
        ("2024/03/01 の件", "2024-03-01", "2024-03-01"), ("20240301", "2024-03-01", "2024-03-01"), ("2年前の4月", "2023-04-01", "2023-04-30"), ("3年前の春", "2022-03-01", "2022-05-31"), ("2024年の3月", "2024-03-01", "2024-03-31"), ("2024年末", "2024-12-25", "2024-12-31"),
        ("先月", "2025-05-01", "2025-05-31"), ("今月", "2025-06-01", "2025-06-10"), ("今年", "2025-01-01", "2025-06-10"), ("2023年のまとめ", "2023-01-01", "2023-12-31"), ("今年始めた運動", "2025-01-01", "2025-06-10"),
    ],
)
def test_periods(question, start, end):
    assert tuple(map(str, D.resolve_period(question, TODAY))) == (start, end)


@pytest.mark.parametrize("question", ["令和6年13月", "令和6年2月30日", "12345678 の件", "今年の冬", "2025年12月の予定", "来年の予定", "IT10年", "Q10", "FAQ1", "何もない"])
def test_no_period(question):
    assert D.resolve_period(question, TODAY) is None


@pytest.mark.parametrize(
    "question, days",
    [
        ("先週の月曜", ["2025-06-02"]), ("3日前のメモ", ["2025-06-07"]), ("一昨日", ["2025-06-08"]), ("昨日", ["2025-06-09"]), ("先週のまとめ", [f"2025-06-0{i}" for i in range(2, 9)]), ("今週の水曜", ["2025-06-09", "2025-06-10"]),
        ("12月25日", ["2024-12-25"]), ("6月11日に何した？", ["2024-06-11"]), ("2024.03.01", ["2024-03-01"]), ("2024.13.01", []), ("2027年3月5日", []), ("2月30日", []), ("正月", [f"2025-01-0{i}" for i in range(1, 8)]), ("年末", [f"2024-12-{i}" for i in range(25, 32)]),
    ],
)
def test_days(question, days):
    assert sorted(map(str, D.resolve_days(question, TODAY))) == days


def test_recent_days_and_months():
    assert len(D.resolve_days("最近", TODAY)) == 15 and len(D.resolve_days("先月", TODAY)) == 31 and len(D.resolve_days("5月", TODAY)) == 31


@pytest.mark.parametrize("path, day", [("notes/2024_12_15.md", "2024-12-15"), ("journal/202412.md", "2024-12-01"), ("contacts/1234-5678.md", None), ("notes/2024-13-50.md", None), ("notes/2024-02-30.md", None), ("notes/1850-01-01.md", None), ("journal/2024-12/2024-12-15.md", "2024-12-15"), ("a/2024年3月.md", "2024-03-01"), ("a/2024.3.4.md", "2024-03-04")])
def test_path_dates(path, day):
    assert D.date_from_path(path, TODAY) == (day and date.fromisoformat(day))


@pytest.mark.parametrize(
    "text, day",
    [("読了日：2025年5月3日", "2025-05-03"), ("- 読了: 2025年5月", "2025-05-01"), ("本文だけ 2025年5月に読了した", None), ("---\ndate: 2024-01-02\n---\nx 2023-01-01", "2024-01-02"), ("created: 2099-01-01\nthen 2024/5/6", "2024-05-06"), ("# 2024年12月15日\nx", "2024-12-15"), ("# 2024年12月\n## 2024年11月3日", "2024-11-03"), ("no date", None)],
)
def test_content_dates(text, day):
    assert D.date_from_content(text, TODAY) == (day and date.fromisoformat(day))


def test_chunk_sizes():
    assert [len(t) for _, t in M.chunks("A" * 1000, "t.md")] == [800, 320]
    digits = "".join(str(i % 10) for i in range(2500))
    got = [t for _, t in M.chunks(digits, "t.md")]
    assert [len(t) for t in got] == [800, 800, 800, 460] and all(a[-120:] == b[:120] for a, b in zip(got, got[1:]))


def test_chunk_headings():
    assert M.chunks("# Section 1\nBody 1\n\n# Section 2\nBody 2", "test.md") == [("test.md > Section 1", "Body 1"), ("test.md > Section 2", "Body 1\n\nBody 2")]
    assert [h for h, _ in M.chunks("# H1\na\n## H2\nb\n# H1-2\nc", "t.md")] == ["t.md > H1", "t.md > H1 > H2", "t.md > H1-2"]
    assert M.chunks("# S1\n\n# S2\nBody 2", "t.md") == [("t.md > S2", "Body 2")]
    assert M.chunks("  \n ", "t.md") == []
    assert M.chunks("---\ntags: a\n---\n# H\nx", "t.md") == [("t.md > H", "x"), ("t.md", "tags: a")]
    assert M.chunks("---\nabc", "t.md") == [("t.md", "---\nabc")]


def test_fences_are_not_split():
    code = "```\n" + "x = 1\n\n\n" * 5 + "```"
    assert any("```" in p and p.count("x = 1") == 5 for p in M.paragraphs("before\n\n\n" + code + "\n\n\nafter"))


def test_notes_metadata():
    note = "---\n# not a heading\n---\n# A\n![pic](x)\nFirst line\nsecond\n\nthird #tag1 ##no #日記 #tag1"
    assert M.headings(note) == ["A"] and M.first_paragraph(note) == "First line second" and M.tags(note)[-2:] == ["tag1", "日記"]


def test_reassembly():
    parts = [("p > A", "one " * 50), ("p > A", ("one " * 50)[-100:] + "two"), ("p > B", "three")]
    text = M.reassembled(parts, 1, 1500)
    assert text.count("## A") == 1 and text.count("## B") == 1 and text.endswith("three") and text.count("one") == 50
    assert M.reassembled([("p", "a" * 900), ("p", "b" * 900), ("p", "c" * 900)], 1, 1500) == "…\n\n" + "b" * 900 + "\n\n…"


@pytest.mark.parametrize("pattern, path, ok", [("*.txt", "file.txt", True), ("*.txt", "dir/file.txt", False), ("2026/06/*", "2026/06/日記.md", True), ("2026/06/*", "2026/06/sub/x.md", False), ("src/**/*.kt", "src/Main.kt", True), ("2026/0?.md", "2026/06.md", True), ("dir?file.txt", "dir/file.txt", False), ("file[name].txt", "file[name].txt", True)])
def test_globs(pattern, path, ok):
    import re

    assert bool(re.match(T.glob_regex(pattern), path)) == ok


def test_explicit_folders():
    paths = ["travel/a.md", "travel/キャンプ/b.md", "travel-plan/c.md", "work/meetings/d.md", "work/e.md", "food/レシピ/f.md", "meetings/g.md", "archive/2020/meetings/h.md"]
    for question, folder in {"travel-planにある行きたい場所": "travel-plan", "work/meetings の議事録を一覧で": "work/meetings", "workフォルダの中身": "work", "キャンプフォルダの中身": "travel/キャンプ", "meetingsフォルダの議事録": "meetings", "travelplan について": None, "作ったことのある料理のレシピ一覧": None, "how does work go": None}.items():
        assert T.explicit_folder(question, paths) == folder, question


def test_enumeration_scope():
    paths = ["travel/1", "travel/2", "travel/キャンプ/3"] + [f"journal/{i}" for i in range(9)] + ["journal/old/9"]
    assert T.enumeration_scope("travel/キャンプ", paths) == "travel" and T.enumeration_scope("journal/old", paths) == "journal/old" and T.enumeration_scope("journal", paths) is None


def test_parsers_never_fail():
    assert T.quoted_elements('x ["a", \'b\', ""] y') == ["a", "b"] and T.quoted_elements("none") == [] and T.json_list("{") == [] and T.json_list("[1]") == [1]
    assert T.coverage_answer("well\nno, dates, names") == (False, ["dates", "names"]) and T.coverage_answer("note: none") == (True, []) and T.coverage_answer("yes") == (True, [])
    assert T.planned_call("TOOL: grep\nQUERY: x\nSCOPE: a/b") == ("grep", {"query": "x", "scope": "a/b"})
    assert T.planned_call("TOOL: rrf-search\nQUERY: x\nK: q") == ("rrf_search", {"query": "x", "k": 10})
    assert T.planned_call("TOOL: read_file") is None and T.planned_call("TOOL: what") is None and T.planned_call("") is None
    assert T.planned_call("ACTION: Finalize\nREASON: done") == ("finalize", {"reason": "done"})


def test_facts():
    assert T.has_fact("費用は１２０，０００円", "120000円") and T.has_fact("Alex さん", "bob|alex") and not T.has_fact("x", "|")


def test_classes():
    assert T.classify("去年のQ3", True) == "TEMPORAL_SUMMARIZATION" and T.classify("昨日のメモ", False) == "MEMORY_SEARCH" and T.classify("光合成の仕組み", False) == "GENERAL_KNOWLEDGE" and T.classify("hello", False) == "MEMORY_SEARCH"


def test_like_escape():
    assert T.like_escape(r"a%b_c\d") == r"a\%b\_c\\d"
