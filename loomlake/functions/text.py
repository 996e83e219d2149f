"""Text expressions: n-gram tokens, paths, globs, small parsers. Built-in functions wherever one exists."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUERY_TERMS = 100
# --- fixed values: word lists and patterns that decide results ---
MEMORY_WORDS = "何してた 何した 何やってた 何やった 覚えてる 覚えている 思い出 日記 メモ ノート 記録 まとめ 書いた 書いてた 作った 作ってた 自分 私 僕 俺 うち 振り返り 振り返る 調べた 調べてた 勉強した 学んだ 読んだ".split()
GENERAL_PATTERNS = [
    r"とは[何なに]?[？?]?$",
    r"の仕組み",
    r"なぜ.{0,10}[？?]",
    r"どういう意味",
    r"の意味は",
    r"を説明して",
    r"[A-Za-z][A-Za-z0-9_]{2,}\s*(と(は|って)|の使い方|の書き方)",
]
ENUMERATION = "全部|全て|すべて|一覧|これまで[にの]"
NEGATIVE_WORDS = ["お答えできません", "分かりません", "わかりません", "情報が見つかりません", "見つかりませんでした", "知識ベースにはありません", "一般的な知識で回答します"]
ABSTAIN = "(情報|記載|記述|記録)(が|は)?(見つかり|見当たり|含まれてい|ありませ|され(てい)?ませ)|見当たりません|書かれていません|載っていません|わかりません|分かりません|特定できません"
FOLDER_CUE = r"^\s*(?:フォルダ|にある|の中|内の|配下|folder|directory)"
DATE_LIKE_STEM = r"^[\d\s\-_./年月日]+$"
NEGATIVE_HEAD, ABSTAIN_HEAD = 80, 150
# --- end of fixed values ---


#: ASCII marks and white space, and the ideographic space.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum()) + "\u3000"


def normalised(text: Column) -> Column:
    """ASCII marks and white space to spaces, the rest in lower case. Each stands for itself, so a table of
    characters does, at a seventh of the cost of a pattern."""
    return F.lower(F.translate(text, MARKS, " " * len(MARKS)))


def tokens(text: Column) -> Column:
    """A word for each ASCII run; all single characters, then all pairs, of every other run."""
    runs = F.regexp_extract_all(normalised(text), F.lit(r"[\x21-\x7F]+|[^\x00-\x7F]+"), 0)

    def split(run: Column) -> Column:
        n = F.length(run)
        ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.ascii(run) < 128, F.array(run)).otherwise(F.concat(ones, twos))

    return F.flatten(F.transform(runs, split))


def token_bag(text: Column) -> Column:
    """The same tokens in another order, by three patterns and without a step for each run."""
    plain, single = normalised(text), r"[^\x00-\x7F]"
    pair = rf"(?=([^\x00-\x7F\x{{DC00}}-\x{{DFFF}}]{single}))"  # overlapping; not from within a surrogate pair
    every = F.concat(F.regexp_extract_all(plain, F.lit(r"[\x21-\x7F]+"), 0), F.regexp_extract_all(plain, F.lit(single), 0), F.regexp_extract_all(plain, F.lit(pair), 1))
    return F.when(F.octet_length(plain) == F.length(plain), F.array_remove(F.split(plain, " "), "")).otherwise(every)  # ASCII only: the words


def query_tokens(text: Column) -> Column:
    """Distinct tokens; single non-ASCII characters only if there is nothing else; at most 100."""
    every = F.array_distinct(tokens(text))
    longer = F.filter(every, lambda t: (F.length(t) > 1) | t.rlike(r"^[\x00-\x7F]"))
    return F.slice(F.when(F.size(longer) > 0, longer).otherwise(every), 1, MAX_QUERY_TERMS)


def match_expression(text: Column) -> Column:
    """Quoted tokens joined by OR; null for none."""
    found = query_tokens(text)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def token_estimate(*texts: Column) -> Column:
    """Non-ASCII characters / 3 + ASCII / 4 + 5, summed over the texts before dividing."""
    total = sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0))
    ascii_ = sum((F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\x00-\x7F]", "")) for t in texts), F.lit(0))
    return (F.floor((total - ascii_) / 3) + F.floor(ascii_ / 4) + 5).cast("long")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def like_escape(keyword: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", keyword)


def contains_folded(column: Column, keyword: str | Column) -> Column:
    key = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.contains(F.lower(column), F.lower(key))


def under_prefix(path: Column, scope: str) -> Column:
    """Raw prefix: ``diary`` also takes ``diary2/``."""
    return F.startswith(F.lower(path), F.lower(F.lit(scope)))


def under_folder(path: Column, folder: str) -> Column:
    name = folder.strip("/")
    return F.lit(True) if not name else (path == name) | F.startswith(path, F.lit(name + "/"))


def glob_regex(pattern: str) -> str:
    """``**`` spans folders (and takes one slash after it), ``*`` and ``?`` stay within one."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(p, ".*" if p.startswith("**") else re.sub(r"([^\w/\s])", r"\\\1", p)) for p in parts) + "$"


def glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def classified(question: Column, has_period: Column) -> Column:
    """TEMPORAL_SUMMARIZATION, MEMORY_SEARCH or GENERAL_KNOWLEDGE."""
    from . import dates

    memory = question.rlike("|".join(MEMORY_WORDS)) | F.udf(lambda q: dates.is_diary_question(q or ""), "boolean", useArrow=True)(question)
    general = question.rlike("|".join(f"(?:{p})" for p in GENERAL_PATTERNS))
    return F.when(has_period, "TEMPORAL_SUMMARIZATION").when(memory, "MEMORY_SEARCH").when(general, "GENERAL_KNOWLEDGE").otherwise("MEMORY_SEARCH")


def classify(question: str, has_period: bool) -> str:
    from . import dates

    if has_period:
        return "TEMPORAL_SUMMARIZATION"
    if any(w in question for w in MEMORY_WORDS) or dates.is_diary_question(question):
        return "MEMORY_SEARCH"
    return "GENERAL_KNOWLEDGE" if any(re.search(p, question) for p in GENERAL_PATTERNS) else "MEMORY_SEARCH"


def is_enumeration(question: Column) -> Column:
    return question.rlike(ENUMERATION)


def is_negative(answer: Column) -> Column:
    return F.substring(F.ltrim(answer), 1, NEGATIVE_HEAD).rlike("|".join(NEGATIVE_WORDS))


def is_abstention(answer: Column) -> Column:
    return F.substring(F.ltrim(answer), 1, ABSTAIN_HEAD).rlike(ABSTAIN)


def is_declined(answer: Column) -> Column:
    return answer.rlike(ABSTAIN)


def session_title(text: Column) -> Column:
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 40), F.lit("…"))).otherwise(text)


def dated_snippet(day: Column, body: Column) -> Column:
    return F.concat(F.when(day.isNotNull(), F.concat(F.lit("[日付: "), day.cast("string"), F.lit("] "))).otherwise(""), F.coalesce(body, F.lit("")))


SNIPPET_DATE = r"^\[日付:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\]\s*"


def snippet_date(snippet: Column) -> Column:
    return F.nullif(F.regexp_extract(snippet, SNIPPET_DATE, 1), F.lit(""))


def snippet_body(snippet: Column) -> Column:
    return F.regexp_replace(snippet, SNIPPET_DATE, "")


def history_block(turns: Column, last: int = 6) -> Column:
    """The last turns (role, content) as lines of ``label: content``."""
    recent = F.slice(turns, F.greatest(F.size(turns) - last, F.lit(0)) + 1, last)
    return F.array_join(F.transform(recent, lambda t: F.concat(F.when(t["role"] == "user", "ユーザー").otherwise("アシスタント"), F.lit(": "), t["content"])), "\n")


# --- plain functions for the driver's control flow ---


def json_array_slice(raw: str) -> str | None:
    """From the first ``[`` to the last ``]``."""
    a, b = raw.find("["), raw.rfind("]")
    return raw[a : b + 1] if 0 <= a < b else None


def quoted_elements(raw: str) -> list[str]:
    found = re.findall(r'"([^"]*)"|\'([^\']*)\'', json_array_slice(raw) or "")
    return [x for x in (a or b for a, b in found) if x.strip()]


def json_list(raw: str | None) -> list:
    try:
        got = json.loads(raw or "")
        return got if isinstance(got, list) else []
    except ValueError:
        return []


def normalised_fact(text: str) -> str:
    return re.sub(r"[\s,，]", "", unicodedata.normalize("NFKC", text).lower())


def has_fact(answer: str, fact: str) -> bool:
    """Whether one of the fact's alternatives (``|``) stands in the answer."""
    body = normalised_fact(answer)
    return any(f and f in body for f in map(normalised_fact, fact.split("|")))


def has_fact_of(answer: Column, fact: Column) -> Column:
    return F.udf(lambda a, f: a is not None and f is not None and has_fact(a, f), "boolean", useArrow=True)(answer, fact)


def coverage_answer(raw: str) -> tuple[bool, list[str]]:
    """(can answer, what is missing) from the first line that says yes or no; unclear is yes."""
    for line in map(str.strip, raw.splitlines()):
        if re.match(r"yes(?![a-z])", line):
            break
        if re.match(r"no(?![a-z])", line):
            return False, [x for x in map(str.strip, line[2:].lstrip(", ").split(",")) if x]
    return True, []


#: Tool, the arguments it needs (one of them suffices for read_file), optional ones with defaults.
TOOLS = {
    "glob": (["PATTERN"], {}),
    "list_dir": (["FOLDER"], {}),
    "read_file": ([], {"DOC_ID": None, "PATH": None}),
    "grep": (["QUERY"], {"SCOPE": None}),
    "vector_search": (["QUERY"], {"SCOPE": None, "K": 10}),
    "rrf_search": (["QUERY"], {"K": 10}),
    "timeline_search": (["START", "END"], {"LIMIT": 20}),
}


def planned_call(raw: str) -> tuple[str, dict] | None:
    """('finalize', …), (tool, arguments), or None where the plan can't be read."""
    pairs = {k.upper().strip(): v.strip() for k, v in re.findall(r"(?m)^\s*([A-Za-z_]+)\s*:\s*(.+)$", raw)}
    if pairs.get("ACTION", "").lower() == "finalize":
        return "finalize", {"reason": pairs.get("REASON", "")}
    name = pairs.get("TOOL", "").lower().replace("-", "_")
    needed, optional = TOOLS.get(name, ([""], {}))
    if any(k not in pairs for k in needed):
        return None
    args = {k.lower(): pairs[k] for k in needed}
    for k, default in optional.items():
        v = pairs.get(k, default)
        if k in ("K", "LIMIT", "DOC_ID"):
            v = int(v) if str(v).lstrip("-").isdigit() else default
        args[k.lower()] = v
    return None if name == "read_file" and args["doc_id"] is None and args["path"] is None else (name, args)


def duration(ms: int) -> str:
    s = round(ms / 1000, 1)
    return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m{int(s % 60):02d}s"


def explicit_folder(question: str, paths: list[str]) -> str | None:
    """The folder a question names: a path anywhere, a single name only before a cue."""
    low = question.lower()

    def named(name: str, cue: bool) -> bool:
        if len(name) < 2:
            return False
        edge = r"[A-Za-z0-9_/-]"
        guard = (f"(?<!{edge})", f"(?!{edge})") if name.isascii() else ("", "")
        ends = [m.start() + len(name) for m in re.finditer(f"(?={guard[0]}{re.escape(name.lower())}{guard[1]})", low)]
        return any(not cue or re.match(FOLDER_CUE, question[e:], re.I) for e in ends)

    folders = dict.fromkeys("/".join(p.split("/")[: i + 1]) for p in paths for i in range(p.count("/")))
    found = []
    for f in folders:
        leaf = f.rpartition("/")[2]
        if "/" in f and named(f, False):
            found.append((len(f), f))
        elif named(leaf, True):
            found.append((len(leaf), f))
    return min(found, key=lambda x: (-x[0], len(x[1])))[1] if found else None


def enumeration_scope(folder: str, paths: list[str], most: int = 8) -> str | None:
    """The top folder if it holds few documents, else the folder itself if it does."""
    for scope in dict.fromkeys((folder.split("/")[0], folder)):
        if 1 <= sum(p.startswith(scope + "/") for p in paths) <= most:
            return scope
    return None
