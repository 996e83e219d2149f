"""Question answering around the search pipeline: coverage, tools, the planner loop, answer context."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import markdown as M
from ..functions import text as T
from ..operators import fusion, lexical, relational, vector
from .search import Index, Models, NoModels, search

GLOB_LIMIT, READ_CHARS, SECTION_CHARS, SUMMARY_FROM, SUMMARY_CHARS, STEPS, CONTEXT_TOKENS, COVERED = 30, 8000, 1000, 3000, 500, 6, 1800, 5
CITED = ["question_id", "rank", "doc_id", "heading_path", "snippet", "score", "relative_path", "source", "topic_match"]


@dataclass
class Tools:
    """The seven tools over one tree; each returns citation rows."""

    index: Index
    tree: str
    today: date
    models: Models = field(default_factory=NoModels)

    @property
    def docs(self) -> DataFrame:
        return relational.by_tree(self.index.docs, self.tree)

    def _rows(self, docs: DataFrame, source: str, score: float, order, snippet="content") -> DataFrame:
        rows = docs.withColumn("question_id", F.lit("tool"))
        rows = fusion.renumbered(rows, *order)
        return rows.select("question_id", "rank", "doc_id", F.col("relative_path").alias("heading_path"), F.substring(F.coalesce(F.col(snippet), F.lit("")), 1, 300).alias("snippet"), F.lit(score).alias("score"), "relative_path", F.lit(source).alias("source"), F.lit(False).alias("topic_match"))

    def glob(self, pattern: str) -> DataFrame:
        return self._rows(self.docs.where(T.glob(F.col("relative_path"), pattern)), "GLOB", 0.5, ["doc_id"]).where(F.col("rank") < GLOB_LIMIT)

    def list_dir(self, folder: str) -> DataFrame:
        found = relational.list_dir(self.docs, folder).withColumn("question_id", F.lit("tool"))
        found = fusion.renumbered(found, F.desc("kind"), "name")
        return found.select("question_id", "rank", F.lit(None).cast("long").alias("doc_id"), F.col("name").alias("heading_path"), F.col("kind").alias("snippet"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("relative_path"), F.lit("FOLDER").alias("source"), F.lit(False).alias("topic_match"))

    def read_file(self, doc_id=None, path: str | None = None, section: str | None = None) -> DataFrame:
        """The whole text of one document, or the chunks of a section; long texts are summarised."""
        doc = self.docs.where(F.col("doc_id") == doc_id) if doc_id is not None else relational.resolve_path(self.docs, path)
        chunks = self.index.chunks.join(doc.select("doc_id"), "doc_id")
        if section:
            chunks = chunks.where(T.contains_folded(F.col("heading_path"), section))
        parts = [(r.heading_path, r.text) for r in chunks.orderBy("chunk_id").limit(64).collect()]
        whole = M.reassembled(parts, 0, SECTION_CHARS if section else READ_CHARS) if parts else ""
        if len(whole) > SUMMARY_FROM:
            whole = self.models.summarise(whole) or whole[:SUMMARY_CHARS]
        return self._rows(doc.withColumn("whole", F.lit(whole)), "READ_FILE", 1.0, ["doc_id"], "whole").withColumn("snippet", F.lit(whole))

    def grep(self, query: str, scope: str | None = None) -> DataFrame:
        asked = self.index.spark.createDataFrame([("tool", query, self.tree)], "question_id string, text string, tree string")
        found = lexical.grep(self.index.chunks, self.index.docs, asked, scope, self.index.words).join(self.index.chunks.select("chunk_id", "heading_path", "text"), "chunk_id")
        return found.select("question_id", "rank", "doc_id", "heading_path", F.substring("text", 1, 300).alias("snippet"), "score", "relative_path", "source", F.lit(False).alias("topic_match"))

    def vector_search(self, query: str, scope: str | None = None, k: int = 10) -> DataFrame | None:
        v = self.models.embed(query)
        if v is None or self.index.vectors is None:
            return None
        q = self.index.spark.createDataFrame([("tool", v)], "question_id string, qvec array<double>")
        allowed = self.docs.where(T.under_folder(F.col("relative_path"), scope or ""))
        chunks = self.index.chunks.join(allowed.select("doc_id", "relative_path"), "doc_id")
        found = vector.top_k_scoped(self.index.vectors, chunks.select("chunk_id"), q, k, "chunk_id").join(chunks, "chunk_id")
        return found.select("question_id", "rank", "doc_id", "heading_path", F.substring("text", 1, 300).alias("snippet"), "score", "relative_path", F.lit("VECTOR").alias("source"), F.lit(False).alias("topic_match"))

    def rrf_search(self, query: str, k: int = 10) -> DataFrame:
        return search(self.index, query, self.tree, self.today, self.models).rows.where(F.col("rank") < k).select(*CITED).withColumn("source", F.lit("RRF"))

    def timeline_search(self, start: str, end: str, limit: int = 20) -> DataFrame:
        return self._rows(relational.timeline(self.docs, start, end, limit), "METADATA", 0.7, ["document_date", "doc_id"])


def covered(question: str, rows: list, today: date) -> bool | None:
    """Whether dates or a topic match among the top rows already settle coverage; None: ask the judge."""
    top = rows[:COVERED]
    dated = [r["document_date"] for r in top if r["document_date"]]
    span, days = D.resolve_period(question, today), D.resolve_days(question, today)
    if span:
        hit = any(span[0] <= d <= span[1] for d in dated)
    elif days:
        hit = any(d in days for d in dated)
    else:
        hit = bool(dated) and D.is_date_question(question)
    return True if hit or (D.is_date_question(question) and any(r["topic_match"] for r in top)) else None


def hints(question: str, docs: DataFrame, today: date) -> dict:
    """What a planner is told: the period, up to three paths per day, up to five stem matches."""
    days = D.resolve_days(question, today)
    per_day = docs.where(F.col("document_date").isin(days)).groupBy("document_date").agg(F.slice(F.array_sort(F.collect_list("relative_path")), 1, 3).alias("paths")) if days else None
    stems = docs.where(relational.topic_match(T.stem(F.col("relative_path")), F.array(F.lit(question)))).orderBy("doc_id").limit(5)
    return {"period": D.resolve_period(question, today), "days": {r.document_date: r.paths for r in per_day.collect()} if per_day is not None else {}, "stems": [r.relative_path for r in stems.select("relative_path").collect()]}


def loop(tools: Tools, question: str) -> DataFrame | None:
    """Up to six planned tool calls; tool errors become observations; two unreadable plans in a
    row fall back to fused search. Results are integrated."""
    seen, results, unread = [], [], 0
    for _ in range(STEPS):
        raw = tools.models.plan(question, seen)
        if raw is None:
            break
        call = T.planned_call(raw)
        if call is None:
            unread += 1
            if unread == 2:
                results.append(tools.rrf_search(question))
                break
            continue
        unread = 0
        name, args = call
        if name == "finalize":
            break
        try:
            if (got := getattr(tools, name)(**args)) is not None:
                results.append(got.select(*CITED))
                seen.append(f"{name}: {got.count()} rows")
        except Exception as e:  # reported to the planner, which may choose another tool
            seen.append(f"{name} failed: {e}")
    if not results:
        return None
    every = results[0].withColumn("_n", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        every = every.unionByName(r.withColumn("_n", F.lit(i)))
    every = every.withColumn("question_id", F.lit(question))
    return fusion.integrate(fusion.renumbered(every, "_n", "rank").drop("_n"))


def expanded(index: Index, rows: list[dict]) -> list[dict]:
    """The first three documents as running text around what was found; later rows of them go."""
    done: set = set()
    wanted = list(dict.fromkeys(r["doc_id"] for r in rows if r["doc_id"] is not None))[: M.EXPAND_DOCS]
    parts: dict = {d: [] for d in wanted}
    for c in index.chunks.where(F.col("doc_id").isin(wanted)).orderBy("doc_id", "chunk_id").collect() if wanted else []:
        parts[c.doc_id].append((c.heading_path, c.text))
    out = []
    for r in rows:
        d = r["doc_id"]
        if d in done:
            continue
        if d in parts and parts[d]:
            done.add(d)
            r = r | {"heading_path": M.FULL_TEXT, "snippet": M.reassembled(parts[d], M.anchor_of(parts[d], r["snippet"]))}
        out.append(r)
    return out


def tokens_of(*texts: str) -> int:
    every = "".join(texts)
    plain = sum(c.isascii() for c in every)
    return (len(every) - plain) // 3 + plain // 4 + 5


def answer_context(rows: list[dict], budget: int = CONTEXT_TOKENS, period: tuple[date, date] | None = None, enumerate_all: bool = False) -> str:
    """Citations as text within the budget; the one that crosses it is still in."""
    out, left = [], budget
    for r in rows:
        if left <= 0:
            break
        block = f"### {r.get('relative_path') or ''} > {r['heading_path']}\n{r['snippet']}"
        out.append(block)
        left -= tokens_of(block)
    head = ([f"期間: {period[0]} 〜 {period[1]}"] if period else []) + (["該当するものをすべて挙げる"] if enumerate_all else [])
    return "\n\n".join(head + out)


@dataclass
class Answer:
    kind: str
    rows: list[dict]
    context: str


def ask(index: Index, question: str, tree: str, today: date, models: Models | None = None) -> Answer:
    """Classify, search, check coverage, fall back to tools and then to plain fusion, expand, build context."""
    import re

    models = models or NoModels()
    span = D.resolve_period(question, today)
    kind = T.classify(question, span is not None)
    if kind == "GENERAL_KNOWLEDGE":
        return Answer(kind, [], "")
    found = [r.asDict() for r in search(index, question, tree, today, models).rows.orderBy("rank").collect()]
    if found and not covered(question, found, today):
        verdict = models.judge(question, [r["snippet"] for r in found[:COVERED]])
        if verdict is not None and not T.coverage_answer(verdict)[0]:
            found = []
    tools = Tools(index, tree, today, models)
    if not found and (got := loop(tools, question)) is not None:
        found = [r.asDict() for r in got.orderBy("rank").collect()]
    if not found:
        found = [r.asDict() for r in tools.rrf_search(question).orderBy("rank").collect()]
    rows = expanded(index, found)
    return Answer(kind, rows, answer_context(rows, period=span, enumerate_all=bool(re.search(T.ENUMERATION, question))))
