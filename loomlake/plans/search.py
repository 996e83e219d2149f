"""The search pipeline: retrieve four lists, fuse, collapse, rerank, pin. Models are plug-ins
with a deterministic null form."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import fusion, lexical, relational, vector

SNIPPET = {"bm25": 300, "date": 600, "topic": 500}
MAX_QUERIES = 8


class Models(Protocol):
    def expand(self, query: str) -> list[str]: ...
    def hypothetical(self, query: str) -> str | None: ...
    def embed(self, text: str) -> list[float] | None: ...
    def rerank(self, query: str, snippets: list[str]) -> list[int] | None: ...
    def judge(self, query: str, snippets: list[str]) -> str | None: ...
    def plan(self, query: str, seen: list[str]) -> str | None: ...
    def summarise(self, text: str) -> str | None: ...


class NoModels:
    """Every stage in its degraded form: no expansion, no vectors, input order, always covered."""

    def expand(self, query):
        return [query]

    def hypothetical(self, query):
        return None

    def embed(self, text):
        return None

    def rerank(self, query, snippets):
        return None

    def judge(self, query, snippets):
        return None

    def plan(self, query, seen):
        return None

    def summarise(self, text):
        return None


@dataclass
class Index:
    """documents (doc_id, tree, file_name, relative_path, document_date, content), chunks, vectors by chunk or document."""

    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    folders: DataFrame | None = None
    words: lexical.Index | None = None  # the chunks' inverted index, where it is stored

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession


def variants(query: str, models: Models) -> list[str]:
    """The question, its expansions, the hypothetical answer: white space to single spaces, distinct.
    The question is first wherever an expansion repeats it; the limit comes before the answer."""
    plain = lambda texts: [x for t in texts if (x := re.sub(r"\s+", " ", t).strip())]
    found = list(dict.fromkeys(plain([query, *models.expand(query)])))[:MAX_QUERIES]
    guess = models.hypothetical(query)
    return list(dict.fromkeys([*found, *plain([guess] if guess else [])]))


def _cited(rows: DataFrame, index: Index, source: str, chars: int) -> DataFrame:
    d = index.docs.select("doc_id", "relative_path", "document_date")
    c = index.chunks.select("chunk_id", "heading_path", "text")
    out = rows.join(c, "chunk_id").join(d, "doc_id")
    return out.select("question_id", "rank", "doc_id", "chunk_id", "heading_path", F.substring("text", 1, chars).alias("snippet"), F.col("score").cast("double").alias("score"), "relative_path", "document_date", F.lit(source).alias("source"), F.lit(False).alias("topic_match"))


def _from_docs(rows: DataFrame, index: Index, source: str, topic) -> DataFrame:
    first = relational.first_chunks(index.chunks).select("doc_id", "chunk_id", "heading_path", "text")
    out = rows.join(first, "doc_id", "left")
    return out.select("question_id", "rank", "doc_id", "chunk_id", F.coalesce("heading_path", "relative_path").alias("heading_path"), F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET["topic"]).alias("snippet"), F.lit(0.0).alias("score"), "relative_path", "document_date", F.lit(source).alias("source"), topic.alias("topic_match"))


def metadata_list(index: Index, query: str, queries: list[str], tree: str) -> DataFrame:
    words = [w for q in queries for w in re.split(r"[\s　、。,.?？!！]+", q) if len(w) >= 2]
    docs = relational.by_tree(index.docs, tree)
    topic = relational.topic_match(T.stem(F.col("relative_path")), F.array(*map(F.lit, queries)))
    hit = relational.metadata_match(docs, words).select("doc_id").withColumn("hit", F.lit(True))
    rows = docs.join(hit, "doc_id", "left").withColumn("topic", topic).where("hit OR topic").withColumn("question_id", F.lit(query))
    return _from_docs(fusion.renumbered(rows, "doc_id"), index, "METADATA", F.col("topic"))


def date_list(index: Index, query: str, tree: str, today: date) -> DataFrame | None:
    docs = relational.by_tree(index.docs, tree)
    span = D.resolve_period(query, today)
    if span:
        rows = relational.dated_between(docs, F.lit(span[0]), F.lit(span[1]))
    elif D.is_diary_question(query) and (days := D.resolve_days(query, today)):
        rows = docs.where(relational.day_matches(F.col("document_date"), F.array(*map(F.lit, days))))
    else:
        return None
    rows = fusion.renumbered(rows.withColumn("question_id", F.lit(query)), "document_date", "doc_id")
    return _from_docs(rows, index, "METADATA", F.lit(False)).withColumn("snippet", F.substring("snippet", 1, SNIPPET["date"]))


@dataclass
class Result:
    rows: DataFrame
    candidates: DataFrame
    period: tuple[date, date] | None


def search(index: Index, query: str, tree: str, today: date, models: Models | None = None) -> Result:
    """Ten citation rows for one question."""
    models = models or NoModels()
    spark, queries = index.spark, variants(query, models)
    asked = spark.createDataFrame([(query, i, q, tree) for i, q in enumerate(queries)], "question_id string, q_idx int, text string, tree string")
    bm = _cited(lexical.multi_query(index.chunks, index.docs, asked, words=index.words), index, "BM25", SNIPPET["bm25"])
    meta = metadata_list(index, query, queries, tree)
    dated = date_list(index, query, tree, today)
    if dated is not None:
        meta = fusion.renumbered(dated.withColumn("_part", F.lit(0)).unionByName(meta.withColumn("_part", F.lit(1))), "_part", "rank").drop("_part")
    vec = None
    embedded = [(query, i, v) for i, q in enumerate(queries) if (v := models.embed(q))] if index.vectors is not None else []
    if embedded:
        qv = spark.createDataFrame(embedded, "question_id string, q_idx int, qvec array<double>")
        scoped = index.vectors.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id").join(relational.by_tree(index.docs, tree).select("doc_id"), "doc_id", "left_semi")
        found = vector.above(vector.multi_query(scoped.select("chunk_id", "embedding"), qv, "chunk_id"))
        vec = _cited(found.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id"), index, "VECTOR", SNIPPET["bm25"])
    lists = [meta, vec, bm]
    parts = [p.withColumn("list_idx", F.lit(i)) for i, p in enumerate(lists) if p is not None]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = fusion.collapse(fusion.rrf(every, [fusion.WEIGHTS[k] for k in ("meta", "vector", "bm25")])).cache()
    final = reranked(merged, query, models)
    span = D.resolve_period(query, today)
    if span and dated is not None:
        final = fusion.date_pins(final, merged, dated)
    elif not span:
        final = folder_pinned(index, final, merged, query, tree, models)
    return Result(final.where(F.col("rank") < fusion.FINAL), merged, span)


def reranked(merged: DataFrame, query: str, models: Models) -> DataFrame:
    if D.is_date_question(query) and merged.where("topic_match").limit(1).count():
        return fusion.topic_first(merged)
    head = merged.where(F.col("rank") < 20).orderBy("rank").collect()  # at most twenty rows
    order = models.rerank(query, [r.snippet[:300] for r in head]) if len(head) > fusion.FINAL else None
    if not order:
        return fusion.keep_top(merged, fusion.identity_rerank(merged))
    picked = list(dict.fromkeys(i for i in order if 0 <= i < len(head)))
    picked = (picked + [i for i in range(len(head)) if i not in picked])[: fusion.FINAL]
    place = merged.sparkSession.createDataFrame([(head[i]["rank"], n) for n, i in enumerate(picked)], "rank int, place int")
    return fusion.keep_top(merged, merged.join(F.broadcast(place), "rank").withColumn("rank", F.col("place")).drop("place"))  # at most ten rows


def folder_pinned(index: Index, final: DataFrame, merged: DataFrame, query: str, tree: str, models: Models) -> DataFrame:
    """An explicit folder, else for 'list all' questions the nearest folder's scope, goes first. Folders,
    not documents, come to the driver."""
    docs = relational.by_tree(index.docs, tree)
    low = F.lower(F.lit(query))
    folder = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("relative_path", "/"), F.lit(1), i), "/")))
    named = docs.where(F.contains("relative_path", F.lit("/"))).select(folder.alias("f")).distinct().where(F.contains(low, F.lower(F.element_at(F.split("f", "/"), -1))) | F.contains(low, F.lower("f")))
    scope = T.explicit_folder(query, [r.f + "/x" for r in named.orderBy("f").collect()])
    if not scope and index.folders is not None and (v := models.embed(query)) and re.search(T.ENUMERATION, query):
        q = index.spark.createDataFrame([(query, v)], "question_id string, qvec array<double>")
        near = vector.nearest_folders(index.folders, q).first()
        if near:
            for s in dict.fromkeys((near.path.split("/")[0], near.path)):
                if 1 <= docs.where(T.under_folder(F.col("relative_path"), s)).limit(9).count() <= 8:
                    scope = s
                    break
    if not scope:
        return final
    rows = docs.where(T.under_folder(F.col("relative_path"), scope)).withColumn("question_id", F.lit(query)).withColumn("rank", F.lit(0))
    return fusion.folder_pins(final, merged, _from_docs(rows, index, "FOLDER", F.lit(False)))
