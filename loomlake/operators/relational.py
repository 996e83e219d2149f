"""Scans, lookups, snapshots and the grouped and limited reads over the note tables."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def by_tree(docs: DataFrame, tree: str) -> DataFrame:
    return docs.where(F.col("tree") == tree)


def chunks_by_tree(chunks: DataFrame, docs: DataFrame, tree: str, scope: str | None = None) -> DataFrame:
    keep = by_tree(docs, tree)
    keep = keep if scope is None else keep.where(T.under_prefix(F.col("relative_path"), scope))
    return chunks.join(keep.select("doc_id", "relative_path"), "doc_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))


def after(df: DataFrame, id_col: str, last, n: int = 1000) -> DataFrame:
    """Keyset page: the n rows after ``last``."""
    return df.where(F.col(id_col) > last).orderBy(id_col).limit(n)


def recent(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), id_col).limit(n)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed, keys, "left_anti")


def update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of ``changes`` replace those of the rows they match."""
    values = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values))
    return table.join(new, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in table.columns))


def snapshot_diff(stored: DataFrame, scanned: DataFrame, key: str = "file_uri") -> DataFrame:
    """(key, state, doc_id): new, changed, removed, or unchanged when both hash and chunk count agree.
    Both sides have content_hash and chunk_count; stored ones have doc_id."""
    a = stored.select(key, "doc_id", F.col("content_hash").alias("h0"), F.col("chunk_count").alias("n0"))
    b = scanned.select(key, F.col("content_hash").alias("h1"), F.col("chunk_count").alias("n1"))
    state = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "removed").when((F.col("h0") == F.col("h1")) & (F.col("n0") == F.col("n1")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"), "doc_id")


def first_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "heading_path", "text"), "chunk_id").alias("c")).select("doc_id", "c.*")


def dated_between(docs: DataFrame, start: Column, end: Column, day: str = "document_date") -> DataFrame:
    return docs.where(F.col(day).between(start, end))


def day_matches(day: Column, dates: Column) -> Column:
    """Either's digits start with the other's."""
    digits = F.replace(day.cast("string"), F.lit("-"), F.lit(""))
    return F.exists(dates, lambda d: F.startswith(digits, F.replace(d.cast("string"), F.lit("-"), F.lit(""))) | F.startswith(F.replace(d.cast("string"), F.lit("-"), F.lit("")), digits))


def timeline(docs: DataFrame, start: str, end: str, limit: int = 20, day: str = "document_date", id_col: str = "doc_id") -> DataFrame:
    kept = dated_between(docs, F.to_date(F.lit(start)), F.to_date(F.lit(end)), day)
    return kept.orderBy(day, id_col).limit(limit).withColumn("score", F.lit(0.7))


def metadata_match(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """Documents with a token of two characters or more in a name, path, tag or date."""
    wanted = F.array(*(F.lit(t.lower()) for t in tokens if len(t) >= 2)).cast("array<string>")
    fields = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("file_name", "relative_path", "tags", "document_date") if c in docs.columns]
    any_of = lambda field: F.exists(wanted, lambda t: F.contains(field, t))
    return docs.where(reduce(operator.or_, map(any_of, fields)))


def topic_match(stem: Column, queries: Column) -> Column:
    return (F.length(stem) > 0) & F.exists(queries, lambda q: F.contains(F.lower(q), F.lower(stem)))


def folder_groups(docs: DataFrame) -> DataFrame:
    """(folder, n_docs, headings): files by immediate parent, with its first ten headings."""
    rows = docs.withColumn("folder", T.folder_of(F.col("relative_path"))).where("folder <> ''")
    heads = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("relative_path", F.coalesce("headings", F.array().cast("array<string>")).alias("h")))), lambda x: x["h"])), 1, 10) if "headings" in docs.columns else F.array().cast("array<string>")
    return rows.groupBy("folder").agg(F.count("*").alias("n_docs"), heads.alias("headings"))


def list_dir(docs: DataFrame, folder: str) -> DataFrame:
    """(kind, name): sub-folders, then files, of one folder; ``/``, ``.`` and empty are the root."""
    base = folder.strip("/").strip(".").strip("/")
    inside = docs.where(T.under_folder(F.col("relative_path"), base)).select(F.substring(F.col("relative_path"), len(base) + 2 if base else 1, 1 << 20).alias("rest"))
    kind = F.when(F.contains("rest", F.lit("/")), "folder").otherwise("file")
    return inside.where("rest <> ''").select(kind.alias("kind"), F.element_at(F.split("rest", "/"), 1).alias("name")).distinct()


def resolve_path(docs: DataFrame, wanted: str) -> DataFrame:
    """At most one row: an exact path, else a path that ends so, an equal name, a path that contains it;
    within a stage the shortest, then the smallest path."""
    p, name, w = F.lower("relative_path"), F.lower("file_name"), wanted.lower().strip("/")
    stage = F.when(F.col("relative_path") == wanted.strip("/"), 0).when(F.endswith(p, F.lit("/" + w)), 1).when(name.isin(w, w + ".md"), 2).when(F.contains(p, F.lit(w)), 3)
    return docs.withColumn("stage", stage).where("stage IS NOT NULL").orderBy("stage", F.length("relative_path"), "relative_path").limit(1)


def unknown_paths(expected: DataFrame, docs: DataFrame) -> DataFrame:
    return expected.select("path").distinct().join(docs.select(F.lower("relative_path").alias("known")), F.lower("path") == F.col("known"), "left_anti")


def suggestion_topics(docs: DataFrame, n: int = 2) -> DataFrame:
    """The newest file stems that can be a topic."""
    name = F.trim(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    rows = docs.select(name.alias("topic"), "last_modified", "doc_id").where(F.length("topic").between(2, 20) & ~F.col("topic").rlike(T.DATE_LIKE_STEM))
    return rows.groupBy("topic").agg(F.max("last_modified").alias("last_modified")).orderBy(F.desc("last_modified"), "topic").limit(n)


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(least, median, most): the median is element n/2 of the ascending values, from 0. Two values
    known to lie within a few millionths of the rows around it bracket it; values below the
    bracket are counted together, so that only the few inside are ordered."""
    near = F.percentile_approx(value, F.array(F.lit(0.499997), F.lit(0.500003)), F.lit(1_000_000))
    known = rows.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), near.alias("near"))
    inside = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).crossJoin(F.broadcast(known.select("n", "near"))).where("v <= near[1]")  # one row
    counts = inside.groupBy(F.expr("greatest(v, near[0])").alias("v"), "n").agg(F.count("*").alias("k"))
    reached = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v"))).where("upto > floor(n / 2)").agg(F.min("v").alias("median"))
    return known.crossJoin(reached).select("least", "median", "most")
