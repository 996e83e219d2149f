"""Incremental indexing: snapshot diff and upserts, in batch or from a stream of notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import relational

NOTE = "file_uri string, relative_path string, content string, last_modified long"


@dataclass
class Tables:
    """documents (doc_id, file_uri, relative_path, content_hash, …) and chunks (chunk_id, doc_id, heading_path, text)."""

    docs: DataFrame
    chunks: DataFrame


def chunked(notes: DataFrame) -> DataFrame:
    """Chunks of notes with stable ids: a hash of document and place."""
    rows = markdown.chunk_notes(notes)
    return rows.select(F.xxhash64("doc_id", "idx").alias("chunk_id"), "doc_id", "idx", "heading_path", "text")


def refresh(stored: Tables, scanned: DataFrame, keep_missing: bool = False) -> Tables:
    """The tables after a scan (file_uri, relative_path, content, last_modified). Changed notes keep
    their doc_id; notes that are gone lose documents and chunks, unless the scan is partial;
    a note with the right hash but missing chunks is done again."""
    scan = scanned.withColumn("content_hash", F.sha2("content", 256))
    fresh = markdown.chunk_notes(scan.select(F.col("file_uri").alias("doc_id"), "relative_path", "content")).groupBy(F.col("doc_id").alias("file_uri")).agg(F.count("*").alias("chunk_count"))
    counted = scan.join(fresh, "file_uri", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    have = stored.docs.join(relational.chunk_counts(stored.chunks), "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    diff = relational.snapshot_diff(have, counted)
    states = ["new", "changed"]
    todo = scan.join(diff.where(F.col("state").isin(*states)).select("file_uri", "doc_id"), "file_uri").withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("file_uri")))
    gone = diff.where(F.col("state").isin("changed", *([] if keep_missing else ["removed"]))).select("doc_id")
    docs = relational.delete(stored.docs, gone, ["doc_id"]).unionByName(todo.select(*[c for c in stored.docs.columns if c in todo.columns]), allowMissingColumns=True)
    new = chunked(todo.select("doc_id", "relative_path", "content")).select("chunk_id", "doc_id", "heading_path", "text")
    return Tables(docs, relational.delete(stored.chunks, gone, ["doc_id"]).unionByName(new, allowMissingColumns=True))


def note_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of notes arriving in a folder."""
    return spark.readStream.schema(NOTE).json(folder)


def index_stream(notes: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Keeps ``path``/v<batch> up to date; each batch reads the last version and writes the next, so a
    batch run again after a failure gives the same version."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("file_uri").agg(F.max_by(F.struct("relative_path", "content", "last_modified"), F.struct("last_modified", "content")).alias("n")).select("file_uri", "n.*")
        old = Tables(spark.read.parquet(f"{path}/v{n - 1}/docs"), spark.read.parquet(f"{path}/v{n - 1}/chunks")) if n else Tables(spark.createDataFrame([], "doc_id long, file_uri string, relative_path string, content_hash string, last_modified long"), spark.createDataFrame([], "chunk_id long, doc_id long, heading_path string, text string"))
        got = refresh(old, newest, keep_missing=True)
        got.docs.write.mode("overwrite").parquet(f"{path}/v{n}/docs")
        got.chunks.write.mode("overwrite").parquet(f"{path}/v{n}/chunks")

    writer = notes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_counts(events: DataFrame, time: Column, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; late rows are waited for up to the watermark. An extension."""
    return events.withColumn("_t", time).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
