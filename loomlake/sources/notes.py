"""Reading notes and labelled questions, and writing the index tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, markdown
from ..operators import lexical

_own: dict[str, str] = {}

MAX_BYTES = 10 * 1024 * 1024
CHUNK_IDS = 1 << 20  # chunk ids of one document; 680 million characters fit
CITATION = "array<struct<heading_path:string,snippet:string,score:float,doc_id:bigint,relative_path:string,source:string,topic_match:boolean>>"
CASES = "id string, query string, expected array<string>, facts array<string>, unanswerable boolean"


def listed(spark: SparkSession, root: str) -> list[str]:
    """Paths of all ``*.md`` files whose path below the root has no part starting with a dot.
    Listed through the file system's own interface, since Spark's listing also leaves out names
    that start with an underscore. An unreadable folder is an error."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, level = [], [top]
    while level:
        below = []
        for folder in level:
            for s in fs.listStatus(folder):
                name = s.getPath().getName()
                if not name.startswith("."):
                    if s.isDirectory():
                        below.append(s.getPath())
                    elif name.lower().endswith(".md"):
                        out.append(s.getPath().toString())
        level = below
    return sorted(out)


def scan(spark: SparkSession, root: str, tree: str = "notes") -> DataFrame:
    """(tree, file_uri, file_name, relative_path, last_modified, content, content_hash) of a folder of notes.
    Files above 10 MiB are left out; one leading byte-order mark goes; hashes are of the text read."""
    paths = listed(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], schema)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    kept = files.where(F.col("length") <= MAX_BYTES)
    rows = kept.select(F.lit(tree).alias("tree"), F.col("path").alias("file_uri"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.substring(path, len(base) + 2, 1 << 20).alias("relative_path"), F.unix_millis("modificationTime").alias("last_modified"), body.alias("content"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def with_metadata(notes: DataFrame, as_of: Column) -> DataFrame:
    """Adds headings, first_para, tags and document_date."""
    c = F.col("content")
    return notes.withColumns({"headings": markdown.headings_of(c), "first_para": markdown.first_paragraph_of(c), "tags": markdown.tags_of(c), "document_date": dates.document_date(F.col("relative_path"), c, as_of)})


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from a JSON array; other keys are skipped, a blank id or query is an error."""
    schema = CASES
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    check = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"a case without {c}")).cast("string")).otherwise(F.col(c))
    empty = F.array().cast("array<string>")
    return rows.select(check("id").alias("case_id"), check("query").alias("query"), F.coalesce("expected", empty).alias("expected"), F.coalesce("facts", empty).alias("facts"), F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"))


def citations_json(citations: Column) -> Column:
    return F.coalesce(F.to_json(citations), F.lit("[]"))


def citations_from(raw: Column) -> Column:
    """Unreadable JSON is an empty list; unknown sources are UNKNOWN."""
    from ..operators.fusion import SOURCES

    known = F.array(*map(F.lit, SOURCES))
    got = F.coalesce(F.from_json(raw, CITATION), F.array().cast(CITATION))
    return F.transform(got, lambda c: c.withField("source", F.when(F.array_contains(known, c["source"]), c["source"]).otherwise("UNKNOWN")).withField("topic_match", F.coalesce(c["topic_match"], F.lit(False))))


def replace_tree(table: DataFrame, path: str) -> None:
    """Replaces the partitions of the trees in ``table`` and leaves those of others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tree").parquet(path)


def workspace(spark: SparkSession) -> str:
    """A folder for tables of our own: the one all executors share, else, where there is no other
    machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomlake-"))
    return root.rstrip("/")


def store_index(chunks: DataFrame, path: str) -> lexical.Index:
    """Writes the inverted index of all ``chunks``: postings ranged by term, so that a term's rows lie
    together and few row groups hold any; document frequencies; one row of statistics."""
    spark = chunks.sparkSession
    lexical.postings(chunks).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "field", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    made = lexical.index(chunks, spark.read.parquet(f"{path}/postings"))
    made.terms.write.mode("overwrite").parquet(f"{path}/terms")
    made.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(spark, path)


def store_asked(chunks: DataFrame, questions: DataFrame, path: str) -> lexical.Index:
    """Writes what ``questions`` ask of all ``chunks``, in one pass over their text: the counts of each chunk,
    document frequencies, one row of statistics. The full index sorts every posting, which pays only
    where the questions are not known yet."""
    spark = chunks.sparkSession
    rows = lexical.asked_rows(chunks, questions)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    made = lexical.asked_index(spark.read.schema(rows.schema).parquet(f"{path}/rows"))
    made.terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    made.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return lexical.Index(made.postings, *(spark.read.parquet(f"{path}/{name}") for name in ("terms", "stats")))


def read_index(spark: SparkSession, path: str) -> lexical.Index:
    return lexical.Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats")))


def folder_text(folders: DataFrame) -> Column:
    return F.concat_ws("\n", F.col("folder"), F.array_join("headings", "\n"))


def from_tables(spark: SparkSession, sf_dir: str, headings: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of the note model over the ``documents`` table. Dates are invented
    from the id, as the table has none. ``headings``: the folder is the chunks' heading path, else there is none."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    docs = d.select(
        "doc_id",
        F.col("lang").alias("tree"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        path.alias("relative_path"),
        F.expr("date_add(date'2024-01-01', int(doc_id % 365))").alias("document_date"),
        F.col("text").alias("content"),
    )
    heading = F.regexp_extract(path, "^(.*)/", 1) if headings else F.lit("")
    windows = markdown.window_chunks(d.withColumn("heading_path", heading), "text", "heading_path")
    return docs, windows.select((F.col("doc_id") * CHUNK_IDS + F.col("idx")).alias("chunk_id"), "doc_id", "heading_path", "text")
