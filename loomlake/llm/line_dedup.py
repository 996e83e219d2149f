"""Line dedup by fingerprints of line pairs.

The lines of a document with a word in them are hashed. Fingerprints are all pairs of
neighbouring lines, and every line of ``LONG`` words or more. Per fingerprint the first
place in the corpus, by (doc_id, line), stays; at every later place its lines are deleted.
So each line of a repeated run of two lines or more goes from all but the first place of
its pair, whatever else begins alike, and with it every repeated run of whole lines that
reaches ``LONG`` words. A shorter line that repeats without a neighbour stays.

Rows with a null doc_id or null text pass unchanged. Rows that repeat a doc_id and its text
are one document; different texts under one doc_id are ordered by their hash. Lines without
a word stay. Other columns pass through; names starting with ``_l`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LONG = 50
_SPACES = " \t\n\x0b\x0c\r"


def solid_lines(text: str) -> tuple[list[int], list[str]]:
    """Positions and contents of the lines with a word; contents without outer white space."""
    kept = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(_SPACES))]
    return [i for i, _ in kept], [s for _, s in kept]


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def anchors(lines: list[str], h: np.ndarray, long: int = LONG) -> list[tuple[int, int]]:
    """(hash, place among the solid lines) of all pairs in order, then of the long lines."""
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = [(int(x), i) for i, x in enumerate(pairs)]
    return out + [(int(h[i]), i) for i, x in enumerate(lines) if len(x) > 2 * long - 2 and len(x.split()) >= long]


def _fingerprints(docs: DataFrame, long: int) -> DataFrame:
    """(doc_id, tk, fps): fingerprints of each row. A pair's hash and that of its first line
    fix the hash of its second, so that (fp, h) tells pairs apart as their two lines do."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                fps, hs, at, n, ends = [], [], [], [], [0]
                for t in part.column("text").to_pylist():
                    _, lines = solid_lines(t)
                    h = line_hashes(lines)
                    found = anchors(lines, h, long)
                    pos = np.array([p for _, p in found], np.int32)
                    fps.append(np.array([a for a, _ in found], np.uint64))
                    hs.append(h[pos])
                    at.append(pos)
                    n.append(np.where(np.arange(len(pos)) < len(h) - 1, 2, 1).astype(np.int32))
                    ends.append(ends[-1] + len(pos))
                flat = [pa.array(np.concatenate(c).view(kind)) for c, kind in ((fps, np.int64), (hs, np.int64), (at, np.int32), (n, np.int32))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["fp", "h", "pos", "n"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), lists], names=["doc_id", "tk", "fps"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, tk long, fps array<struct<fp:long,h:long,pos:int,n:int>>")


def removed_places(docs: DataFrame, scratch: Scratch, long: int = LONG) -> DataFrame:
    """(doc_id, tk, gone): places among the solid lines that later repeats cover. Rows that
    repeat a document have its places too, which are the first ones where its own are."""
    table = scratch.table(_fingerprints(docs, long), "lines")
    at = table.select("doc_id", "tk", F.explode("fps").alias("x")).select("x.fp", "x.h", "doc_id", "tk", "x.pos", "x.n")
    firsts = at.groupBy("fp", "h").agg(F.min(F.struct("doc_id", "tk", "pos")).alias("f"), F.count("*").alias("m")).where("m > 1").select("fp", "h", "f")
    later = at.join(firsts, ["fp", "h"]).where(F.struct("doc_id", "tk", "pos") != F.col("f"))
    return later.groupBy("doc_id", "tk").agg(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(pos, pos + n - 1)")))).alias("gone"))


def dedup(docs: DataFrame, long: int = LONG, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` with its text after the removals, n_lines (solid lines before)
    and n_removed_lines."""
    gone = removed_places(docs, scratch or Scratch(docs.sparkSession), long)
    gone = gone.select(F.col("doc_id").alias("_l_id"), F.col("tk").alias("_l_tk"), F.col("gone").alias("_l_gone"))
    keyed = docs.withColumn("_l_key", F.xxhash64("text"))
    rows = keyed.join(gone, (F.col("doc_id") == F.col("_l_id")) & (F.col("_l_key") == F.col("_l_tk")) & F.col("text").isNotNull(), "left").drop("_l_id", "_l_tk", "_l_key")
    given = list(docs.columns)
    names = [*given, "n_lines", "n_removed_lines"]

    def run(batches):
        for b in batches:
            step = max(1, min(512, int(len(b) * (8 << 20) / max(1, b.nbytes))))
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                texts, n, m = [], [], []
                for t, gone in zip(part.column(part.schema.get_field_index("text")).to_pylist(), part.column(part.schema.get_field_index("_l_gone")).to_pylist()):
                    at = solid_lines(t or "")[0]
                    out = {at[g] for g in gone or ()}
                    texts.append("\n".join(x for j, x in enumerate(t.split("\n")) if j not in out) if out else t)
                    n.append(len(at))
                    m.append(len(out))
                cols = [pa.array(texts, pa.string()) if c == "text" else part.column(part.schema.get_field_index(c)) for c in given]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=names)

    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed_lines": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and the SHA-256 of what is left of each row."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
