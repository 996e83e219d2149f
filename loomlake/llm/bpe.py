"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts of at most ``chunk_chars`` characters are encoded in place. A longer text
is cut into chunks that overlap; each chunk is pre-tokenised on its own, on any
executor. Matching from a position depends only on what follows it, so once two
neighbouring chunks share a pre-token boundary inside their overlap they agree
from there on: that boundary is the stitch. Pieces between stitches are encoded
in parallel and their ids concatenated. If some neighbours never meet (one token
longer than the overlap), the whole text is encoded in one piece instead.

Null text counts as empty. Empty text gives no ids. Repeated rows each get their
own row. Extra columns are kept; names starting with ``_bpe`` are reserved.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key

CHUNK_CHARS, OVERLAP, LOOKAHEAD = 1 << 16, 2048, 4
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=4)
def encoder(vocab: str, pattern: str):
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(vocab: str) -> list[bytes]:
    with open(vocab, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def decode_bytes(packed: bytes, vocab: str) -> bytes:
    return b"".join(map(token_bytes(vocab).__getitem__, unpack(packed)))


def _in_batches(rows, schema: pa.Schema, weight):
    """Record batches of bounded bytes out of a stream of tuples."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _with_ids(df: DataFrame, text: str, vocab: str, pattern: str) -> DataFrame:
    """Adds ``ids_le`` (32-bit little-endian ids) to each row and drops its text."""
    others = [c for c in df.columns if c != text]
    out = df.drop(text).withColumn("ids_le", F.lit(b""))

    def run(batches):
        enc = encoder(vocab, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            step = max(1, min(len(texts), int(len(texts) * BATCH_BYTES / max(1, texts.nbytes))))
            for i in range(0, len(texts), step):
                part = b.slice(i, step)
                ids = [pack(enc.encode_ordinary(t or "")) for t in texts.slice(i, step).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in others] + [pa.array(ids, pa.binary())], names=[*others, "ids_le"])

    return df.mapInArrow(run, out.schema)


def _chunks(df: DataFrame, chunk: int, overlap: int) -> DataFrame:
    schema = pa.schema([("ck1", pa.int64()), ("ck2", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("piece", pa.string())])

    def run(batches):
        def rows():
            for b in batches:
                for a, c, t in zip(b.column("ck1").to_pylist(), b.column("ck2").to_pylist(), b.column("text")):
                    t = t.as_py()
                    for k, s in enumerate(range(0, len(t), chunk)):
                        yield a, c, k, s, len(t), t[s : s + chunk + overlap]

        yield from _in_batches(rows(), schema, lambda r: 4 * len(r[5]))

    return df.mapInArrow(run, "ck1 long, ck2 long, k int, start long, total long, piece string")


def _boundaries(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Token starts of each chunk inside its first and its last overlap, as positions of the text."""
    schema = pa.schema([("ck1", pa.int64()), ("ck2", pa.int64()), ("k", pa.int32()), ("total", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def run(batches):
        import regex

        find = regex.compile(pattern).finditer

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    s, text = r["start"], r["piece"]
                    cut = len(text) - (LOOKAHEAD if s + len(text) < r["total"] else 0)
                    ends = [m.end() for m in find(text) if m.end() <= cut]
                    yield r["ck1"], r["ck2"], r["k"], r["total"], [s + e for e in ends if e <= overlap], [s + e for e in ends if e > chunk]

        yield from _in_batches(rows(), schema, lambda r: 8 * (len(r[4]) + len(r[5])))

    return chunks.mapInArrow(run, "ck1 long, ck2 long, k int, total long, head array<long>, tail array<long>")


def _long_ids(long: DataFrame, vocab: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(ck1, ck2, ids_le) of every distinct text given as (ck1, ck2, text)."""
    chunks = _chunks(long, chunk, overlap).repartition("ck1", "ck2", "k")
    by_text = Window.partitionBy("ck1", "ck2")
    order = by_text.orderBy("k")
    cuts = (
        _boundaries(chunks, pattern, chunk, overlap)
        .withColumn("from", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
        .withColumn("whole", F.max(F.col("from").isNull()).over(by_text))
        .withColumn("to", F.coalesce(F.lead("from").over(order), "total"))
        .drop("head", "tail", "total")
    )
    stitched = chunks.join(cuts.where(~F.col("whole")), ["ck1", "ck2", "k"]).select("ck1", "ck2", "k", F.expr("substring(piece, int(from - start) + 1, int(to - from))").alias("text"))
    failed = cuts.where(F.col("whole") & (F.col("k") == 0)).select("ck1", "ck2")
    whole = long.join(failed, ["ck1", "ck2"]).select("ck1", "ck2", F.lit(0).alias("k"), "text")
    parts = _with_ids(stitched.unionByName(whole), "text", vocab, pattern)
    gathered = parts.groupBy("ck1", "ck2").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids_le"))), lambda x: x["ids_le"]).alias("parts"))

    def join(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("ck1"), row.column("ck2"), pa.array([b"".join(row.column("parts")[0].as_py())], pa.binary())], names=["ck1", "ck2", "ids_le"])

    return gathered.mapInArrow(join, "ck1 long, ck2 long, ids_le binary")


def encode(docs: DataFrame, vocab: str, pattern: str, text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Every row of ``docs`` without its text, and ``ids_le``: its token ids packed as
    little-endian unsigned 32-bit integers."""
    docs = docs.withColumnRenamed(text, "_bpe_text") if text != "_bpe_text" else docs
    docs = docs.withColumn("_bpe_text", F.coalesce(F.col("_bpe_text").cast("string"), F.lit("")))
    is_long = F.length("_bpe_text") > chunk_chars
    short = _with_ids(docs.where(~is_long), "_bpe_text", vocab, pattern)
    key = [c.alias(f"_bpe_{n}") for c, n in zip(content_key(F.col("_bpe_text")), ("ck1", "ck2"))]
    long = docs.where(is_long).select("*", *key)
    distinct = long.groupBy(F.col("_bpe_ck1").alias("ck1"), F.col("_bpe_ck2").alias("ck2")).agg(F.first("_bpe_text").alias("text"))
    ids = _long_ids(distinct, vocab, pattern, chunk_chars, overlap).select(F.col("ck1").alias("_bpe_ck1"), F.col("ck2").alias("_bpe_ck2"), "ids_le")
    return short.unionByName(long.drop("_bpe_text").join(ids, ["_bpe_ck1", "_bpe_ck2"]).drop("_bpe_ck1", "_bpe_ck2"))


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows with ``ids_le``."""
    names = [*encoded.columns, "decoded"]

    def run(batches):
        for b in batches:
            step = max(1, min(len(b), int(len(b) * BATCH_BYTES / max(1, b.nbytes))))
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                raw = [decode_bytes(x, vocab) for x in part.column(part.schema.get_field_index("ids_le")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=names)

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(b"")).schema)


def digest(docs: DataFrame, vocab: str, pattern: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return decode(encode(docs.select("doc_id", "text"), vocab, pattern, **options), vocab).select(
        "doc_id",
        F.expr("bigint(length(ids_le) / 4)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
