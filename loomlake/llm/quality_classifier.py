"""Supervised subword embeddings for document quality.

A document is the mean of learned vectors of its features, hashed to ``BUCKETS``:
its words, the byte 3- and 4-grams within them and at their edges, and, in place of
these for a word that repeats the one before it, one shared feature. A softmax over two outputs
scores the mean. Vectors and outputs are trained by stochastic gradient descent
in numpy, with a step that adapts to each vector, on at most ``SAMPLE`` documents
of each label: those with the smallest hash of doc_id (a stated bound; scoring
covers every document). Scoring needs one number per feature, so executors get a
table of BUCKETS floats.

A null or empty text has no features and gets the score of the bias alone. With no
usable labels every score is 0.5. Labels and ids are never features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BASE, blocks, mix, spaces, word_hashes

BITS, DIM, SAMPLE, EPOCHS, RATE = 17, 8, 1200, 6, 0.2
BUCKETS = 1 << BITS
REPEAT, REPEAT_WEIGHT = 0, 8  # bucket of a word equal to its predecessor, and how often it counts


def _buckets(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str):
    """Arrays of buckets, block by block."""
    last = None
    for raw in blocks(text.encode("utf-8", "surrogatepass")):
        codes = np.frombuffer(b" " + raw + b" ", np.uint8)
        words, starts = word_hashes(codes)
        if not len(words):
            continue
        before = np.concatenate([words[:1] ^ np.uint64(1) if last is None else last, words[:-1]])
        again, last = words == before, words[-1:]
        yield _buckets(words[~again])
        yield np.full(REPEAT_WEIGHT * int(again.sum()), REPEAT)
        gap = spaces(codes)
        new = np.repeat(~again, np.diff(starts, append=len(codes)))  # bytes of words that do not repeat
        new = np.concatenate([np.ones(len(codes) - len(new), bool), new])
        x = np.where(gap, 32, codes).astype(np.uint64)
        pair = x[:-1] * BASE + x[1:]
        three = pair[:-1] * BASE + x[2:]
        yield _buckets(three[~gap[1:-1] & new[1:-1]] + np.uint64(3))
        four = three[:-1] * BASE + x[3:]
        yield _buckets(four[~(gap[1:-2] | gap[2:-1]) & new[1:-2]] + np.uint64(4))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = list(features(text))
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    at, n = np.unique(np.concatenate(found), return_counts=True)
    return at.astype(np.uint32), n.astype(np.float32)


@dataclass
class Model:
    table: np.ndarray  # what each feature adds to the log odds of label 1, before the mean
    bias: float

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total += float(self.table[f].sum(dtype=np.float64))
            n += len(f)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0.0), -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """``rows``: (buckets, counts, label) of each document, in a fixed order."""
    if len({y for *_, y in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32) / DIM
    seen = np.full(BUCKETS, 1e-8, np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    out_seen, bias_seen = np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    share = np.bincount([y for *_, y in rows], minlength=2) / len(rows)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(rows)):
            at, n, y = rows[i]
            weight = np.float32(0.5 / share[y])
            part = (n / n.sum()).astype(np.float32) if len(n) else n
            mean = part @ vectors[at] if len(n) else np.zeros(DIM, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = (p / p.sum()).astype(np.float32)
            g[y] -= 1
            g *= weight
            back = out @ g
            d_out = np.outer(mean, g)
            out_seen += d_out * d_out
            bias_seen += g * g
            out -= rate * d_out / np.sqrt(out_seen)
            bias -= rate * g / np.sqrt(bias_seen)
            if len(at):
                step = part * np.float32(np.sqrt(back @ back))
                seen[at] += step * step
                vectors[at] -= rate * (part / np.sqrt(seen[at]))[:, None] * back
    diff = out[:, 1] - out[:, 0]
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int, keep: Callable[[Column], Column]) -> list:
    """Features of the sampled documents, ``per_label`` of each label among those whose id ``keep``
    takes; each is at most BUCKETS pairs, whatever its text's length."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_label rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                at, n = counts(b.column("text")[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1).cast(pa.int64()), b.column("y").slice(i, 1).cast(pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["doc_id", "y", "at", "n"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, at binary, n binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.at)))
    return [(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["n"], np.float32), r["y"]) for r in got]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE, keep: Callable[[Column], Column] = lambda doc_id: F.lit(True)) -> Model:
    return train(training_rows(docs, labels, label, per_label, keep))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches):
        m = sent.value
        for b in batches:
            got = [m.score(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id):
    """The fold that never trains; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labelled rows outside the held-out fold and scores every document."""
    model = fit(docs, labels, keep=lambda doc_id: ~held_out(doc_id))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
