"""Embedding as a plug-in: batches with a fallback per item, byte codec, pooling, folder vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational, vector

BATCH = 8
Embed = Callable[[list[str]], list[list[float]]]


def embed_chunks(chunks: DataFrame, embed: Embed, text: str = "text", id_col: str = "chunk_id", batch: int = BATCH) -> DataFrame:
    """(<id>, embedding). A failing batch is tried item by item; items that fail are left out and
    found again by the next refresh, since their count differs."""
    kind = dict(chunks.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            keys, found = [], []
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                texts = part[text].fillna("").tolist()
                try:
                    got: list = list(embed(texts))
                except Exception:
                    got = []
                    for t in texts:
                        try:
                            got.append(embed([t])[0])
                        except Exception:
                            got.append(None)
                for k, v in zip(part[id_col], got):
                    if v is not None:
                        keys.append(k)
                        found.append(list(map(float, v)))
            yield pd.DataFrame({id_col: pd.Series(keys, dtype=object), "embedding": pd.Series(found, dtype=object)})

    return chunks.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def to_bytes(v: Column) -> Column:
    """Little-endian 32-bit floats."""
    return F.udf(lambda x: None if x is None else np.asarray(x, "<f4").tobytes(), "binary", useArrow=True)(v)


def from_bytes(raw: Column) -> Column:
    return F.udf(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist(), "array<float>", useArrow=True)(raw)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, tokens, dims) averaged over unmasked tokens and brought to length one; zero stays zero."""
    weight = mask[:, :, None].astype(np.float32)
    mean = (states * weight).sum(1) / np.maximum(weight.sum(1), 1)
    norm = np.sqrt((mean * mean).sum(1, keepdims=True))
    return np.where(norm > 0, mean / np.where(norm > 0, norm, 1), mean)


def backfilled(docs: DataFrame, scanned: DataFrame, values: list[str], key: str = "file_uri") -> DataFrame:
    """Fills only missing values of unchanged documents."""
    new = scanned.select(key, *(F.col(v).alias(f"_new_{v}") for v in values))
    return docs.join(new, key, "left").select(*(F.coalesce(c, f"_new_{c}").alias(c) if c in values else F.col(c) for c in docs.columns))


def rebuilt_folders(stored: DataFrame, docs: DataFrame, embed: Embed) -> DataFrame:
    """Folder rows (path, embedding) made anew; the stored ones stay if nothing could be embedded."""
    folders = relational.folder_groups(docs)
    texts = folders.select(F.col("folder").alias("path"), F.concat_ws("\n", F.col("folder"), F.array_join("headings", "\n")).alias("text"))
    new = embed_chunks(texts, embed, id_col="path").withColumn("embedding", vector.normalise(F.col("embedding")))
    return new if new.limit(1).count() else stored
