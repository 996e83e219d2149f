"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted in cells of source, language and topic, weighed by an estimate of
their tokens (UTF-8 bytes / 4, rounded up). The cells' weights are raked in turn to the
target of each margin, ``SWEEPS`` times. A target is a given share, or by default the
margin's own share to the power ALPHA, normalised. A document is kept with the probability
(raked weight / own weight) of its cell over the largest such ratio, so that kept tokens
have the raked proportions; the draw is a hash of doc_id, the same in every run. The topic
is a form of text told by its length and marks, or a column of the caller.

Null source or language are groups of their own; null text counts as empty, with weight 0,
and is kept. Rows repeating a doc_id share a draw. Names starting with ``_m`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DIMS = ("_m_source", "_m_lang", "_m_topic")
ALPHA = {"_m_source": 0.9, "_m_lang": 0.9, "_m_topic": 1.0}
SWEEPS = 6
MARKS = "#*$%&!"


def topic_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    marks = n - F.length(F.translate(t, MARKS, ""))
    return F.when(bars * 60 > n, "table").when(marks * 20 > n, "marks").when(n >= 6000, "long").when(n < 600, "short").otherwise("prose")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on doc_id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def keyed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    missing = F.lit("\u0000")
    return docs.withColumns(
        {
            "_m_source": F.coalesce(F.col("source").cast("string"), missing),
            "_m_lang": F.coalesce(F.col("lang").cast("string"), missing),
            "_m_topic": topic_of(F.col("text")) if topic is None else F.coalesce(topic.cast("string"), missing),
            "_m_tokens": F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("double"),
        }
    )


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, scratch: Scratch | None = None) -> DataFrame:
    """Cells (the DIMS and ``t``) with their raked weight ``w`` and probability ``p``. ``targets``:
    per dimension a table (the dimension, share); others follow ALPHA. The cells stay distributed;
    one row of totals is all that is broadcast. With ``scratch`` the cells are written, after each
    margin, sweep and at the end: of one plan of it all the driver gets a new description at each stage."""
    stored = scratch.table if scratch else lambda df, name: df
    cells = stored(cells, "cells")
    total = cells.agg(F.sum("t").alias("_m_all"))
    w = cells.where("t > 0").withColumn("w", F.col("t")).crossJoin(F.broadcast(total))  # one row
    for d in DIMS:
        own = cells.where("t > 0").groupBy(d).agg(F.sum("t").alias("_m_t"))
        if targets and d in targets:
            goal = own.join(targets[d], d, "left").select(d, F.coalesce("share", F.lit(0.0)).alias("_m_g"))
        else:
            goal = own.select(d, F.pow("_m_t", F.lit(ALPHA[d])).alias("_m_g"))
        norm = goal.agg(F.sum("_m_g").alias("_m_n"))
        goal = goal.crossJoin(F.broadcast(norm)).select(d, (F.col("_m_g") / F.col("_m_n")).alias(f"{d}_goal"))  # one row
        w = stored(w.join(goal, d), "weights")
    for _ in range(sweeps):
        for d in DIMS:
            w = w.withColumn("w", F.col("w") * F.col(f"{d}_goal") * F.col("_m_all") / F.sum("w").over(Window.partitionBy(d)))
        w = stored(w, "weights")
    top = w.agg(F.max(F.col("w") / F.col("t")).alias("_m_top"))
    return stored(w.crossJoin(F.broadcast(top)).select(*DIMS, "t", "w", (F.col("w") / F.col("t") / F.col("_m_top")).alias("p")), "shares")  # one row


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, sweeps: int = SWEEPS, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` with topic, tokens, probability and kept added under _m names."""
    rows = keyed(docs, topic)
    cells = keyed(docs.select("doc_id", "source", "lang", "text") if topic is None else docs, topic).groupBy(*DIMS).agg(F.sum("_m_tokens").alias("t"))
    p = raked(cells, targets, sweeps, scratch).select(*DIMS, F.col("p").alias("_m_p"))
    out = rows.join(p, list(DIMS), "left").withColumn("_m_p", F.when(F.col("_m_tokens") == 0, 1.0).otherwise(F.coalesce("_m_p", F.lit(1.0))))
    return out.withColumn("_m_kept", draw(F.col("doc_id")) < F.col("_m_p"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    return calibrated(docs, **options).where("_m_kept").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return calibrated(docs.select("doc_id", "source", "lang", "text")).select("doc_id", F.col("_m_topic").alias("topic"), F.col("_m_tokens").cast("long").alias("n_tokens"), F.round("_m_p", 9).alias("probability"), F.col("_m_kept").alias("kept"))


def oracle(documents: str = "documents") -> str:
    dims = [d[3:] for d in DIMS]
    steps, last = [], "w0"
    for s in range(SWEEPS):
        for d in dims:
            new = f"w{s}_{d}"
            steps.append(f"{new} AS (SELECT * REPLACE (w * {d}_goal * all_t / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
            last = new
    goals = ",\n".join(f"g_{d} AS (SELECT {d}, pow(t, {ALPHA['_m_' + d]}::DOUBLE) / sum(pow(t, {ALPHA['_m_' + d]}::DOUBLE)) OVER () AS {d}_goal FROM (SELECT {d}, sum(t) AS t FROM cells WHERE t > 0 GROUP BY {d}))" for d in dims)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS text FROM {documents}),
k AS (SELECT doc_id, source, lang, ceil(strlen(text) / 4)::DOUBLE AS tokens,
  CASE WHEN (length(text) - length(replace(text, '|', ''))) * 60 > length(text) THEN 'table' WHEN (length(text) - length(translate(text, '{MARKS}', ''))) * 20 > length(text) THEN 'marks'
  WHEN length(text) >= 6000 THEN 'long' WHEN length(text) < 600 THEN 'short' ELSE 'prose' END AS topic FROM d),
cells AS (SELECT source, lang, topic, sum(tokens) AS t FROM k GROUP BY ALL),
{goals},
w0 AS (SELECT *, t AS w, (SELECT sum(t) FROM cells) AS all_t FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic) WHERE t > 0),
{", ".join(steps)},
p AS (SELECT source, lang, topic, w / t / max(w / t) OVER () AS p FROM {last})
SELECT doc_id, topic, tokens::BIGINT AS n_tokens, round(own, 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < own AS kept
FROM (SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE coalesce(p, 1) END AS own FROM k LEFT JOIN p USING (source, lang, topic))
"""
