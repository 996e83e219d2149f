"""Nearest neighbours by learned partitions of a neighbour graph.

Equal vectors are kept once with their smallest ids (one more than ``k``: a query's
k nearest never need further ones of the same vector). On a bounded sample of at most
``SAMPLE`` vectors a k-nearest-neighbour graph is built and cut into balanced parts
by moving nodes towards the parts of their neighbours; a small network with one
hidden layer learns the part of a vector. Every vector is indexed in its most probable
part, every query searches its most probable ones (as many as the sample needs for
``TARGET`` recall), and found vectors are ranked by their exact cosine in double
precision, ties by id. Large parts are dealt out in blocks that together cover the part.

Vectors null, zero, with null or non-finite components, or of another length than
most take no part; nor do null ids. Rows repeating an id with the same vector count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, GRAPH_K, PART_ROWS, MAX_PARTS, HIDDEN, TARGET, BLOCK = 8192, 10, 1500, 256, 96, 0.985, 8192
#: Candidates within ROUNDING of the last one taken, more than a matrix product errs, are ranked
#: exactly; cosines that agree to PLACES, as those of multiples of one vector, tie.
ROUNDING, PLACES = 1e-9, 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other rows by cosine, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        sim = x[s : s + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out[s : s + 1024] = np.argpartition(-sim, k - 1, 1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size that keep neighbours together. It starts from halves along
    main directions and moves nodes to where most of their neighbours are, while there is room."""
    part = np.zeros(len(x), np.int64)

    def halve(rows, first, n):
        if n == 1:
            part[rows] = first
            return
        v = x[rows] - x[rows].mean(0)
        d = v[0] + 1e-9
        for _ in range(8):
            d = v.T @ (v @ d)
            d /= np.linalg.norm(d) + 1e-12
        order = rows[np.argsort(v @ d, kind="stable")]
        cut = len(rows) * (n // 2) // n
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    links = [np.concatenate([graph[i], np.array(back[i], np.int64)]) for i in range(len(x))]
    size = np.bincount(part, minlength=parts)
    room = int(np.ceil(len(x) / parts * slack))
    for _ in range(sweeps):
        moved = 0
        for i, near in enumerate(links):
            votes = np.bincount(part[near], minlength=parts)
            old = part[i]
            votes[(size >= room) & (np.arange(parts) != old)] = -1
            new = int(votes.argmax())
            if votes[new] > votes[old]:
                size[old] -= 1
                size[new] += 1
                part[i] = new
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def most_probable(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), 1, kind="stable")[:, :n]


def train_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 25, seed: int = 5) -> Router:
    """Softmax over parts, by mini-batch gradient descent with adaptive steps."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(2 / HIDDEN), np.zeros(parts)]
    m, v, step = [0 * q for q in p], [0 * q for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 128):
            rows = order[s : s + 128]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(rows)), part[rows]] -= 1
            g /= len(rows)
            dh = (g @ p[2].T) * (h > 0)
            step += 1
            for i, d in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.99 * v[i] + 0.01 * d * d
                p[i] = p[i] - 0.01 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, rows: int, k: int, target: float = TARGET) -> Router:
    """A router for about ``rows`` vectors; its number of probes is measured on the sample."""
    x = _unit(np.asarray(sample, np.float64))
    parts = 1
    while parts < MAX_PARTS and rows / parts > PART_ROWS and len(x) / parts > 64:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbours(x, GRAPH_K)
    router = train_router(x, balanced_parts(x, graph, parts), parts)
    near = neighbours(x[: len(x)], k)[: 2000]
    home = router.most_probable(x, 1)[:, 0]
    ranks = np.argsort(router.most_probable(x[: len(near)], parts), 1)
    needed = np.take_along_axis(ranks, home[near], 1)
    for router.probes in range(1, parts + 1):
        if (needed < router.probes).mean() >= target:
            break
    return router


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == top[0]["n"]) if top else rows


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: (eid, ids, v) with its ``keep`` smallest ids."""
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    once = rows.select("vec_id", "v", *key).groupBy("k1", "k2", "vec_id").agg(F.first("v").alias("v"))
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("r") <= keep)
    return few.groupBy("k1", "k2").agg(F.min("vec_id").alias("eid"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).drop("k1", "k2")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every usable row of ``queries`` (same columns) its
    k nearest other rows of ``vectors``, ties to the smaller id."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector), usable(queries, id_col, vector)
    index = entries(rows, k + 1)
    result = "query_id long, vec_id long, score double"
    # at most SAMPLE vectors come to the driver
    sample = index.select("eid", "v").orderBy(F.xxhash64("eid"), "eid").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(np.array([r.v for r in sample]), index.count(), k)
    sent = spark.sparkContext.broadcast(router)  # a fixed size

    def placed(n):
        def run(batches):
            for b in batches:
                if len(b):
                    x = _unit(np.vstack(b["v"].to_numpy()).astype(np.float64))
                    yield b.assign(part=list(sent.value.most_probable(x, n).astype(np.int32)))

        return run

    at_home = index.mapInPandas(placed(1), "eid long, ids array<long>, v array<double>, part array<int>").withColumn("part", F.get("part", F.lit(0)))
    routed = asked.groupBy("vec_id").agg(F.first("v").alias("v")).mapInPandas(placed(router.probes), "vec_id long, v array<double>, part array<int>").select("vec_id", "v", F.explode("part").alias("part"))
    # blocks: a part's vectors and queries are dealt out so that each pair of blocks is bounded
    sizes = at_home.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nb"))
    asks = routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nq"))
    plan = F.broadcast(sizes.join(asks, "part"))  # at most MAX_PARTS rows
    left = at_home.join(plan, "part").withColumn("b", F.pmod(F.xxhash64("eid"), F.col("nb"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    right = routed.join(plan, "part").withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("nq"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))

    def rerank(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_s = [], [], []
        if len(found) and len(wanted):
            x = np.vstack(found["v"].to_numpy())
            y = np.vstack(wanted["v"].to_numpy())
            norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            ids, asked_ids = found["ids"].to_numpy(), wanted["vec_id"].to_numpy()
            take = min(len(x), k + 1)  # the asked vector itself may be one of them
            for s in range(0, len(y), 256):
                sim = (y[s : s + 256] / norm_y[s : s + 256, None]) @ (x / norm_x[:, None]).T
                least = np.partition(sim, len(x) - take, 1)[:, len(x) - take] - ROUNDING
                for i, low in enumerate(least):
                    q, row = s + i, np.flatnonzero(sim[i] >= low)
                    exact = (x[row] * y[q]).sum(1) / (norm_x[row] * norm_y[q])
                    pairs = sorted((-t, int(j), c) for t, c, r in zip(exact.round(PLACES), exact, row) for j in ids[r] if j != asked_ids[q])[:k]
                    out_q += [asked_ids[q]] * len(pairs)
                    out_v += [j for _, j, _ in pairs]
                    out_s += [c for _, _, c in pairs]
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    found = left.select("part", "b", "q", "ids", "v").groupBy("part", "b", "q").cogroup(right.select("part", "b", "q", "vec_id", "v").groupBy("part", "b", "q")).applyInPandas(rerank, result)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 50) -> DataFrame:
    """Queries: the rows whose id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0))
