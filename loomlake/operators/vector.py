"""Exact vector search as built-in expressions; every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SCORE, FIRST_K, OTHER_K = 0.45, 20, 10


def dot(a: Column, b: Column) -> Column:
    """Sum of products; vectors of different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int | Column, id_col: str = "vec_id") -> DataFrame:
    """(question_id, rank, <id>, score). ``queries``: (question_id, qvec), few by nature (what people
    ask at once); a join without a key streams the vectors past them and Spark picks the side by size."""
    pairs = vectors.select(id_col, "embedding").crossJoin(queries)
    found = pairs.withColumn("score", dot(F.col("embedding"), F.col("qvec"))).drop("embedding", "qvec")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), id_col)
    limit = F.lit(k) if isinstance(k, int) else k
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def top_k_scoped(vectors: DataFrame, allowed: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Filter first, then rank."""
    return top_k(vectors.join(allowed, id_col, "left_semi"), queries, k, id_col)


def above(found: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The cut by score comes after the ranking."""
    return found.where(F.col("score") >= least)


def multi_query(vectors: DataFrame, variants: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Variants (question_id, q_idx, qvec): the first asks for 20, others for 10; each id keeps its first place."""
    keyed = variants.select(F.struct("question_id", "q_idx").alias("question_id"), "qvec")
    found = top_k(vectors, keyed, F.when(F.col("question_id.q_idx") == 0, FIRST_K).otherwise(OTHER_K), id_col)
    flat = found.select(F.col("question_id.question_id").alias("question_id"), F.col("question_id.q_idx").alias("q_idx"), F.col("rank").alias("sub"), id_col, "score")
    best = flat.groupBy("question_id", id_col).agg(F.min_by(F.struct("q_idx", "sub", "score"), F.struct("q_idx", "sub")).alias("b")).select("question_id", id_col, "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("q_idx", "sub")) - 1)


def folder_vectors(members: DataFrame) -> DataFrame:
    """(path, embedding): the normalised mean of the member vectors (path, embedding)."""
    parts = members.select("path", F.posexplode("embedding").alias("i", "x")).groupBy("path", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).select("path", normalise(F.col("v")).alias("embedding"))


def nearest_folders(folders: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    return top_k(folders, queries, k, "path")
