"""Shared helpers: table reading, content keys, scratch tables, array idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: While a table is written: its shuffles go afterwards, batches sent to Python stay small, and
#: small shuffles become few files.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
#: Scratch tables need no checksum files and no marker: on a local file system each file costs processes.
OPTIONS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
SALTS = 8
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, one of our own if there is no other
    machine (tests); a cluster's executors could not read each other's, so that is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="loomlake-")
        root = _own[app]
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They survive lost executors, and go when
    ``clear`` is called or the driver ends. Once a table is written, Spark deletes the shuffle
    files it was made of."""

    _open: list["Scratch"] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        Scratch._open.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        before = {k: self.spark.conf.get(k, v) for k, v in WRITING.items()}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.options(**OPTIONS).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete one table that no later plan reads."""
        for f in df.inputFiles()[:1]:
            for p in [p for p in self.paths if p.rsplit("/", 1)[1] in f]:
                self._delete(p)
                self.paths.remove(p)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        for p in self.paths:
            self._delete(p)
        self.paths = []

    @classmethod
    def clear_all(cls) -> None:
        for s in cls._open:
            try:
                s.clear()
            except Exception:  # the driver's JVM has gone already
                pass
        cls._open.clear()


atexit.register(Scratch.clear_all)


def content_key(*cols: Column) -> list[Column]:
    """128 bits of content as two longs; null counts as empty."""
    full = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return [F.xxhash64(*full).alias("ck1"), F.xxhash64(F.lit("\u0001"), *full).alias("ck2")]


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``few``, which has one row for each of ``keys``. Rows of one key are dealt to
    ``SALTS`` tasks by the hash of ``spread``; ``few`` is repeated for each."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the column of that name in ``wanted``: what a
    join need not shuffle. Keys are looked up in a bitmap of their hashes, which has a fixed
    size (512 rows of 4 KiB) and lets more through the more keys there are."""
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 24))
    bits = wanted.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    found = rows.withColumn("_spot", spot).join(F.broadcast(bits), F.bitmap_bucket_number("_spot") == F.col("_bucket"))
    place = "bitmap_bit_position(_spot)"
    return found.where(f"shiftright(int(conv(hex(substr(_bits, int({place} div 8) + 1, 1)), 16, 10)), int({place} % 8)) % 2 = 1").drop("_spot", "_bucket", "_bits")
