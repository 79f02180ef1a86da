"""Helpers that the training-data operators share: text rules, working tables, skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.sources.work import removed, shared_folder, written

#: A word, as every operator of this package counts it: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (a small table in one file), dealt out to all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, or a fresh one where that is unset (one machine)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def materialize(spark: SparkSession, df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df once to a table in the shared folder and read it back: cuts lineage and survives lost executors.

    A working table that the new one replaces is deleted.
    """
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    out = written(spark, df, path)
    out._keylake_path = path
    if old := getattr(replaces, "_keylake_path", None):
        removed(spark, old)
    return out


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs whose DataFrames are gone; it does so when their objects are collected.

    Those of the last job are held until another one has run, so an empty one does.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that a worker takes up at once at most: whole texts may be long. And bytes of rows that Spark packs for it at once: the batch
#: stands in the executor's direct memory and again in the worker's, for each task.
BATCH_ROWS, BATCH_BYTES, BATCH_LIMIT = 2000, 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for workers end after the row that reaches BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def handed_back() -> None:
    """Gives a worker's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, given batches of BATCH_ROWS at most, that hands freed memory back at its end: workers live on
    between tasks, beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, max(batch.num_rows, 1), BATCH_ROWS))
        handed_back()

    return run


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column's values as UTF-8 bytes, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


#: A key is heavy if it has over one of HEAVY parts of all rows, so there are fewer heavy keys than this.
HEAVY = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join of left with right (one row per key, n: how many left rows have it) that no heavy key can skew.

    Keys with over total / HEAVY rows are fewer than HEAVY, so their rows of right are broadcast; all other rows
    meet in a shuffle join, where a heavy row's key is replaced by null and so matches nothing, dealt out by a random salt.
    """
    values = [c for c in right.columns if c not in (key, n)]
    hot = right.where(F.col(n) * HEAVY > total).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = right.where(F.col(n) * HEAVY <= total).select(F.col(key).alias("_key"), F.lit(0).alias("_salt"), *[F.col(c).alias(f"_rest_{c}") for c in values])
    x = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    light = F.col("_hot").isNull() & F.col(key).isNotNull()
    x = x.withColumns({"_lkey": F.when(light, F.col(key)), "_lsalt": F.when(light, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("int"))})
    x = x.join(rest, (F.col("_lkey") == F.col("_key")) & (F.col("_lsalt") == F.col("_salt")), "left")
    return x.select(*[x[c] for c in left.columns], *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values])


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most so many rows, those with the smallest hash of the key columns.

    A share of about twice as many is taken by hash first, so that no task sends more than its part of these.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    share = min(1.0, (2.0 * rows + 100) / max(df.count(), 1))
    return df.where(part <= F.lit(int(share * (1 << 30)))).orderBy(part, *key).limit(rows)
