"""Files of records: a content-addressed table of bytes, links to files that stay where they are, and reads by marker.

A marker (name, media_type, size, sha256, path) goes with its record in the log. Stored bytes lie once per digest, partitioned
by its first two digits; a marker with a path links to a file outside. Bytes are read back only by marker and checked
against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "sha256 string, content binary, part string"


def marker(name: Column, media_type: Column, content: Column, path: Column | None = None) -> Column:
    """The marker of some bytes."""
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), media_type.alias("media_type"), F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), (none if path is None else path).alias("path"))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(STORED).parquet(folder) if there else spark.createDataFrame([], STORED)


def store(files: DataFrame, folder: str) -> None:
    """Adds the contents (a binary column) that the folder lacks, each once. Two writers at once may store a content twice; reads take one."""
    spark = files.sparkSession
    digest = F.sha2("content", 256)
    new = files.where("content IS NOT NULL").select(digest.alias("sha256"), "content", F.substring(digest, 1, 2).alias("part")).dropDuplicates(["sha256"])
    new.join(_stored(spark, folder).select("part", "sha256"), ["part", "sha256"], "left_anti").write.mode("append").partitionBy("part").parquet(folder)


def links(spark: SparkSession, paths: str | list[str], media_type: Column | None = None) -> DataFrame:
    """path and file (a marker) of files that are linked to, not copied."""
    found = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", marker(name, F.lit(None).cast("string") if media_type is None else media_type, F.col("content"), F.col("path")).alias("file"))


def opened(rows: DataFrame, folder: str) -> DataFrame:
    """rows (with a column file) with `content`: the bytes of each marker, null if they are gone or no longer agree with it."""
    spark = rows.sparkSession
    held = _stored(spark, folder).dropDuplicates(["sha256"]).select(F.col("sha256").alias("_sha"), F.col("content").alias("_held"), F.col("part").alias("_part"))
    kept = rows.join(held, (F.substring("file.sha256", 1, 2) == F.col("_part")) & (F.col("file.sha256") == F.col("_sha")), "left")
    linked = [r[0] for r in rows.where("file.path IS NOT NULL").select("file.path").distinct().limit(LINKS_MOST + 1).collect()]
    if len(linked) > LINKS_MOST:
        raise ValueError(f"at most {LINKS_MOST} linked files are opened at once")
    if not linked:
        return kept.withColumnRenamed("_held", "content").drop("_sha", "_part")
    outside = spark.read.format("binaryFile").load(linked).select(F.col("path").alias("_path"), F.col("content").alias("_linked"))
    both = kept.join(outside, F.col("file.path") == F.col("_path"), "left")
    sound = F.when((F.length("_linked") == F.col("file.size")) & (F.sha2("_linked", 256) == F.col("file.sha256")), F.col("_linked"))
    return both.withColumn("content", F.coalesce("_held", sound)).drop("_sha", "_part", "_held", "_path", "_linked")


#: Linked files are named one by one to the reader, so one call opens no more than this.
LINKS_MOST = 10_000
