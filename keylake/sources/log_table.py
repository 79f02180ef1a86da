"""A record log as Parquet: one table partitioned by batch, and a small commit row for each batch that makes it visible.

A writer appends its rows as a partition of their own, then puts the next numbered commit in place with a rename that must
not replace anything; who loses that race reads the new commit and judges the batch again. Readers take the partitions
that commits name, by a join that prunes partitions, so they see whole batches only. Compaction writes the log again,
sorted by key, as one batch that stands for all before it. Each commit carries on what a writer needs (head, clocks, epoch),
so a writer reads one row, however long the history is.

File systems must rename without replacing in one step: HDFS, ABFS and local disks do; plain object stores do not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.operators.log import KEY, latest, snapshot, sweep
from keylake.operators.write import WriteRefused, first_conflict, index_fault, judged, log_rows, undone
from keylake.plans.catalog import Catalog
from keylake.sources.work import scratch

FILE = "struct<name:string,media_type:string,size:bigint,sha256:string,path:string>"
LOG_SCHEMA = (
    "seq long, schema string, hash string, range string, range_enc string, deleted boolean, revision string, authored_ms long, "
    "alternates map<string,struct<hash:string,range_enc:string>>, record string, created_by string, updated_by string, written_nanos long, "
    f"file {FILE}, verb string"
)
#: A commit: its number and batch; the first and last seq of the batch; head, clocks and epoch of the log from then on; and,
#: if the batch stands for all commits up to another, that one's number.
COMMIT_SCHEMA = "number long, batch string, first long, last long, head long, ms long, nanos long, epoch string, base long"


class Raced(RuntimeError):
    """Another writer made this commit."""


class RecordLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """COMMIT_SCHEMA rows, one a commit."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs(folder).exists(folder):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path}/_commits")

    def state(self) -> dict:
        """The last commit: number, head, ms, nanos, epoch; zeros before the first."""
        last = self.commits().orderBy(F.desc("number")).limit(1).collect()
        return last[0].asDict() if last else {"number": 0, "head": 0, "ms": 0, "nanos": 0, "epoch": None}

    def epoch(self) -> str | None:
        """Changes when the log is restored to an older state: who follows the log then rebuilds what it derived."""
        return self.state()["epoch"]

    def read(self, version: int | None = None) -> DataFrame:
        """All log rows, or those up to a commit."""
        commits = self.commits() if version is None else self.commits().where(F.col("number") <= version)
        base = commits.agg(F.max("base"), F.count("*")).first()
        if not base[1]:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        kept = commits.where(F.col("number") > (base[0] or 0)).select("batch")
        return self.spark.read.schema(f"{LOG_SCHEMA}, batch string").parquet(f"{self.path}/data").join(kept, "batch", "left_semi").drop("batch")

    def snapshot(self, version: int | None = None) -> DataFrame:
        return snapshot(self.read(version))

    def append(self, rows: DataFrame, state: dict, ms: int = 0, base: int | None = None, epoch: str | None = None) -> int:
        """Writes rows sorted by key, so row groups prune, and commits them after the state given; returns the commit's number.

        No rows make no commit. Columns that the log does not have are refused.
        """
        empty = self.spark.createDataFrame([], LOG_SCHEMA)
        if unknown := [c for c in rows.columns if c not in empty.columns]:
            raise ValueError(f"the log has no column {', '.join(unknown)}")
        batch = uuid.uuid4().hex
        folder = f"{self.path}/data/batch={batch}"
        empty.unionByName(rows, allowMissingColumns=True).sortWithinPartitions(*KEY).write.parquet(folder)
        first, last, nanos = self.spark.read.schema("seq long, written_nanos long").parquet(folder).agg(F.min("seq"), F.max("seq"), F.max("written_nanos")).first()
        if first is None and base is None:
            return state["number"]
        number = state["number"] + 1
        body = {"number": number, "batch": batch, "first": first, "last": last, "head": max(state["head"], last or 0), "ms": max(ms, state["ms"]), "nanos": max(nanos or 0, state["nanos"])}
        self._commit(number, {**body, "epoch": epoch or state["epoch"] or uuid.uuid4().hex, "base": base})
        return number

    def write(self, batch: DataFrame, now_ms: int, stream: str, writer: str, tries: int = 5, catalog: Catalog | None = None) -> int:
        """Judges a batch against the live records at its keys and commits it whole, or raises WriteRefused with the first conflict.

        With a catalog, items must also fit their schema: its key layout, its fields and their types, and its file rule.
        """
        batch = batch.withColumn("range_enc", F.coalesce("range_enc", F.lit("")))
        for _ in range(tries):
            state = self.state()
            with scratch(self.spark) as keep:
                old = self.read().join(batch.select(*KEY).distinct(), KEY, "left_semi")
                verdicts = keep(judged(batch, snapshot(old), catalog=catalog))
                if found := first_conflict(verdicts).first() or index_fault(verdicts).first():
                    raise WriteRefused(found["index"], found["reason"])
                try:
                    return self.append(log_rows(verdicts, state["head"], max(now_ms, state["ms"]), max(now_ms * 1_000_000, state["nanos"] + 1), stream, writer), state, now_ms)
                except Raced:
                    continue
        raise Raced(f"lost {tries} races")

    def erase(self, keys: DataFrame, now_ms: int, stream: str, writer: str, verb: str = "purge") -> int:
        """Tombstones for keys (KEY, seq: the version judged), unless written since. verb, purge or delete, goes with them.

        Numbering needs no sort: each task's rows follow those of the task before.
        """
        if verb not in ("purge", "delete"):
            raise ValueError("erase by purge or delete")
        state = self.state()
        with scratch(self.spark) as keep:
            live = snapshot(self.read().join(keys.select(*KEY).distinct(), KEY, "left_semi"))
            gone = live.join(keys.select(*KEY, "seq").distinct(), [*KEY, "seq"], "left_semi")
            gone = keep(gone.withColumn("_at", F.monotonically_increasing_id()))
            task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
            starts, at = [], 0
            for r in gone.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
                starts.append((r["task"], at))
                at += r["n"]
            numbered = gone.join(F.broadcast(self.spark.createDataFrame(starts, "_task long, _start long")), task == F.col("_task")).withColumn("index", F.col("_start") + place)
            rows = undone(numbered, state["head"], max(now_ms, state["ms"]), max(now_ms * 1_000_000, state["nanos"] + 1), stream, writer, verb)
            return self.append(rows, state, now_ms)

    def sweep(self, policies: DataFrame, now_ms: int, stream: str, writer: str, verb: str = "purge") -> int:
        """Erases what has expired by the policies (schema, layout, ttl_seconds)."""
        return self.erase(sweep(self.read(), policies, now_ms // 1000), now_ms, stream, writer, verb)

    def drop_schema(self, catalog: Catalog, name: str, now_ms: int, stream: str, writer: str) -> int:
        """Blocks a schema, erases its records and takes it out of the catalog."""
        catalog.block(name)
        done = self.erase(self.snapshot().where(F.col("schema") == name).select(*KEY, "seq"), now_ms, stream, writer)
        catalog.drop(name)
        return done

    def compact(self, history: int | None = None) -> int:
        """Writes the log again as one sorted batch and returns its commit. With history, versions older than so many changes go if
        a later one of their key overrides them, and purged keys with them; without, every version stays."""
        state = self.state()
        rows = self.read()
        if history is not None:
            top = F.lit(state["head"] - history)
            last = latest(rows.select(*KEY, "seq", F.coalesce(F.col("deleted") & (F.col("verb") == "purge"), F.lit(False)).alias("_purged"))).withColumnRenamed("seq", "_last")
            rows = rows.join(last, KEY).where((F.col("seq") > top) | ((F.col("seq") == F.col("_last")) & ~F.col("_purged"))).drop("_last", "_purged")
        return self.append(rows, state, base=state["number"])

    def restore(self, version: int) -> int:
        """Makes the log what it was at a commit, under a new epoch; positions go on from the present head."""
        state = self.state()
        return self.append(self.read(version), state, base=state["number"], epoch=uuid.uuid4().hex)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, number: int, body: dict) -> None:
        """Puts a commit file in place whole, or raises Raced if its number is taken."""
        jvm = self.spark._jvm
        final, draft = self._path(f"{self.path}/_commits/{number:012d}.json"), self._path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        fs = self._fs(final)
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Raced(f"commit {number} exists") from error
            raise


def change_rows(log: RecordLog, batches: list[str], columns: list[str]) -> DataFrame:
    """Columns of the rows of some batches."""
    wanted: Column = F.col("batch").isin(batches)
    return log.spark.read.schema(f"{LOG_SCHEMA}, batch string").parquet(f"{log.path}/data").where(wanted).select(*columns)
