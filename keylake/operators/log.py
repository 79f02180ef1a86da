"""Views of a record log: live snapshot, tombstones, overlays, change pages, expiry.

A log has one row per applied change: `seq` (unique, rising), `schema`, `hash`, `range_enc`, `deleted`, and record columns. All state
derives from it. The latest row of a key is an arg-max aggregation, which combines before it shuffles, so a key with
very many versions is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["schema", "hash", "range_enc"]
HISTORY, CHANGES_MOST = 250_000, 500
NANOS = 1_000_000_000
#: Rows that one task sorts, but for keys that have more.
SORTED_ROWS = 500_000


def latest(log: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """The last row of each key, by seq or other order columns."""
    rest = [c for c in log.columns if c not in key]
    rank = F.struct(*(order or ["seq"]))
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_last")).select(*key, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    """The log up to a position; all of it for None."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def snapshot(log: DataFrame, key: list[str] = KEY, seq: int | None = None) -> DataFrame:
    """Live records: the last row of each key unless it is a tombstone."""
    return latest(as_of(log, seq), key).where("NOT deleted")


def tombstones(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    return latest(log, key).where("deleted")


def overlay(committed: DataFrame, pending: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Committed rows with pending ones over them: the later pending row of a key wins, a pending delete hides it."""
    layers = committed.withColumn("_layer", F.lit(0)).unionByName(pending.withColumn("_layer", F.lit(1)))
    return latest(layers, key, ["_layer", "seq"]).where("NOT deleted").drop("_layer")


def version_counts(log: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Per key: versions, creates, updates and deletes, in log order (by seq or other order columns).

    A live row creates if the row before it is a tombstone or missing. One sort within the keys gives a row's predecessor and the
    counts up to it, and a key's last row has them all, so no task holds a table of its keys. Keys are dealt out to tasks of about
    SORTED_ROWS rows, however many rows the log has.
    """
    rows = log.select(*key, "deleted", *(order or ["seq"]))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED_ROWS))
    within = Window.partitionBy(*key).orderBy(*(order or ["seq"]))
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = rows.repartition(tasks, *key).withColumns({"gone": F.coalesce(F.lag("deleted").over(within), F.lit(True)), "last": F.lead(F.lit(True)).over(within).isNull()})
    counts = {"versions": F.count("*"), "created": F.count_if(F.expr("NOT deleted AND gone")), "updated": F.count_if(F.expr("NOT deleted AND NOT gone")), "deletes": F.count_if(F.expr("deleted AND NOT gone"))}
    return kinds.select(*key, "last", *[n.over(so_far).alias(c) for c, n in counts.items()]).where("last").drop("last")


def changes(log: DataFrame) -> DataFrame:
    """The change list: position and key, no values."""
    return log.select("seq", *KEY, "deleted")


def head(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0] or 0


def change_page(log: DataFrame, position: int, limit: int = CHANGES_MOST, schemas: list[str] | None = None) -> DataFrame:
    """The next changes after a position: first so many are examined, then filtered by schema, so a page may be empty and still advance."""
    rows = changes(log).where(F.col("seq") > position).orderBy("seq").limit(max(0, min(limit, CHANGES_MOST)))
    return rows.where(F.col("schema").isin(schemas)) if schemas is not None else rows


def page_state(log: DataFrame, position: int, limit: int = CHANGES_MOST, history: int = HISTORY) -> dict:
    """head, through (the position to ask from next) and gap (the position is older than the history kept, or past the head)."""
    top = head(log)
    gap = position > top or position < top - history
    if gap or position == top or limit <= 0:
        return {"head": top, "through": position, "gap": gap}
    seen = changes(log).where(F.col("seq") > position).orderBy("seq").limit(min(limit, CHANGES_MOST)).agg(F.count("*"), F.max("seq")).first()
    return {"head": top, "through": seen[1] if seen[0] == min(limit, CHANGES_MOST) else top, "gap": False}


def kept_history(log: DataFrame, history: int = HISTORY) -> DataFrame:
    """The changes that the bounded history still has."""
    top = log.agg(F.max("seq").alias("_head"))
    return changes(log).join(F.broadcast(top), F.col("seq") > F.col("_head") - history).drop("_head")


# expiry ---------------------------------------------------------------------------------------------------------------


def written_seconds(nanos: Column) -> Column:
    return F.floor(nanos / F.lit(NANOS)).cast("long")


def write_age(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    """When each key was last written, and at which seq."""
    return log.groupBy(*key).agg(F.max("written_nanos").alias("written_nanos"), F.max("seq").alias("seq"))


def expired_by_write(records: DataFrame, cutoff: int) -> DataFrame:
    """Hash layout: records last written before the cutoff, in Unix seconds. A rewrite makes a record young again."""
    return records.where(F.expr(f"written_nanos div {NANOS}") < cutoff)


def expired_by_range(records: DataFrame, cutoff: int) -> DataFrame:
    """Hash and range layout: records whose range begins with 20 digits of Unix seconds before the cutoff."""
    return records.where(F.col("range_enc").rlike("^[0-9]{20}") & (F.substring("range_enc", 1, 20) < f"{cutoff:020d}"))


def in_scope(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """Records of the hashes that a policy covers: those it lists and those registered by later writes."""
    return records.join(hashes.select("hash").distinct(), "hash", "left_semi")


def sweep(log: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Keys that expire now, by the policy of their schema (schema, layout, ttl_seconds), each with the revision it had when judged.

    Latest rows are judged, not old versions; policies are one row a schema, broadcast while Spark sees that they are few.
    """
    judged = snapshot(log).join(policies, "schema")
    cutoff = F.lit(now) - F.col("ttl_seconds")
    by_write = (F.col("layout") == "Hash") & (F.expr(f"written_nanos div {NANOS}") < cutoff)
    by_range = (F.col("layout") == "HashRange") & F.col("range_enc").rlike("^[0-9]{20}") & (F.substring("range_enc", 1, 20).try_cast("decimal(20,0)") < cutoff)
    return judged.where(by_write | by_range).select(*KEY, "seq")


def still_expired(swept: DataFrame, log: DataFrame) -> DataFrame:
    """Of swept keys those not written since: the latest row must be the one that was judged."""
    now = latest(log).select(*KEY, F.col("seq").alias("_seq"))
    return swept.join(now, KEY).where("seq = _seq").drop("_seq")
