"""Conditional write batches: judged as a whole against the live snapshot, then turned into log rows or refused.

A batch is a DataFrame of `index` (0, 1, 2, ...), `op` (create, replace, delete), `schema`, `hash`, `range_enc` (null is empty),
`revision` (the one expected), `record` (JSON), and optional `range`, `alternates`, `file` and `clear_file`. Everything is one join of the
batch with the snapshot by key; nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.functions.codec import revision
from keylake.functions.types import faults
from keylake.operators.log import KEY
from keylake.plans.catalog import Catalog

RECORD_BYTES = 64 * 1024
#: In the order of checks: shape of the batch first, then conditions on what is stored, then size.
REASONS = ("repeated", "shape", "schema", "exists", "absent", "revision", "field", "file", "size")


class WriteRefused(ValueError):
    """A batch that was not written; nothing of it was."""

    def __init__(self, index: int, reason: str):
        super().__init__(f"item {index}: {reason}")
        self.index, self.reason = index, reason


def preimages(batch: DataFrame, live: DataFrame) -> DataFrame:
    """The batch with each key's live row as `before` (null if there is none)."""
    found = live.select(*KEY, F.struct(*live.columns).alias("before"))
    return batch.join(found, KEY, "left")


def _by_schema(catalog: Catalog, batch: DataFrame, columns: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Shape, schema and contents faults of items by the definitions of the schemas that the batch names (few, as a catalog is small)."""
    named = [r[0] for r in batch.select("schema").distinct().limit(len(catalog.by_name) + 1).collect()]
    known = [d for n in named if (d := catalog.by_name.get(n)) and not d.blocked]
    shape, contents = F.lit(False), F.lit(None).cast("string")
    for d in known:
        mine, stays = F.col("schema") == d.name, F.col("op") != "delete"
        shape |= mine & (columns["has_range"] != F.lit(d.primary.kind == "hash_range"))
        wrong = F.when(F.size(faults(F.coalesce("record", F.lit("{}")), d.types())) > 0, "field")
        if d.file_required:
            wrong = F.coalesce(wrong, F.when(columns["file"].isNull(), "file"))
        contents = F.when(mine & stays, wrong).otherwise(contents)
    return shape, ~F.col("schema").isin([d.name for d in known]) if known else F.lit(True), contents


def _file(columns: list[str]) -> Column:
    """The file marker that an item leaves: its own, or the one before it unless cleared."""
    before = F.when(F.col("before").isNotNull(), F.col("before.file"))
    if "file" not in columns:
        return before
    return F.when(F.col("clear_file"), None).otherwise(F.coalesce("file", before)) if "clear_file" in columns else F.coalesce("file", before)


def judged(batch: DataFrame, live: DataFrame, hash_range: bool | None = None, catalog: Catalog | None = None) -> DataFrame:
    """The batch with `before` and `reason`: why an item must be refused, null if it may go.

    A null range_enc is an empty one. With a catalog, schemas must be declared and open, layouts and fields must fit them.
    """
    batch = batch.withColumn("range_enc", F.coalesce("range_enc", F.lit("")))
    x = preimages(batch, live).withColumn("_times", F.count("*").over(Window.partitionBy(*KEY)))
    before, op = F.col("before"), F.col("op")
    shape = (F.coalesce(F.col("hash"), F.lit("")) == "") | ~op.isin("create", "replace", "delete") | F.when(op == "create", F.col("revision").isNotNull()).otherwise(F.col("revision").isNull())
    has_range = F.col("range_enc") != ""
    if hash_range is not None:
        shape |= ~has_range if hash_range else has_range
    schema, contents = F.lit(False), F.lit(None).cast("string")
    if catalog is not None:
        layout, schema, contents = _by_schema(catalog, batch, {"has_range": has_range, "file": _file(batch.columns) if "file" in live.columns else F.lit(None)})
        shape |= layout
    reason = (
        F.when(F.col("_times") > 1, "repeated")
        .when(shape, "shape")
        .when(schema, "schema")
        .when((op == "create") & before.isNotNull(), "exists")
        .when((op != "create") & before.isNull(), "absent")
        .when((op != "create") & (before["revision"] != F.col("revision")), "revision")
        .when(contents.isNotNull(), contents)
        .when((op != "delete") & (F.octet_length("record") > RECORD_BYTES), "size")
    )
    return x.withColumn("reason", reason).drop("_times")


def first_conflict(verdicts: DataFrame) -> DataFrame:
    """The refusal with the smallest index: index, reason; no row if the batch may go."""
    return verdicts.where("reason IS NOT NULL").agg(F.min(F.struct("index", "reason")).alias("_f")).where("_f IS NOT NULL").select("_f.index", "_f.reason")


def counts(verdicts: DataFrame) -> DataFrame:
    """What a batch would do: created, updated, deleted."""
    fine = verdicts.where("reason IS NULL")
    return fine.agg(F.count_if(F.expr("op = 'create'")).alias("created"), F.count_if(F.expr("op = 'replace'")).alias("updated"), F.count_if(F.expr("op = 'delete'")).alias("deleted"))


def authored_ms(now_ms: Column, floor_ms: Column) -> Column:
    """The stamp's time never falls behind the newest one written."""
    return F.greatest(now_ms, floor_ms)


def index_fault(verdicts: DataFrame) -> DataFrame:
    """index, reason of a batch whose index is not 0, 1, 2, ...; no row if it is."""
    seen = verdicts.agg(F.count("*").alias("n"), F.countDistinct("index").alias("k"), F.min("index").alias("a"), F.max("index").alias("b"))
    return seen.where("n > 0 AND (k <> n OR a <> 0 OR b <> n - 1)").select(F.col("b").alias("index"), F.lit("index").alias("reason"))


def log_rows(verdicts: DataFrame, head: int, ms: int, nanos: int, stream: str, writer: str) -> DataFrame:
    """The log rows of a batch that may go, numbered on from head in the order of the batch, with the batch's time in ms.

    Each record has a nanosecond of its own, rising from the one given. The creator of a record stays through replaces; the writer
    is the updater. A file marker stays unless the item brings or clears one (`file`, `clear_file`). Index numbers are
    dense, so numbering needs no global sort.
    """
    before, live = F.col("before"), F.col("before").isNotNull()
    seq = F.lit(head + 1) + F.col("index")
    columns = {
        "seq": seq.cast("long"),
        "deleted": F.col("op") == "delete",
        "revision": revision(F.lit(ms).cast("long"), F.lit(stream), seq),
        "authored_ms": F.lit(ms).cast("long"),
        "created_by": F.when(live, before["created_by"]).otherwise(writer),
        "updated_by": F.lit(writer),
        "written_nanos": (F.lit(nanos) + F.col("index")).cast("long"),
    }
    if "file" in verdicts.schema["before"].dataType.names:
        columns["file"] = F.when(F.col("op") != "delete", _file(verdicts.columns))
    kept = [c for c in verdicts.columns if c not in (*columns, "before", "reason", "index", "op", "clear_file")]
    return verdicts.select(*kept, *[e.alias(c) for c, e in columns.items()])


def undone(live: DataFrame, head: int, ms: int, nanos: int, stream: str, writer: str, verb: str) -> DataFrame:
    """Tombstones of live rows, which have an `index` (0, 1, 2, ...); the verb says why."""
    seq = F.lit(head + 1) + F.col("index")
    own = {"seq": seq.cast("long"), "deleted": F.lit(True), "revision": revision(F.lit(ms).cast("long"), F.lit(stream), seq), "authored_ms": F.lit(ms).cast("long"), "updated_by": F.lit(writer), "written_nanos": (F.lit(nanos) + F.col("index")).cast("long"), "verb": F.lit(verb)}
    return live.select(*KEY, "range", "created_by", *[e.alias(c) for c, e in own.items()])


def alternate_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an index must drop and add between two states of records (KEY, alternates)."""
    def spread(df: DataFrame, side: str) -> DataFrame:
        return df.select(*KEY, F.explode("alternates").alias("name", side))

    both = spread(before, "old").join(spread(after, "new"), [*KEY, "name"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    parts = {side: both.schema[side].dataType.names for side in ("old", "new")}
    return both.select(*KEY, "name", *[F.col(side)[c].alias(f"{side}_{c}") for side in parts for c in parts[side]])


def erase_audit(erased: DataFrame) -> DataFrame:
    """One ledger row per verb and caller: how many, the key's fingerprint if it was one, and since when if `at` is known."""
    one = F.sha2(F.concat_ws("\0", *KEY), 256)
    since = [F.min("at").alias("at")] if "at" in erased.columns else []
    return erased.groupBy("verb", "caller").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min(one)).alias("fingerprint"), *since)


def ledger_page(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Audit rows in time order, at most so many."""
    rows = ledger.orderBy("at", "verb", "caller")
    return rows if limit is None else rows.limit(limit)
