"""Signed multi-writer logs: chain checks, grants, authorisation and last-writer-wins, all as joins, windows and arg-max.

An entry has `database_id`, `node_key`, `device_id`, `writer_seq`, `prev_hash`, `lamport`, `seen_heads` (array of entry hashes), `kind`,
`stream` (direct or proposal), `namespace`, `payload`, `role`, `grantee` (null: anyone), `cutoffs` (array of device_id, writer_seq),
`grant_device`, `grant_seq`, `incorporated` (of a publisher: that it takes over a proposal), `entry_hash`, `signature_valid`
(verified where entries come in; signatures are not checked here), `arrival` (order of receipt). One database or stream may
hold most rows: only windows over one stream are sequential, everything else is keyed by entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.functions.codec import payload_key, payload_value
from keylake.sources.work import written

STREAM = ["database_id", "node_key", "device_id"]
POSITION = ["lamport", "node_key", "device_id"]
BUNDLE_CHANGES, BUNDLE_BYTES = 10_000, 64 << 20
#: Reasons that hold whatever else is missing, and those of entries that were never part of their stream.
HARD, BESIDE = ("signature", "equivocation", "frozen"), ("signature", "equivocation")
# fixed values: roles by rank, the lowest last in a tie of grants
RANK = {"write": 3, "submit": 2, "read": 1, "revoked": 0}


def rank(role: Column) -> Column:
    out = F.lit(None)
    for name, value in RANK.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def lww(entries: DataFrame, key: list[str] = ["namespace", "key"]) -> DataFrame:  # noqa: B006
    """Winner of each key: the entry with the greatest (lamport, node_key, device_id), whatever the order of arrival."""
    rest = [c for c in entries.columns if c not in key]
    best = entries.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*POSITION)).alias("_w"))
    return best.select(*key, *[F.col(f"_w.`{c}`").alias(c) for c in rest])


def content(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Accepted data entries that count as content, decoded: direct ones, and proposals that a publisher took over."""
    x = entries.where("kind = 'data'").join(owners.select("database_id", "owner"), "database_id", "left")
    x = x.where((F.col("stream") == "direct") | ((F.col("node_key") == F.col("owner")) & F.col("incorporated")))
    return x.withColumns({"key": payload_key(F.col("payload")), "value": payload_value(F.col("payload"))})


def materialize_plan(winners: DataFrame, live: DataFrame) -> DataFrame:
    """Writes that bring live records (namespace, key, value) to the winners: create, replace, delete; equal values need none.

    An empty value is a tombstone; live keys without a winner stay.
    """
    gone = F.col("value").isNull() | (F.octet_length("value") == 0)
    x = winners.select("namespace", "key", "value").join(live.select("namespace", "key", F.col("value").alias("now"), F.lit(True).alias("_live")), ["namespace", "key"], "left")
    op = F.when(gone & F.col("_live"), "delete").when(~gone & F.col("_live").isNull(), "create").when(~gone & ~F.col("value").eqNullSafe(F.col("now")), "replace")
    return x.withColumn("op", op).where("op IS NOT NULL").select("namespace", "key", "op", "value")


def stream_heads(entries: DataFrame) -> DataFrame:
    """The last entry of each stream."""
    return entries.groupBy(*STREAM).agg(F.max("writer_seq").alias("writer_seq"), F.max_by("entry_hash", "writer_seq").alias("entry_hash"), F.max_by("lamport", "writer_seq").alias("lamport"))


def equivocations(entries: DataFrame) -> DataFrame:
    """Places of a stream with more than one entry: the stream is frozen from there on."""
    return entries.groupBy(*STREAM, "writer_seq").agg(F.countDistinct("entry_hash").alias("entries"), F.min_by("entry_hash", "arrival").alias("held_hash")).where("entries > 1")


def chain_faults(entries: DataFrame) -> DataFrame:
    """Entries whose predecessor in the stream is missing (gap) or isn't the one they name (broken)."""
    before = Window.partitionBy(*STREAM).orderBy("writer_seq")
    x = entries.withColumns({"_seq": F.coalesce(F.lag("writer_seq").over(before), F.lit(0)), "_hash": F.coalesce(F.lag("entry_hash").over(before), F.lit(""))})
    fault = F.when(F.col("writer_seq") != F.col("_seq") + 1, "gap").when(F.coalesce("prev_hash", F.lit("")) != F.col("_hash"), "broken")
    return x.withColumn("fault", fault).where("fault IS NOT NULL").drop("_seq", "_hash")


def dependencies(entries: DataFrame) -> DataFrame:
    """A row per seen head: entry_hash and the head it names."""
    return entries.select("database_id", "entry_hash", F.explode("seen_heads").alias("head")).distinct()


def lamport_expected(entries: DataFrame) -> DataFrame:
    """Entries with the Lamport time they should have: 1 + the greatest of the predecessor's and the seen heads'."""
    known = entries.select("database_id", F.col("entry_hash").alias("head"), F.col("lamport").alias("_l")).dropDuplicates(["database_id", "head"])
    seen = dependencies(entries).join(known, ["database_id", "head"]).groupBy("database_id", "entry_hash").agg(F.max("_l").alias("_seen"))
    before = Window.partitionBy(*STREAM).orderBy("writer_seq")
    x = entries.withColumn("_before", F.coalesce(F.lag("lamport").over(before), F.lit(0))).join(seen, ["database_id", "entry_hash"], "left")
    return x.withColumn("expected", 1 + F.greatest("_before", F.coalesce("_seen", F.lit(0)))).drop("_before", "_seen")


# grants ---------------------------------------------------------------------------------------------------------------


def _grant_order() -> list[Column]:
    return [F.col("lamport"), F.col("node_key"), F.col("device_id"), -rank(F.col("role")), F.col("entry_hash")]


def roles(grants: DataFrame) -> DataFrame:
    """The role that a fold of all grants leaves each grantee: the last grant's, revoked last of equal ones."""
    return grants.groupBy("database_id", "grantee").agg(F.max_by("role", F.struct(*_grant_order())).alias("role"))


def reductions(grants: DataFrame) -> DataFrame:
    """Grants that lower a role the grantee had, or revoke it."""
    before = F.lag("role").over(Window.partitionBy("database_id", "grantee").orderBy(*_grant_order()))
    return grants.where("grantee IS NOT NULL").withColumn("_before", before).where(F.col("_before").isNotNull() & ((rank(F.col("role")) < rank(F.col("_before"))) | (F.col("role") == "revoked"))).drop("_before")


def cutoffs(grants: DataFrame) -> DataFrame:
    """Last entry that still counts of each device named by a reduction; other devices of a reduced grantee have none."""
    order = F.struct(*_grant_order())
    named = reductions(grants).select("database_id", F.col("grantee").alias("node_key"), order.alias("_o"), F.explode("cutoffs").alias("c"))
    return named.groupBy("database_id", "node_key", F.col("c.device_id").alias("device_id")).agg(F.max_by("c.writer_seq", "_o").alias("cutoff"))


def window_roles(entries: DataFrame, grants: DataFrame) -> DataFrame:
    """The role that the grants an entry has seen give its own writer: entry_hash, window_role."""
    names = grants.select("database_id", F.col("entry_hash").alias("head"), "grantee", F.struct(*_grant_order()).alias("_o"), F.col("role").alias("_role"))
    x = entries.select("database_id", "entry_hash", "node_key", F.explode("seen_heads").alias("head")).join(names, ["database_id", "head"])
    return x.where("grantee = node_key").groupBy("database_id", "entry_hash").agg(F.max_by("_role", "_o").alias("window_role"))


def owners(entries: DataFrame) -> DataFrame:
    """The owner of each database, by its birth entry."""
    return entries.where("kind = 'birth'").groupBy("database_id").agg(F.min_by("grantee", F.struct("lamport", "arrival")).alias("owner"))


def unauthorised(entries: DataFrame, own: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Entries that their writer had no right to write: entry_hash, why. Publishers may write all.

    Who publishes is asked once a writer, and only what others wrote goes into the joins. cut: may write the table of these writers.
    """
    publisher = F.col("node_key") == F.col("owner")
    writers = entries.select("database_id", "node_key").distinct().join(own, "database_id", "left")
    others = cut(writers.where(~F.coalesce(publisher, F.lit(False))).select(F.col("database_id").alias("_database"), F.col("node_key").alias("_node")))
    by_others = entries.join(others, F.col("database_id").eqNullSafe(F.col("_database")) & F.col("node_key").eqNullSafe(F.col("_node")), "left_semi")
    grants = entries.where("kind = 'grant'").join(own, "database_id").where(publisher)
    member = by_others.where(F.col("kind").isin("data", "bundle"))
    named = grants.select("database_id", F.col("entry_hash").alias("head"), F.col("device_id").alias("grant_device"), F.col("writer_seq").alias("grant_seq"))
    seen = member.select("database_id", "entry_hash", "grant_device", "grant_seq", F.explode("seen_heads").alias("head")).join(named, ["database_id", "head", "grant_device", "grant_seq"]).select("database_id", "entry_hash", F.lit(True).alias("_named")).distinct()
    reduced = reductions(grants).select("database_id", F.col("grantee").alias("node_key"), F.lit(0).alias("_none")).distinct()
    y = member.join(seen, ["database_id", "entry_hash"], "left").join(window_roles(member, grants), ["database_id", "entry_hash"], "left")
    y = y.join(cutoffs(grants), STREAM, "left").join(reduced, ["database_id", "node_key"], "left")
    direct = (F.col("kind") == "bundle") | (F.col("stream") == "direct")
    role = F.col("window_role")
    why = (
        F.when(direct & F.col("grant_seq").isNull(), "no grant named")
        .when(direct & F.col("_named").isNull(), "grant not seen")
        .when(direct & ~role.eqNullSafe("write"), "no write role")
        .when(~direct & F.col("grant_seq").isNotNull(), "proposal names a grant")
        .when(~direct & F.coalesce("incorporated", F.lit(False)), "proposal is incorporated")
        .when(~direct & ~F.coalesce(role.isin("submit", "write"), F.lit(False)), "no submit role")
        .when(F.col("writer_seq") > F.coalesce("cutoff", "_none"), "past the cutoff")
    )
    away = by_others.where(F.col("kind").isin("grant", "heads", "relays", "blob_delete")).select("database_id", "entry_hash", F.lit("publisher only").alias("why"))
    return y.select("database_id", "entry_hash", why.alias("why")).where("why IS NOT NULL").union(away)


def accept(entries: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every distinct entry with its outcome: accepted, pending (something it builds on is missing) or rejected, and the reason.

    What shows within a stream is found in one pass over the streams, which is written once. What hangs on other streams is then joined
    from narrow tables: the seen heads, the entries they name, faults, and stops. A stop is the place from which on a stream is
    pending; stops spread between streams over the seen heads alone, by one join a round, so rounds count hops between streams.
    cut: cuts the lineage of these tables; by default a table in the folder that driver and executors share.
    """
    cut = cut or (lambda df: written(df.sparkSession, df))
    e = entries.groupBy("entry_hash").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "entry_hash"]), "arrival").alias("_e")).select("entry_hash", "_e.*")
    e = cut(_within_streams(e))
    chained = F.col("reason").isNull() | (F.col("reason") == "frozen")
    # faults that hang on other streams
    deps = cut(e.where("database_id IS NOT NULL AND entry_hash IS NOT NULL").select(*STREAM, "entry_hash", "lamport", "reason", "_before", "_at", "_hard", F.explode("seen_heads").alias("head")))
    named = deps.select(F.col("database_id").alias("_database"), F.col("head").alias("_head")).distinct()
    heads = e.join(named, (F.col("database_id") == F.col("_database")) & (F.col("entry_hash") == F.col("_head")), "left_semi")
    heads = cut(heads.select("database_id", F.col("entry_hash").alias("head"), F.col("node_key").alias("h_node"), F.col("device_id").alias("h_device"), F.col("_at").alias("h_at"), F.when(chained, F.col("lamport")).alias("_l"), (F.col("reason").isNull() & ~F.col("_malformed") & ~F.col("_late") & ~F.col("_pending")).alias("_fine")))
    seen = deps.where(chained).join(heads.select("database_id", "head", "_l"), ["database_id", "head"], "left").groupBy("database_id", "entry_hash").agg(F.max("_l").alias("_seen"), F.first("lamport").alias("lamport"), F.first("_before").alias("_before"))
    late = seen.where(F.col("lamport") != 1 + F.greatest("_before", F.coalesce("_seen", F.lit(0)))).select("database_id", "entry_hash", F.lit("lamport").alias("_r"))
    barred = unauthorised(e.where(chained), cut(owners(e.where(chained))), cut).select("database_id", "entry_hash", F.lit("unauthorised").alias("_r"))
    found = cut(late.union(barred).groupBy("database_id", "entry_hash").agg(F.min("_r").alias("_r")))  # lamport goes before unauthorised
    faulty = e.join(found, ["database_id", "entry_hash"], "left_semi").select(*STREAM, (F.col("_at") + 1).alias("stop"))
    ill = found.select("database_id", F.col("entry_hash").alias("head"), F.lit(True).alias("_ill"))
    edges = deps.select(*STREAM, "head", (F.col("_at") + F.col("_hard").cast("long")).alias("stop")).join(heads.drop("_l"), ["database_id", "head"], "left").join(ill, ["database_id", "head"], "left")
    edges = cut(edges.select(*STREAM, "stop", "h_node", "h_device", "h_at", (F.coalesce("_fine", F.lit(False)) & F.col("_ill").isNull()).alias("_fine")))
    # stops, until none moves
    least = lambda rows: cut(rows.groupBy(*STREAM).agg(F.min("stop").alias("stop")))
    to = lambda stops, *names: (stops.select(*[F.col(c).alias(f"_{c}") for c in STREAM], F.col("stop").alias("_stop")), _same(names, [f"_{c}" for c in STREAM]), "left")
    stops = least(faulty)
    while True:
        waits = edges.join(*to(stops, "database_id", "h_node", "h_device")).where(~F.col("_fine") | F.coalesce(F.col("h_at") >= F.col("_stop"), F.lit(False)))
        after = least(faulty.union(waits.select(*STREAM, "stop")))
        moved = not after.join(*to(stops, *STREAM)).where("_stop IS NULL OR stop < _stop").isEmpty()
        stops = after
        if not moved:
            break
    e = e.join(found, ["database_id", "entry_hash"], "left").join(*to(stops, *STREAM))
    pending = F.col("_pending") | (~F.col("_hard") & F.coalesce(F.col("_at") >= F.col("_stop"), F.lit(False)))
    reason = F.coalesce("reason", F.when(F.col("_malformed"), "malformed"), F.when(F.col("_late"), "lamport"), "_r")
    outcome = F.when(pending, "pending").when(reason.isNotNull(), "rejected").otherwise("accepted")
    return e.select(*entries.columns, outcome.alias("outcome"), F.when(~pending, reason).alias("reason"))


def _same(a: Iterable[str], b: Iterable[str]) -> Column:
    return reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)])


def _within_streams(entries: DataFrame) -> DataFrame:
    """Distinct entries with all that shows within their streams, by one sort.

    reason (signature, equivocation, frozen, malformed by place), _malformed (broken link), _late (Lamport time of an entry without seen
    heads), _before (Lamport time before it), _at (its place), _hard (a reason that holds whatever else is missing), and _pending (behind a gap or a fault).
    """
    place, stream = Window.partitionBy(*STREAM, "writer_seq"), Window.partitionBy(*STREAM).orderBy("writer_seq")
    so_far, earlier = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow), stream.rowsBetween(Window.unboundedPreceding, -1)
    keyed = reduce(and_, [F.col(c).isNotNull() for c in (*STREAM, "writer_seq")])
    twice = keyed & (F.count("entry_hash").over(place) > 1)
    e = entries.repartition(*STREAM).withColumn("_held", F.when(twice, F.min_by("entry_hash", "arrival").over(place))).withColumn("_twice", twice)
    e = e.withColumn("_frozen", F.min(F.when(F.col("_twice"), F.col("writer_seq"))).over(so_far))
    e = e.withColumn("reason", F.when(~F.col("signature_valid"), "signature").when(F.col("_held").isNotNull() & (F.col("_held") != F.col("entry_hash")), "equivocation").when(F.col("writer_seq") > F.col("_frozen"), "frozen").when(F.col("writer_seq") < 1, "malformed"))
    beside, chained = F.coalesce(F.col("reason").isin(*BESIDE), F.lit(False)), F.col("reason").isNull() | (F.col("reason") == "frozen")
    last = lambda which, *names: F.last(F.when(which, F.struct(*names)), ignorenulls=True).over(earlier)
    e = e.withColumns({"_link": last(chained, "writer_seq", "entry_hash", "lamport"), "_step": last(~beside, "writer_seq")})
    named = F.col("database_id").isNotNull() & F.col("entry_hash").isNotNull()
    next_ = F.col("writer_seq") == F.coalesce("_link.writer_seq", F.lit(0)) + 1
    broken = chained & named & F.coalesce(next_, F.lit(True)) & (F.coalesce("prev_hash", F.lit("")) != F.coalesce("_link.entry_hash", F.lit("")))
    before = F.coalesce("_link.lamport", F.lit(0))
    late = chained & named & (F.coalesce(F.size("seen_heads"), F.lit(0)) < 1) & F.coalesce(F.col("lamport") != 1 + F.greatest(before, F.lit(0)), F.lit(False))
    gap = ~beside & F.coalesce(F.col("writer_seq") != F.coalesce("_step.writer_seq", F.lit(0)) + 1, F.lit(False))
    e = e.withColumns({"_malformed": broken, "_late": late, "_before": before, "_gap": gap, "_at": F.coalesce("writer_seq", F.lit(-(1 << 62))), "_hard": F.coalesce(F.col("reason").isin(*HARD), F.lit(False))})
    stuck = F.coalesce(F.max((F.col("reason").isNotNull() & ~beside) | F.col("_malformed") | F.col("_late") | F.col("_gap")).over(earlier), F.lit(False))
    e = e.withColumn("_pending", ~F.col("_hard") & (stuck | F.col("_gap")))
    return e.select(*entries.columns, "reason", "_malformed", "_late", "_before", "_at", "_hard", "_pending")


def unpacked(bundles: DataFrame) -> DataFrame:
    """Changes of bundle entries (array column `changes` of namespace, payload) as rows at the bundle's own position.

    Bundles out of order, with repeated keys or beyond the bounds give no rows.
    """
    names = F.transform("changes", lambda c: F.struct(c["namespace"], payload_key(c["payload"])))
    size = F.aggregate("changes", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["payload"]))
    ok = (F.size("changes") <= BUNDLE_CHANGES) & (size <= BUNDLE_BYTES) & (F.array_sort(names) == names) & (F.size(F.array_distinct(names)) == F.size(names))
    return bundles.where(ok).select(*[c for c in bundles.columns if c not in ("changes", "namespace", "payload")], F.explode("changes").alias("c")).select("*", "c.*").drop("c")


def outbox(queued: DataFrame, acked: DataFrame) -> DataFrame:
    """Entries still to be sent, first in first out: queued once however often, and not acknowledged."""
    once = queued.groupBy("entry_hash").agg(F.min("queued_at").alias("queued_at"))
    return once.join(acked, "entry_hash", "left_anti")


def gated(requests: DataFrame, granted: DataFrame, own: DataFrame) -> DataFrame:
    """Requests (database_id, node_key, wants) with `allowed`, by the caller's folded role.

    wants: read (any role, or anyone where reading is open), append_proposal (submit or write), append or blob_put (write),
    publish (grants and the like: the owner alone).
    """
    x = requests.join(own, "database_id", "left").join(granted.select("database_id", F.col("grantee").alias("node_key"), "role"), ["database_id", "node_key"], "left")
    any_ = granted.where("grantee IS NULL AND role = 'read'").select("database_id", F.lit(1).alias("_any")).distinct()
    power = F.when(F.col("node_key") == F.col("owner"), 4).otherwise(F.coalesce(rank(F.col("role")), F.lit(0)))
    x = x.join(any_, "database_id", "left")
    allowed = F.when(F.col("wants") == "read", (power >= 1) | F.col("_any").isNotNull()).when(F.col("wants") == "append_proposal", power >= 2).when(F.col("wants").isin("append", "blob_put"), power >= 3).otherwise(power >= 4)
    return x.withColumn("allowed", allowed).drop("_any")


def append_page(page: DataFrame, held: DataFrame) -> DataFrame:
    """A page for a relay (STREAM, writer_seq, entry_hash): each row new, duplicate (held already) or conflict (another entry is held there)."""
    have = held.select(*STREAM, "writer_seq", F.col("entry_hash").alias("_held"))
    x = page.join(have, [*STREAM, "writer_seq"], "left")
    return x.withColumn("outcome", F.when(F.col("_held").isNull(), "new").when(F.col("_held") == F.col("entry_hash"), "duplicate").otherwise("conflict")).drop("_held")
