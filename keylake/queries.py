"""Queries of the keyed-record operators over the test tables, by name, each with the SQL it must agree with.

Tables are viewed as records: orders by customer (hash o_custkey, range o_orderkey), events as a log (seq event_id), line items
as an upsert log, conversations as turns. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.functions import codec
from keylake.operators import advice, log, read, report, sync, write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ENC = "lower(lpad(to_hex((CAST({} AS HUGEINT) + 9223372036854775808)::UBIGINT), 16, '0'))"
NOON = 1_000_000_000


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, its times (stored without a zone) taken as UTC, the session's zone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: hash and integer range."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("hash"), F.col("o_orderkey").cast("string").alias("range"), codec.encode_integer(F.col("o_orderkey")).alias("range_enc"), "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")


ORDERS = f"SELECT CAST(o_custkey AS VARCHAR) AS hash, CAST(o_orderkey AS VARCHAR) AS range, {ENC.format('o_orderkey')} AS range_enc, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate FROM orders"


#: The order of a line item's versions.
SHIPPED = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a log: later ship dates overwrite, returned rows are tombstones. seq follows the row's own values."""
    li = table(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*SHIPPED)
    return li.select(F.lit("lineitem").alias("schema"), F.col("l_orderkey").cast("string").alias("hash"), codec.encode_integer(F.col("l_linenumber")).alias("range_enc"), F.row_number().over(first).cast("long").alias("seq"), (F.col("l_returnflag") == "R").alias("deleted"), "l_partkey", "l_quantity", "l_shipdate")


UPSERTS = f"""SELECT 'lineitem' AS schema, CAST(l_orderkey AS VARCHAR) AS hash, {ENC.format('l_linenumber')} AS range_enc,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
  l_returnflag = 'R' AS deleted, l_partkey, l_quantity, l_shipdate FROM lineitem"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: schema event_type, hash user_id, range the time; errors of odd users are tombstones."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("schema"), F.col("user_id").cast("string").alias("hash"), codec.encode_timestamp(F.col("ts")).alias("range_enc"), (F.col("user_id") % 7 == 0).alias("deleted"), (F.unix_micros("ts") * 1000).alias("written_nanos"), "value", "ts", "props")


NANOS = "lower(lpad(to_hex((CAST(epoch_us({}) AS HUGEINT) + 62167219200000000) * 1000), 18, '0'))"
EVENT_LOG = f"""SELECT event_id + 1 AS seq, event_type AS schema, CAST(user_id AS VARCHAR) AS hash, {NANOS.format('ts')} AS range_enc, user_id % 7 = 0 AS deleted,
  epoch_us(ts) * 1000 AS written_nanos, value, ts, props FROM events"""

# reads ----------------------------------------------------------------------------------------------------------------
SHOWN = ["hash", "range", "o_orderstatus", "o_totalprice"]


@query(f"SELECT hash, range, o_orderstatus, o_totalprice FROM ({ORDERS}) WHERE hash = '7' AND range_enc = (SELECT min(range_enc) FROM ({ORDERS}) WHERE hash = '7')")
def point_read(spark, sf_dir):
    rows = orders(spark, sf_dir)
    first = rows.where("hash = '7'").agg(F.min("range_enc")).first()[0] or ""
    return read.select(rows, read.Filter(hash="7", range=first), "Integer").select(*SHOWN)


@query(f"SELECT hash, range, o_orderstatus, o_totalprice FROM ({ORDERS}) WHERE (hash, range_enc) IN (SELECT CAST(o_custkey AS VARCHAR), {ENC.format('o_orderkey')} FROM orders WHERE o_totalprice > 300000)")
def multi_key_read(spark, sf_dir):
    rows = orders(spark, sf_dir)
    keys = rows.where("o_totalprice > 300000").select("hash", "range_enc")
    return read.by_keys(rows, keys.union(keys)).select(*SHOWN)


@query(f"SELECT hash, range, o_orderstatus, o_totalprice FROM ({ORDERS}) WHERE hash = '11'")
def partition_scan(spark, sf_dir):
    return read.select(orders(spark, sf_dir), read.Filter(hash="11")).select(*SHOWN)


@query(f"SELECT hash, range, o_orderstatus, o_totalprice FROM ({ORDERS}) WHERE range_enc >= {ENC.format(1000)} AND range_enc < {ENC.format(9000)}")
def range_scan(spark, sf_dir):
    lo, hi = (f"{v ^ 1 << 63:016x}" for v in (1000, 9000))
    return read.select(orders(spark, sf_dir), read.Filter(start=lo, end=hi), "Integer").select(*SHOWN)


@query("SELECT p_brand AS hash, p_name AS range, p_partkey FROM part WHERE starts_with(p_name, 'red w')")
def prefix_scan(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("hash"), F.col("p_name").alias("range"), F.col("p_name").alias("range_enc"), "p_partkey")
    return read.select(parts, read.Filter(prefix="red w")).select("hash", "range", "p_partkey")


@query(f"SELECT hash, range FROM ({ORDERS}) WHERE o_orderstatus = 'O'")
def keys_only(spark, sf_dir):
    return read.keys_only(orders(spark, sf_dir).where("o_orderstatus = 'O'"))


@query(f"SELECT hash, range FROM ({ORDERS}) ORDER BY hash, range_enc LIMIT 100")
def key_listing_page(spark, sf_dir):
    return read.key_page(orders(spark, sf_dir))


@query(f"SELECT hash, range FROM ({ORDERS}) WHERE range_enc > {ENC.format(500)} OR (range_enc = {ENC.format(500)} AND hash > '5') ORDER BY range_enc, hash LIMIT 50")
def page_after_cursor(spark, sf_dir):
    return read.page(orders(spark, sf_dir), 50, cursor=("5", f"{500 ^ 1 << 63:016x}")).select("hash", "range")


@query(f"SELECT hash, range FROM ({ORDERS}) ORDER BY range_enc DESC, hash LIMIT 50")
def desc_page(spark, sf_dir):
    return read.page(orders(spark, sf_dir), 50, descending=True).select("hash", "range")


@query(f"SELECT hash, range FROM ({ORDERS}) ORDER BY range_enc, hash LIMIT 30 OFFSET 70")
def offset_page(spark, sf_dir):
    return read.page(orders(spark, sf_dir), 30, offset=70).select("hash", "range")


def with_alternate(rows: DataFrame) -> DataFrame:
    alt = F.struct(F.col("o_orderpriority").alias("hash"), codec.encode_timestamp(F.col("o_orderdate")).alias("range_enc"))
    return rows.withColumn("alternates", F.create_map(F.lit("by_priority"), F.when(F.col("o_orderstatus") != "P", alt)))


@query(f"SELECT o_orderpriority AS alt_hash, {NANOS.format('o_orderdate')} AS alt_range_enc, hash, range FROM ({ORDERS}) WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
def alternate_scan(spark, sf_dir):
    rows = with_alternate(orders(spark, sf_dir))
    return read.by_alternate(read.alternate_index(rows, "by_priority"), rows, read.Filter(hash="1-URGENT")).select("alt_hash", "alt_range_enc", "hash", "range")


@query(f"SELECT o_orderpriority AS alt_hash, count(*) AS n FROM ({ORDERS}) WHERE o_orderstatus <> 'P' GROUP BY 1")
def alternate_count(spark, sf_dir):
    return read.alternate_index(with_alternate(orders(spark, sf_dir)), "by_priority").groupBy("alt_hash").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderpriority AS alt_hash, {NANOS.format('o_orderdate')} AS alt_range_enc, hash, range_enc, CASE WHEN range_enc < {ENC.format(1000)} THEN 'missing' END AS fault FROM ({ORDERS}) WHERE o_orderstatus <> 'P' AND range_enc < {ENC.format(1000)}")
def index_integrity(spark, sf_dir):
    rows = with_alternate(orders(spark, sf_dir))
    index = read.alternate_index(rows, "by_priority").where(F.col("range_enc") >= f"{1000 ^ 1 << 63:016x}")
    return read.index_faults(index, rows, "by_priority")


@query("SELECT CAST(c_custkey AS VARCHAR) AS hash FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def absent_targets(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("hash"), F.lit("").alias("range_enc"))
    return read.absent_keys(asked, orders(spark, sf_dir).where("o_totalprice > 400000").withColumn("range_enc", F.lit(""))).select("hash")


@query("SELECT c_custkey AS item, c_mktsegment AS schema FROM customer WHERE (c_nationkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR c_nationkey = 1")
def granted_items(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("string").alias("caller"), F.col("c_mktsegment").alias("schema"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    some = n.where("k % 2 = 0").select(F.col("k").cast("string").alias("caller"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("schema"))
    grants = some.union(n.where("k = 1").select(F.col("k").cast("string"), F.lit("*"))).withColumn("access", F.lit("read"))
    return read.granted(c, grants, "read").select("item", "schema")


# codecs ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT l_orderkey AS k, {ENC.format('l_orderkey - 3000')} AS enc, l_orderkey - 3000 AS back FROM lineitem")
def encode_integer_range(spark, sf_dir):
    v = F.col("l_orderkey") - 3000
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), codec.encode_integer(v).alias("enc"), codec.decode_integer(codec.encode_integer(v)).alias("back"))


@query("SELECT o_orderkey, lower(lpad(to_hex(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528), 6, '0')) AS enc, CAST(o_orderdate AS DATE) AS back FROM orders")
def encode_date_range(spark, sf_dir):
    enc = codec.encode_date(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", enc.alias("enc"), codec.decode_date(enc).alias("back"))


@query(f"SELECT event_id, {NANOS.format('ts')} AS enc, {NANOS.format('ts')} AS text_enc FROM events")
def encode_datetime_range(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", codec.encode_timestamp(F.col("ts")).alias("enc"), codec.encode_datetime(text).alias("text_enc"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS enc FROM orders")
def encode_boolean(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.encode_boolean(F.col("o_orderstatus") == "F").alias("enc"))


@query("SELECT event_id, sha256(unhex(hex('record-revision-v2') || '00' || lpad(to_hex(epoch_us(ts) // 1000), 16, '0') || hex(event_type) || lpad(to_hex(event_id), 16, '0'))) AS revision FROM events")
def revision_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", codec.revision(F.unix_millis("ts"), F.col("event_type"), F.col("event_id")).alias("revision"))


@query("SELECT doc_id, source AS key, hex(encode(text)) AS value FROM documents")
def payload_round_trip(spark, sf_dir):
    payload = codec.encode_payload(F.col("source"), F.encode("text", "utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", codec.payload_key(payload).alias("key"), F.hex(codec.payload_value(payload)).alias("value"))


@query("SELECT c_custkey, true AS same, strlen(c_name) AS size FROM customer")
def segment_escaping(spark, sf_dir):
    raw = F.concat("c_name", F.lit("\x00\x01"), "c_mktsegment", F.lit("\x01"))
    esc = codec.escape_segment(raw)
    same = (codec.unescape_segment(esc) == raw) & ~F.contains(esc, F.lit("\x00"))
    return table(spark, sf_dir, "customer").select("c_custkey", same.alias("same"), F.octet_length("c_name").cast("long").alias("size"))


# log ------------------------------------------------------------------------------------------------------------------
KEYED = "schema, hash, range_enc"


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY seq DESC) AS rn FROM ({UPSERTS})) WHERE rn = 1 AND NOT deleted")
def live_snapshot(spark, sf_dir):
    return log.snapshot(upserts(spark, sf_dir))


@query(f"SELECT schema, hash, range_enc, seq FROM (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY seq DESC) AS rn FROM ({UPSERTS})) WHERE rn = 1 AND deleted")
def tombstones(spark, sf_dir):
    return log.tombstones(upserts(spark, sf_dir)).select("schema", "hash", "range_enc", "seq")


@query(f"""SELECT {KEYED}, count(*) AS versions, count(*) FILTER (NOT deleted AND gone) AS created, count(*) FILTER (NOT deleted AND NOT gone) AS updated, count(*) FILTER (deleted AND NOT gone) AS deletes
FROM (SELECT *, coalesce(lag(deleted) OVER (PARTITION BY {KEYED} ORDER BY seq), true) AS gone FROM ({UPSERTS})) GROUP BY {KEYED}""")
def version_counts(spark, sf_dir):
    """The versions of `upserts`, counted by the columns that its seq and its keys are made of: these are narrower, and sorted once."""
    li = table(spark, sf_dir, "lineitem").withColumn("deleted", F.col("l_returnflag") == "R")
    counts = log.version_counts(li, ["l_orderkey", "l_linenumber"], SHIPPED)
    return counts.select(F.lit("lineitem").alias("schema"), F.col("l_orderkey").cast("string").alias("hash"), codec.encode_integer(F.col("l_linenumber")).alias("range_enc"), "versions", "created", "updated", "deletes")


@query(f"""WITH u AS ({UPSERTS}), x AS (SELECT *, CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS layer FROM u)
SELECT {KEYED}, seq, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY layer DESC, seq DESC) AS rn FROM x) WHERE rn = 1 AND NOT deleted""")
def overlay_merge(spark, sf_dir):
    u = upserts(spark, sf_dir)
    return log.overlay(u.where("l_quantity <= 40"), u.where("l_quantity > 40")).select("schema", "hash", "range_enc", "seq", "l_partkey", "l_quantity")


@query(f"SELECT seq, {KEYED}, deleted FROM ({EVENT_LOG}) WHERE seq > 123 ORDER BY seq LIMIT 500")
def changes_page(spark, sf_dir):
    return log.change_page(event_log(spark, sf_dir), 123)


@query(f"SELECT * FROM (SELECT seq, {KEYED}, deleted FROM ({EVENT_LOG}) WHERE seq > 123 ORDER BY seq LIMIT 500) WHERE schema = 'click'")
def changes_filtered_page(spark, sf_dir):
    return log.change_page(event_log(spark, sf_dir), 123, schemas=["click"])


@query(f"SELECT seq, {KEYED}, deleted FROM ({EVENT_LOG}) WHERE seq > (SELECT max(seq) FROM ({EVENT_LOG})) - 700")
def changes_kept(spark, sf_dir):
    return log.kept_history(event_log(spark, sf_dir), 700)


@query("SELECT max(event_id) + 1 AS head, max(event_id) + 1 + 5 AS asked, true AS gap FROM events")
def changes_gap(spark, sf_dir):
    e = event_log(spark, sf_dir)
    top = log.head(e)
    state = log.page_state(e, top + 5)
    return spark.createDataFrame([(state["head"], top + 5, state["gap"])], "head long, asked long, gap boolean")


# writes ---------------------------------------------------------------------------------------------------------------
def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items with quantity over 25 are live, and each order's line items are a batch against them."""
    li = log.snapshot(upserts(spark, sf_dir)).withColumn("revision", F.sha2(F.concat_ws("|", "hash", "range_enc", "seq"), 256))
    live = li.where("l_quantity > 25")
    op = F.when(F.col("l_partkey") % 3 == 0, "create").when(F.col("l_partkey") % 3 == 1, "replace").otherwise("delete")
    rev = F.when(op == "create", None).otherwise(F.when(F.col("l_partkey") % 5 == 0, "stale").otherwise(F.col("revision")))
    items = li.select((F.col("hash").cast("long") * 8 + F.expr("conv(right(range_enc, 2), 16, 10)").cast("long")).alias("index"), op.alias("op"), "schema", "hash", "range_enc", rev.alias("revision"), F.concat(F.lit('{"part":'), F.col("l_partkey"), F.lit("}")).alias("record"))
    return items, live


BATCH = f"""snap AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY seq DESC) AS rn FROM ({UPSERTS})) WHERE rn = 1 AND NOT deleted),
judged AS (SELECT CAST(hash AS BIGINT) * 8 + CAST(('0x' || right(range_enc, 2)) AS BIGINT) AS index,
  CASE l_partkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'replace' ELSE 'delete' END AS op, l_quantity > 25 AS live,
  CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'exists' END WHEN NOT l_quantity > 25 THEN 'absent' WHEN l_partkey % 5 = 0 THEN 'revision' END AS reason FROM snap)"""


@query(f"WITH {BATCH} SELECT index, op, reason FROM judged WHERE op = 'create' AND reason IS NOT NULL")
def cas_create_conflicts(spark, sf_dir):
    items, live = batch(spark, sf_dir)
    return write.judged(items, live).where("op = 'create' AND reason IS NOT NULL").select("index", "op", "reason")


@query(f"WITH {BATCH} SELECT index, op, reason FROM judged WHERE op <> 'create'")
def cas_replace_outcome(spark, sf_dir):
    items, live = batch(spark, sf_dir)
    return write.judged(items, live).where("op <> 'create'").select("index", "op", "reason")


@query(f"WITH {BATCH} SELECT index, reason FROM judged WHERE reason IS NOT NULL ORDER BY index LIMIT 1")
def first_conflict(spark, sf_dir):
    items, live = batch(spark, sf_dir)
    return write.first_conflict(write.judged(items, live))


@query(f"WITH {BATCH} SELECT count(*) FILTER (op = 'create') AS created, count(*) FILTER (op = 'replace') AS updated, count(*) FILTER (op = 'delete') AS deleted FROM judged WHERE reason IS NULL")
def commit_counts(spark, sf_dir):
    items, live = batch(spark, sf_dir)
    return write.counts(write.judged(items, live))


@query("""SELECT 'orders' AS schema, CAST(o_orderkey AS VARCHAR) AS hash, '' AS range_enc, 'by_customer' AS name, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS old_hash,
CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) END AS new_hash FROM orders
WHERE (o_orderkey % 10 <> 0 OR o_orderkey % 11 <> 0) AND (CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END) IS DISTINCT FROM (CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END END)""")
def alternate_index_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = lambda rows, cust: rows.select(F.lit("orders").alias("schema"), F.col("o_orderkey").cast("string").alias("hash"), F.lit("").alias("range_enc"), F.create_map(F.lit("by_customer"), F.struct(cust.cast("string").alias("hash"))).alias("alternates"))
    moved = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return write.alternate_changes(at(o.where("o_orderkey % 10 <> 0"), F.col("o_custkey")), at(o.where("o_orderkey % 11 <> 0"), moved))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'purge' ELSE 'delete' END AS verb, CAST(l_suppkey AS VARCHAR) AS caller, count(*) AS n, CASE WHEN count(*) = 1 THEN min(sha256('lineitem' || chr(0) || CAST(l_orderkey AS VARCHAR) || chr(0) || CAST(l_linenumber AS VARCHAR))) END AS fingerprint FROM lineitem GROUP BY 1, 2")
def erase_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return write.erase_audit(li.select(F.when(F.col("l_returnflag") == "R", "purge").otherwise("delete").alias("verb"), F.col("l_suppkey").cast("string").alias("caller"), F.lit("lineitem").alias("schema"), F.col("l_orderkey").cast("string").alias("hash"), F.col("l_linenumber").cast("string").alias("range_enc")))


# expiry ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT seq, schema, hash FROM ({EVENT_LOG}) WHERE written_nanos // {NOON} < (SELECT epoch_us(max(ts)) // 1000000 - 86400 FROM events)")
def ttl_hash_expired(spark, sf_dir):
    e = event_log(spark, sf_dir)
    now = e.agg(F.max(F.unix_seconds("ts"))).first()[0] or 0
    return log.expired_by_write(e, now - 86400).select("seq", "schema", "hash")


@query("SELECT event_id FROM events WHERE event_id % 9 <> 0 AND epoch_us(ts) // 1000000 < (SELECT epoch_us(max(ts)) // 1000000 - 86400 FROM events)")
def ttl_range_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max(F.unix_seconds("ts"))).first()[0] or 0
    aged = F.concat(F.lpad(F.unix_seconds("ts").cast("string"), 20, "0"), F.lit("/"), "event_type")
    rows = e.select("event_id", F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(aged).alias("range_enc"))
    return log.expired_by_range(rows, now - 86400).select("event_id")


@query(f"""WITH e AS ({EVENT_LOG}), top AS (SELECT epoch_us(max(ts)) // 1000000 AS now FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY seq DESC) AS rn FROM e)
SELECT {KEYED}, seq FROM l, top WHERE rn = 1 AND NOT deleted AND written_nanos // {NOON} < now - (CASE schema WHEN 'click' THEN 3600 ELSE 172800 END) AND schema IN ('click', 'view')""")
def ttl_sweep(spark, sf_dir):
    e = event_log(spark, sf_dir)
    now = e.agg(F.max(F.unix_seconds("ts"))).first()[0] or 0
    policies = spark.createDataFrame([("click", "Hash", 3600), ("view", "Hash", 172800)], "schema string, layout string, ttl_seconds long")
    return log.still_expired(log.sweep(e, policies, now), e)


# convergence ----------------------------------------------------------------------------------------------------------
def lww_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("namespace"), F.col("l_linenumber").cast("string").alias("key"), F.datediff("l_shipdate", F.lit("1970-01-01")).alias("lamport"), F.col("l_suppkey").alias("node_key"), F.col("l_partkey").alias("device_id"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus")).alias("value"))


LWW = """e AS (SELECT CAST(l_orderkey AS VARCHAR) AS namespace, CAST(l_linenumber AS VARCHAR) AS key, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS lamport, l_suppkey AS node_key, l_partkey AS device_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END AS value FROM lineitem),
w AS (SELECT namespace, key, CAST(lamport AS INTEGER) AS lamport, node_key, device_id, max(value) AS value FROM (SELECT *, rank() OVER (PARTITION BY namespace, key ORDER BY lamport DESC, node_key DESC, device_id DESC) AS r FROM e) WHERE r = 1 GROUP BY ALL)"""


@query(f"WITH {LWW} SELECT namespace, key, lamport, node_key, device_id FROM w")
def lww_winners(spark, sf_dir):
    return sync.lww(lww_entries(spark, sf_dir)).select("namespace", "key", "lamport", "node_key", "device_id")


@query("""WITH w AS (SELECT CAST(c_nationkey AS VARCHAR) AS namespace, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS value, c_custkey FROM customer),
l AS (SELECT CAST(c_nationkey AS VARCHAR) AS namespace, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'OLD' ELSE c_mktsegment END AS now FROM customer WHERE c_custkey % 2 = 0)
SELECT namespace, key, CASE WHEN value = '' THEN 'delete' WHEN now IS NULL THEN 'create' ELSE 'replace' END AS op FROM w LEFT JOIN l USING (namespace, key) WHERE (value = '' AND now IS NOT NULL) OR (value <> '' AND value IS DISTINCT FROM now)""")
def lww_materialize_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("namespace"), F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", "c_custkey")
    winners = c.withColumn("value", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")))
    live = c.where("c_custkey % 2 = 0").withColumn("value", F.when(F.col("c_custkey") % 3 == 0, "OLD").otherwise(F.col("c_mktsegment")))
    return sync.materialize_plan(winners, live).select("namespace", "key", "op")


def entry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signed entries: stream (user, type), hash chains in time order; every 50th entry names a wrong predecessor, every 97th is lost."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ident = lambda c: F.sha2(c.cast("string"), 256)
    before = F.when(F.col("event_id") % 50 == 0, F.lit("wrong")).otherwise(F.coalesce(ident(F.lag("event_id").over(w)), F.lit("")))
    rows = e.select((F.col("user_id") % 8).cast("string").alias("database_id"), F.col("user_id").cast("string").alias("node_key"), F.col("event_type").alias("device_id"), F.row_number().over(w).cast("long").alias("writer_seq"), ident(F.col("event_id")).alias("entry_hash"), before.alias("prev_hash"), F.row_number().over(w).cast("long").alias("lamport"), F.col("event_id").alias("arrival"))
    return rows.where("arrival % 97 <> 0")


ENTRY_LOG = """entries AS (SELECT * FROM (SELECT CAST(user_id % 8 AS VARCHAR) AS database_id, CAST(user_id AS VARCHAR) AS node_key, event_type AS device_id, row_number() OVER w AS writer_seq, sha256(CAST(event_id AS VARCHAR)) AS entry_hash,
CASE WHEN event_id % 50 = 0 THEN 'wrong' ELSE coalesce(sha256(CAST(lag(event_id) OVER w AS VARCHAR)), '') END AS prev_hash, event_id AS arrival FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE arrival % 97 <> 0)"""


@query(f"""WITH {ENTRY_LOG} SELECT database_id, node_key, device_id, writer_seq, CASE WHEN writer_seq <> s + 1 THEN 'gap' ELSE 'broken' END AS fault FROM
(SELECT *, coalesce(lag(writer_seq) OVER v, 0) AS s, coalesce(lag(entry_hash) OVER v, '') AS h FROM entries WINDOW v AS (PARTITION BY database_id, node_key, device_id ORDER BY writer_seq)) WHERE writer_seq <> s + 1 OR prev_hash <> h""")
def chain_gaps(spark, sf_dir):
    return sync.chain_faults(entry_log(spark, sf_dir)).select("database_id", "node_key", "device_id", "writer_seq", "fault")


@query(f"""WITH {ENTRY_LOG}, x AS (SELECT * FROM entries UNION ALL SELECT database_id, node_key, device_id, writer_seq, sha256(entry_hash), prev_hash, arrival + 1000000 FROM entries WHERE arrival % 31 = 0)
SELECT database_id, node_key, device_id, writer_seq, count(DISTINCT entry_hash) AS entries, arg_min(entry_hash, arrival) AS held_hash FROM x GROUP BY ALL HAVING count(DISTINCT entry_hash) > 1""")
def equivocations(spark, sf_dir):
    e = entry_log(spark, sf_dir)
    forged = e.where("arrival % 31 = 0").withColumns({"entry_hash": F.sha2("entry_hash", 256), "arrival": F.col("arrival") + 1000000})
    return sync.equivocations(e.union(forged))


@query(f"WITH {ENTRY_LOG} SELECT database_id, node_key, device_id, max(writer_seq) AS writer_seq, arg_max(entry_hash, writer_seq) AS entry_hash FROM entries GROUP BY ALL")
def stream_heads(spark, sf_dir):
    return sync.stream_heads(entry_log(spark, sf_dir)).drop("lamport")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as grants: to the customer, a role by priority, in order of date; odd orders cut off the clerk's device."""
    o = table(spark, sf_dir, "orders")
    role = F.element_at(F.array(*[F.lit(r) for r in ("write", "submit", "read", "revoked")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select((F.col("o_custkey") % 4).cast("string").alias("database_id"), F.col("o_custkey").cast("string").alias("grantee"), role.alias("role"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("lamport"), F.lit("owner").alias("node_key"), F.col("o_orderpriority").alias("device_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("entry_hash"), F.array(F.struct(F.col("o_orderstatus").alias("device_id"), F.col("o_orderkey").alias("writer_seq"))).alias("cutoffs"))


GRANTS = """g AS (SELECT CAST(o_custkey % 4 AS VARCHAR) AS database_id, CAST(o_custkey AS VARCHAR) AS grantee, ['write', 'submit', 'read', 'revoked'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS role, 3 - o_orderkey % 4 AS rank,
date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS lamport, o_orderpriority AS device_id, sha256(CAST(o_orderkey AS VARCHAR)) AS entry_hash, o_orderstatus, o_orderkey FROM orders)"""


@query(f"WITH {GRANTS} SELECT database_id, grantee, role FROM (SELECT *, row_number() OVER (PARTITION BY database_id, grantee ORDER BY lamport DESC, device_id DESC, rank, entry_hash DESC) AS rn FROM g) WHERE rn = 1")
def grant_fold_roles(spark, sf_dir):
    return sync.roles(grants(spark, sf_dir))


@query(f"""WITH {GRANTS}, b AS (SELECT *, lag(rank) OVER (PARTITION BY database_id, grantee ORDER BY lamport, device_id, rank DESC, entry_hash) AS p FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY database_id, grantee, o_orderstatus ORDER BY lamport DESC, device_id DESC, rank, entry_hash DESC) AS rn FROM b WHERE p IS NOT NULL AND (rank < p OR rank = 0))
SELECT database_id, grantee AS node_key, o_orderstatus AS device_id, o_orderkey AS cutoff FROM r WHERE rn = 1""")
def grant_cutoffs(spark, sf_dir):
    return sync.cutoffs(grants(spark, sf_dir))


# reports --------------------------------------------------------------------------------------------------------------
@query("SELECT source AS schema, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)")
def storage_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("schema"), "text")
    return report.storage(docs, F.octet_length("text"), total=True)


@query("""SELECT event_type AS route, CAST(user_id % 10 AS BIGINT) AS caller, count(*) AS requests, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total_nanos, max(CAST(round(value * 1000) AS BIGINT)) AS max_nanos, CAST(sum(event_id % 5) AS BIGINT) AS items,
count(*) FILTER (event_id % 20 = 0) AS refused_400, count(*) FILTER (event_id % 20 = 1) AS refused_409 FROM events GROUP BY ALL""")
def request_metrics(spark, sf_dir):
    code = F.when(F.col("event_id") % 20 == 0, "400").when(F.col("event_id") % 20 == 1, "409")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), (F.col("user_id") % 10).alias("caller"), F.round(F.col("value") * 1000).cast("long").alias("nanos"), (F.col("event_id") % 5).alias("items"), code.alias("code"))
    return report.request_metrics(rows, ["route", "caller"], ["400", "409"])


@query("""WITH f AS (SELECT user_id, min(event_id) AS m FROM events GROUP BY 1), k AS (SELECT user_id FROM f ORDER BY m, user_id LIMIT 64)
SELECT CASE WHEN user_id IN (SELECT user_id FROM k) THEN CAST(user_id AS VARCHAR) ELSE '{overflow}' END AS user_id, count(*) AS n FROM events GROUP BY 1""")
def capped_metrics(spark, sf_dir):
    return report.capped(table(spark, sf_dir, "events"), "user_id", "event_id", 64)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS samples, min(value) FILTER (i >= ceil(n * 0.5)) AS p50, min(value) FILTER (i >= ceil(n * 0.95)) AS p95, min(value) FILTER (i >= ceil(n * 0.99)) AS p99 FROM r GROUP BY event_type""")
def nearest_rank_percentiles(spark, sf_dir):
    return report.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT l_returnflag, round(regr_slope(l_quantity * 10, l_quantity), 6) AS slope FROM lineitem GROUP BY 1")
def growth_slope(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_quantity") * 10).alias("y"))
    return report.slope(li, ["l_returnflag"], "l_quantity", "y").withColumn("slope", F.round("slope", 6))


# advice ---------------------------------------------------------------------------------------------------------------
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as schemas, the brands they order as fields."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("schema"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("field"))


@query("""WITH f AS (SELECT DISTINCT 's' || CAST(o_custkey % 40 AS VARCHAR) AS schema, p_brand || '/' || CAST(p_size AS VARCHAR) AS field FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT schema, count(*) AS size FROM f GROUP BY 1), s AS (SELECT a.schema, b.schema AS other, count(*) AS shared FROM f a JOIN f b USING (field) WHERE a.schema <> b.schema GROUP BY 1, 2),
x AS (SELECT s.schema, other, shared, shared * 1024 // (n.size + m.size - shared) AS score FROM s JOIN n USING (schema) JOIN n m ON m.schema = other WHERE shared >= 2 AND shared * 2 >= n.size),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY schema ORDER BY score DESC, shared DESC, other) AS INTEGER) AS place FROM x) SELECT * FROM r WHERE place <= 3""")
def schema_similarity_top3(spark, sf_dir):
    return advice.similar_schemas(schema_fields(spark, sf_dir))


@query("""WITH w AS (SELECT item_id, text, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS said FROM benchmark),
v AS (SELECT item_id % 30 AS n, text, said FROM w)
SELECT 'f' || CAST(n AS VARCHAR) AS name, 'name' AS fault FROM v GROUP BY n HAVING count(*) > 1
UNION ALL SELECT 'f' || CAST(n AS VARCHAR), 'description' FROM v WHERE len(string_split(said, ' ')) < 3
UNION ALL SELECT 'f' || CAST(n AS VARCHAR), 'duplicate' FROM v WHERE said <> '' AND said IN (SELECT said FROM v GROUP BY said HAVING count(*) > 1)""")
def vocabulary_integrity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return advice.vocabulary_faults(b.select(F.concat(F.lit("f"), F.col("item_id") % 30).alias("name"), F.col("text").alias("description")))


# further operators of the same families ---------------------------------------------------------------------------------
@query(f"SELECT schema, hash, range_enc, seq, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY {KEYED} ORDER BY seq DESC) AS rn FROM ({UPSERTS}) WHERE seq <= 1) WHERE rn = 1 AND NOT deleted")
def snapshot_as_of(spark, sf_dir):
    return log.snapshot(upserts(spark, sf_dir), seq=1).select("schema", "hash", "range_enc", "seq", "l_partkey")


@query(f"SELECT {KEYED}, max(written_nanos) AS written_nanos, max(seq) AS seq FROM ({EVENT_LOG}) GROUP BY ALL")
def write_age_max(spark, sf_dir):
    return log.write_age(event_log(spark, sf_dir))


@query("SELECT user_id, arg_max(event_id, (epoch_us(ts), event_type, event_id)) AS event_id FROM events GROUP BY 1")
def replay_stamp_max(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros("ts").alias("us"), "event_type")
    return log.latest(e.withColumn("id", F.col("event_id")), ["user_id"], ["us", "event_type", "id"]).select("user_id", "event_id")


@query("SELECT DISTINCT o_orderpriority AS schema, o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_totalprice < 2000) AS holds FROM orders")
def schemas_that_hold_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "schema")
    return read.holding(o, o.where("o_totalprice < 2000"))


@query("SELECT event_id, CAST(regexp_full_match(props, '\\{\"k\": -?[0-9]+\\}') AS BOOLEAN) AS integer_k, false AS text_k, true AS any_object FROM events")
def field_type_checks(spark, sf_dir):
    from keylake.functions.types import FieldType, valid

    of = lambda kind: valid(F.col("props"), FieldType("Object", members=(("k", FieldType(kind)),)))
    return table(spark, sf_dir, "events").select("event_id", of("Integer").alias("integer_k"), of("String").alias("text_k"), valid(F.col("props"), FieldType("Map", (FieldType("Any"),))).alias("any_object"))


@query("SELECT event_id, event_id % 4 <> 0 AS ok FROM events")
def undeclared_fields(spark, sf_dir):
    from keylake.functions.types import FieldType, faults

    record = F.when(F.col("event_id") % 4 == 0, F.lit('{"other":1}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", (F.size(faults(record, {"k": FieldType("Integer")})) == 0).alias("ok"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS date_ok, o_orderkey % 5 <> 0 AS datetime_ok FROM orders")
def date_texts(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(F.substring(day, 1, 5), F.lit("02-30"))).otherwise(F.concat(day, F.lit("Z")))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    full = F.concat(stamp, F.when(F.col("o_orderkey") % 5 == 0, ".1234567890Z").when(F.col("o_orderkey") % 5 == 1, "Z").when(F.col("o_orderkey") % 5 == 2, "+02:00").when(F.col("o_orderkey") % 5 == 3, ".5z").otherwise(".123456789-11:30"))
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.valid_date(text).alias("date_ok"), codec.datetime_micros(full).isNotNull().alias("datetime_ok"))


PAD = "".join(f"{b ^ 0x36:02X}" for b in b"k" * 32 + bytes(32)), "".join(f"{b ^ 0x5C:02X}" for b in b"k" * 32 + bytes(32))


@query(f"""WITH m AS (SELECT c_custkey, sha256(unhex('{PAD[1]}' || sha256(unhex('{PAD[0]}' || hex('hk|v1') || '00' || hex('customer') || '00' || hex(c_name))))) AS mac FROM customer)
SELECT c_custkey, replace(replace(replace(to_base64(unhex(substr(mac, 1, 32))), '+', '-'), '/', '_'), '=', '') AS blinded FROM m""")
def blinded_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", codec.blinded_hash(b"k" * 32, "customer", F.col("c_name")).alias("blinded"))


@query("SELECT doc_id, doc_id % 3 = 0 AS ok FROM documents")
def inline_files(spark, sf_dir):
    raw = F.encode("text", "utf-8")
    size = F.length(raw) + F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0)
    digest = F.when(F.col("doc_id") % 3 == 2, "0").otherwise(F.sha2(raw, 256))
    content = F.regexp_replace(F.base64(raw), r"\s", "")
    return table(spark, sf_dir, "documents").select("doc_id", codec.inline_file_ok(content, size, digest).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE -1 END AS seconds FROM events")
def range_key_seconds(spark, sf_dir):
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lpad(F.unix_seconds("ts").cast("string"), 20, "0"), F.lit("-x"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(codec.range_seconds(key).cast("long"), F.lit(-1)).alias("seconds"))


@query("SELECT event_id, event_type AS kept FROM events")
def reserved_fields_stripped(spark, sf_dir):
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("created_by"), F.lit("a"), F.lit("updated_by"), F.lit("b"))
    own = read.user_fields(fields)
    return table(spark, sf_dir, "events").select("event_id", F.when(F.size(own) == 1, own["kind"]).alias("kept"))


@query(f"SELECT hash AS key_hash, range AS key_range, o_orderstatus, o_totalprice FROM ({ORDERS})")
def full_rows(spark, sf_dir):
    rows = read.full_rows(orders(spark, sf_dir), ["o_orderstatus", "o_totalprice"])
    return rows.select(F.col("key.hash").alias("key_hash"), F.col("key.range").alias("key_range"), "fields.o_orderstatus", "fields.o_totalprice")


@query("""SELECT verb, caller, n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'purge' ELSE 'delete' END AS verb, CAST(l_suppkey AS VARCHAR) AS caller, count(*) AS n, min(l_shipdate) AS first_at FROM lineitem GROUP BY 1, 2) ORDER BY first_at, verb, caller LIMIT 25""")
def delete_ledger_page(spark, sf_dir):
    verb = F.when(F.col("l_returnflag") == "R", "purge").otherwise("delete")
    li = table(spark, sf_dir, "lineitem").select(verb.alias("verb"), F.col("l_suppkey").cast("string").alias("caller"), F.lit("lineitem").alias("schema"), F.col("l_orderkey").cast("string").alias("hash"), F.col("l_linenumber").cast("string").alias("range_enc"), F.col("l_shipdate").alias("at"))
    return write.ledger_page(write.erase_audit(li), 25).select("verb", "caller", "n")


def by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders keyed by themselves, with the alternate by_customer (customer, order date) on three of four."""
    o = table(spark, sf_dir, "orders")
    alternate = F.struct(F.col("o_custkey").cast("string").alias("hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("range_enc"))
    return o.select(F.col("o_orderkey").cast("string").alias("hash"), F.lit("").alias("range"), F.lit("").alias("range_enc"), F.when(F.col("o_orderkey") % 4 != 0, F.create_map(F.lit("by_customer"), alternate)).alias("alternates"), "o_totalprice")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS alt_hash, strftime(o_orderdate, '%Y-%m-%d') AS alt_range_enc, CAST(o_orderkey AS VARCHAR) AS hash, o_totalprice FROM orders
WHERE o_orderkey % 4 <> 0 AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' AND (strftime(o_orderdate, '%Y-%m-%d'), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) > ('1995-06-01', '3', '') ORDER BY 2, 1, 3 LIMIT 200""")
def alternate_page(spark, sf_dir):
    rows = by_customer(spark, sf_dir)
    found = read.alternate_page(read.alternate_index(rows, "by_customer"), rows, read.Filter(start="1995-01-01", end="1997-01-01"), 200, ("3", "1995-06-01", "", ""))
    return found.select("alt_hash", "alt_range_enc", "hash", "found.o_totalprice")


@query(f"""SELECT item, place, hash, range FROM (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY range_enc, hash) AS INTEGER) AS place, hash, range, most FROM
(SELECT 0 AS item, 5 AS most, * FROM ({ORDERS}) WHERE o_orderstatus = 'O' AND hash = '7' UNION ALL SELECT 1, 30, * FROM ({ORDERS}) WHERE o_orderstatus = 'F' AND range_enc >= {ENC.format(1000)} AND range_enc < {ENC.format(9000)} UNION ALL SELECT 2, 10, * FROM ({ORDERS}) WHERE o_orderstatus = 'P' AND hash = '10')) WHERE place <= most""")
def read_list(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumnRenamed("o_orderstatus", "schema")
    lo, hi = (f"{v ^ 1 << 63:016x}" for v in (1000, 9000))
    return read.listed(rows, [(0, "O", read.Filter(hash="7"), 5), (1, "F", read.Filter(start=lo, end=hi), 30), (2, "P", read.Filter(hash="10"), 10)]).select("item", "place", "hash", "range")


@query("""SELECT hash, n FROM (SELECT CAST(o_custkey AS VARCHAR) AS hash, count(*) AS n FROM orders GROUP BY 1) WHERE hash = '7'""")
def expected_count(spark, sf_dir):
    """The guard passes for the right count; the tests show that it refuses another."""
    rows, key = orders(spark, sf_dir), read.Filter(hash="7")
    n = read.counted(rows, key)
    return read.select(rows, key).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") == read.counted(rows, key, n))


@query("""SELECT event_id, 'e' || CAST(user_id AS VARCHAR) AS hash, '{"event_type":"' || event_type || '"' || CASE WHEN user_id % 3 = 0 THEN ',"created_by":"ann"' ELSE '' END || '}' AS record, CASE WHEN user_id % 5 = 0 THEN 'f' END AS file_name FROM events""")
def api_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("e"), "user_id").alias("hash"), F.col("event_id").cast("string").alias("range"), F.lit("r").alias("revision"), "event_type", F.when(F.col("user_id") % 3 == 0, "ann").alias("created_by"), F.when(F.col("user_id") % 5 == 0, F.struct(F.lit("f").alias("name"))).alias("file"))
    return read.api_rows(rows, ["event_type"]).select(F.col("key.range").cast("long").alias("event_id"), F.col("key.hash").alias("hash"), "record", F.col("file.name").alias("file_name"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def ttl_in_scope(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("event_id", F.col("seq") - 1)
    listed = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("hash"))
    return log.in_scope(e, listed.union(listed)).select("event_id")


@query("SELECT event_id, sha256(encode(event_type || '|' || props) || encode(CAST(user_id AS VARCHAR))) AS entry_hash FROM events")
def entry_hash(spark, sf_dir):
    signed = F.encode(F.concat_ws("|", "event_type", "props"), "utf-8")
    return table(spark, sf_dir, "events").select("event_id", codec.entry_hash(signed, F.encode(F.col("user_id").cast("string"), "utf-8")).alias("entry_hash"))


@query("SELECT item_id, substr(text, 1, 60) AS clipped FROM benchmark WHERE strlen(text) = length(text)")
def clipped_texts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where(F.octet_length("text") == F.length("text"))
    return b.select("item_id", codec.clip(F.col("text"), 60).alias("clipped"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT replace(p_name, ' ', '_') || '_bytes' AS name, 'private' AS suggested_classification FROM n WHERE strlen(p_name) % 2 = 0 AND strlen(p_name) % 3 <> 0""")
def suggested_classifications(spark, sf_dir):
    size = F.length("name") - 6
    v = vocabulary(spark, sf_dir).withColumn("classification", F.when(size % 2 == 0, "private"))
    drafts = v.select(F.lit("d").alias("draft"), "name", "type", F.when(size % 3 == 0, "something else altogether").otherwise(F.col("description")).alias("description"), F.lit(None).cast("string").alias("classification"))
    return advice.suggested_classifications(drafts, v).select("name", "suggested_classification")


LOGGED = "o AS (SELECT o_orderkey, o_orderkey % 10 AS k, count(*) OVER () AS n, row_number() OVER (PARTITION BY o_orderkey % 10 NOT IN (1, 2, 3) ORDER BY o_orderkey) - 1 AS again FROM orders)"


@query(f"""WITH {LOGGED} SELECT CAST(o_orderkey AS VARCHAR) AS hash, CASE WHEN k IN (1, 2) THEN n + again + 1 ELSE o_orderkey + 1 END AS seq, 'ann' AS created_by, CASE WHEN k IN (1, 2) THEN 'bob' ELSE 'ann' END AS updated_by,
CAST(5000 AS BIGINT) AS authored_ms, CASE WHEN k IN (1, 2) THEN 5000000000 + n + again ELSE 5000000000 + o_orderkey END AS written_nanos, CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END AS v, CASE WHEN k <> 2 AND o_orderkey % 3 = 0 THEN 'f' || CAST(o_orderkey AS VARCHAR) END AS file_name FROM o WHERE k <> 3""")
def batches_through_a_log(spark, sf_dir):
    """Creates of all orders, then replaces and deletes of some by the revisions read back, a second earlier by the writer's clock: all through a log on disk."""
    import uuid

    from keylake.plans.catalog import Catalog, Definition
    from keylake.sources.files import marker
    from keylake.sources.log_table import RecordLog
    from keylake.sources.work import shared_folder

    place, catalog = RecordLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"), Catalog([Definition("order", "ann", "Orders", {"v": "Integer"})])
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    file = marker(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), none, F.encode(F.col("o_orderkey").cast("string"), "utf-8"))
    first = o.select(F.col("o_orderkey").alias("index"), F.lit("create").alias("op"), F.lit("order").alias("schema"), F.col("o_orderkey").cast("string").alias("hash"), none.alias("range_enc"), none.alias("revision"), F.lit('{"v":1}').alias("record"), F.when(F.col("o_orderkey") % 3 == 0, file).alias("file"))
    place.write(first, 5000, "n1", "ann", catalog=catalog)
    live, kind = place.snapshot(), F.col("hash").cast("long") % 10
    index = F.expr("(CAST(hash AS LONG) div 10) * 3 + CAST(hash AS LONG) % 10 - 1")
    second = live.where(kind.isin(1, 2, 3)).select(index.alias("index"), F.when(kind == 3, "delete").otherwise("replace").alias("op"), "schema", "hash", "range_enc", "revision", F.when(kind != 3, '{"v":2}').alias("record"), F.lit(None).cast(live.schema["file"].dataType).alias("file"), (kind == 2).alias("clear_file"))
    place.write(second, 4000, "n1", "bob", catalog=catalog)
    place.compact()
    return place.snapshot().select("hash", "seq", "created_by", "updated_by", "authored_ms", "written_nanos", F.get_json_object("record", "$.v").cast("int").alias("v"), F.col("file.name").alias("file_name"))


def seeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries that have seen the grants of their own orders up to a total price."""
    o = table(spark, sf_dir, "orders").where("o_totalprice < 250000")
    seen = o.groupBy("o_custkey").agg(F.collect_list(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("seen_heads"))
    return seen.select((F.col("o_custkey") % 4).cast("string").alias("database_id"), F.concat(F.lit("e"), F.col("o_custkey")).alias("entry_hash"), F.col("o_custkey").cast("string").alias("node_key"), "seen_heads")


@query(f"""WITH {GRANTS} SELECT database_id, entry_hash, role AS window_role FROM (SELECT g.database_id, 'e' || grantee AS entry_hash, role, row_number() OVER (PARTITION BY g.database_id, grantee ORDER BY lamport DESC, device_id DESC, rank, entry_hash DESC) AS rn
FROM g JOIN orders o ON o.o_orderkey = g.o_orderkey WHERE o.o_totalprice < 250000) WHERE rn = 1""")
def grant_window_roles(spark, sf_dir):
    return sync.window_roles(seeing(spark, sf_dir), grants(spark, sf_dir))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS database_id, 'c' || CAST(c_custkey AS VARCHAR) AS entry_hash, c_name AS key, hex(encode(c_mktsegment)) AS value FROM customer
WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 0 AND c_custkey % 5 = 0)""")
def proposal_content(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    entries = c.select(F.col("c_nationkey").cast("string").alias("database_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("entry_hash"), F.lit("data").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, "direct").otherwise("proposal").alias("stream"), F.when(F.col("c_custkey") % 2 == 0, "owner").otherwise("member").alias("node_key"), ((F.col("c_custkey") % 3 == 1) & (F.col("c_custkey") % 5 == 0)).alias("incorporated"), codec.encode_payload(F.col("c_name"), F.encode("c_mktsegment", "utf-8")).alias("payload"))
    own = entries.select("database_id", F.lit("owner").alias("owner")).distinct()
    return sync.content(entries, own).select("database_id", "entry_hash", "key", F.hex("value").alias("value"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS entry_hash, CAST(l_linenumber AS VARCHAR) AS key FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_linenumber) AND l_orderkey % 4 <> 0)")
def bundle_changes(spark, sf_dir):
    change = F.struct(F.lit("n").alias("namespace"), codec.encode_payload(F.col("l_linenumber").cast("string"), F.lit(b"v")).alias("payload"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(change)).alias("sorted"))
    wrong = F.when(F.col("l_orderkey") % 4 == 0, F.concat("sorted", F.array(F.col("sorted")[0]))).otherwise(F.col("sorted"))
    bundles = by.select(F.col("l_orderkey").cast("string").alias("entry_hash"), wrong.alias("changes"))
    return sync.unpacked(bundles).select("entry_hash", codec.payload_key(F.col("payload")).alias("key"))


@query(f"""WITH {ENTRY_LOG}, h AS (SELECT * FROM entries WHERE arrival % 2 = 0)
SELECT database_id, node_key, device_id, writer_seq, CASE WHEN arrival % 2 = 1 THEN 'new' WHEN arrival % 6 = 0 THEN 'conflict' ELSE 'duplicate' END AS outcome FROM entries""")
def relay_append(spark, sf_dir):
    e = entry_log(spark, sf_dir)
    page = e.withColumn("entry_hash", F.when(F.col("arrival") % 6 == 0, "forged").otherwise(F.col("entry_hash")))
    return sync.append_page(page, e.where("arrival % 2 = 0")).select("database_id", "node_key", "device_id", "writer_seq", "outcome")


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS entry_hash, event_id AS queued_at FROM events WHERE event_id % 3 <> 0")
def outbox_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("entry_hash"), F.col("event_id").alias("queued_at"))
    again = e.where("queued_at % 5 = 0").withColumn("queued_at", F.col("queued_at") + 1000000)
    return sync.outbox(e.union(again), e.where("queued_at % 3 = 0").select("entry_hash"))


@query("""WITH r AS (SELECT c_custkey, ['write', 'submit', 'read', 'revoked', 'none'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS role, ['append_proposal', 'read', 'blob_put'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS wants FROM customer)
SELECT c_custkey AS request, wants, CASE wants WHEN 'read' THEN role IN ('write', 'submit', 'read') WHEN 'append_proposal' THEN role IN ('write', 'submit') ELSE role = 'write' END AS allowed FROM r""")
def relay_gate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % n + 1).cast("int"))
    asked = c.select(F.col("c_custkey").alias("request"), F.lit("db").alias("database_id"), F.col("c_name").alias("node_key"), pick(["append_proposal", "read", "blob_put"], 3).alias("wants"))
    given = c.where("c_custkey % 5 < 4").select(F.lit("db").alias("database_id"), F.col("c_name").alias("grantee"), pick(["write", "submit", "read", "revoked", "none"], 5).alias("role"))
    own = spark.createDataFrame([("db", "somebody")], "database_id string, owner string")
    return sync.gated(asked, given, own).select("request", "wants", "allowed")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq FROM events),
x AS (SELECT user_id, event_type, seq, event_id, event_id % 50 = 0 AND event_id > 0 AS broken FROM e WHERE event_id % 97 <> 96),
f AS (SELECT *, seq <> coalesce(lag(seq) OVER (PARTITION BY user_id, event_type ORDER BY seq), 0) + 1 AS gap FROM x),
s AS (SELECT *, min(CASE WHEN gap OR broken THEN seq END) OVER (PARTITION BY user_id, event_type) AS stop FROM f)
SELECT event_id AS arrival, CASE WHEN stop IS NULL OR seq < stop THEN 'accepted' WHEN seq = stop AND broken AND NOT gap THEN 'rejected' ELSE 'pending' END AS outcome FROM s""")
def accepted_entries(spark, sf_dir):
    """Every user a database of its own, whose owner writes one chain per event type; some links are wrong, some entries lost."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ident = lambda c: F.sha2(c.cast("string"), 256)
    user, none = F.col("user_id").cast("string"), F.lit(None)
    kept = F.col("event_id") % 97 != 96
    born = F.min(F.when(kept, F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = e.select("user_id", "event_type", "ts", "event_id").withColumn("first", born == F.col("event_id"))  # a user's partition holds all of its chains
    rows = rows.withColumns({"seq": F.row_number().over(w).cast("long"), "_before": F.lag("event_id").over(w)}).where(kept)
    before = F.when((F.col("event_id") % 50 == 0) & (F.col("event_id") > 0), "wrong").otherwise(F.coalesce(ident(F.col("_before")), F.lit("")))
    rows = rows.withColumn("prev", before)
    entries = rows.select(
        user.alias("database_id"), user.alias("node_key"), F.col("event_type").alias("device_id"), F.col("seq").alias("writer_seq"), F.col("prev").alias("prev_hash"), F.col("seq").alias("lamport"), F.array().cast("array<string>").alias("seen_heads"),
        F.when(F.col("first"), "birth").otherwise("data").alias("kind"), F.lit("direct").alias("stream"), none.cast("string").alias("role"), user.alias("grantee"), F.array().cast("array<struct<device_id:string,writer_seq:bigint>>").alias("cutoffs"), none.cast("string").alias("grant_device"),
        none.cast("long").alias("grant_seq"), none.cast("boolean").alias("incorporated"), ident(F.col("event_id")).alias("entry_hash"), F.lit(True).alias("signature_valid"), F.col("event_id").alias("arrival"),
    )
    return sync.accept(entries).select("arrival", "outcome")


@query("SELECT namespace, field FROM (SELECT DISTINCT source AS namespace, lang AS field FROM documents) WHERE namespace IN ('src1', 'src2') OR (namespace = 'src3' AND field = 'en')")
def share_admission(spark, sf_dir):
    fields = table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.col("lang").alias("field")).distinct()
    policy = spark.createDataFrame([("src1", None), ("src2", None), ("src3", "en")], "namespace string, field string")
    return advice.admitted(fields, policy)


@query("""SELECT name, CASE WHEN NOT regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z][a-z0-9]*)*') THEN 'form' WHEN NOT contains(name, '_') THEN 'one concept' WHEN len(list_filter(string_split(name, '_'), lambda w: strlen(w) = 1)) > 0 THEN 'one letter' WHEN len(list_filter(string_split(name, '_'), lambda w: strlen(w) = 2)) > 0 THEN 'short word' WHEN contains(name, 'item') THEN 'vague' END AS fault
FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_name WHEN 2 THEN string_split(p_name, ' ')[1] WHEN 3 THEN replace(p_name, ' ', '_') || '_x' WHEN 4 THEN replace(p_name, ' ', '_') || '_qx' ELSE replace(p_name, ' ', '_') || '_item' END AS name FROM part)""")
def field_name_faults(spark, sf_dir):
    snake, k = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey") % 6
    name = F.when(k == 0, snake).when(k == 1, F.col("p_name")).when(k == 2, F.split("p_name", " ")[0]).when(k == 3, F.concat(snake, F.lit("_x"))).when(k == 4, F.concat(snake, F.lit("_qx"))).otherwise(F.concat(snake, F.lit("_item")))
    return table(spark, sf_dir, "part").select(name.alias("name")).select("name", advice.name_fault(F.col("name"), ["id"], ["psi", "qty"]).alias("fault"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as canonical fields of bytes."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return p.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_bytes")).alias("name"), F.lit("Integer").alias("type"), F.concat(F.lit("the size of a "), "p_name", F.lit(" in bytes")).alias("description"), F.lit(1).alias("version"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), d AS (SELECT p_name, string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) || 'Byte' AS camel FROM n)
SELECT camel AS name, replace(p_name, ' ', '_') || '_bytes' AS other, 2 AS score, 1 AS place FROM d UNION ALL SELECT 'extent of ' || p_name, replace(p_name, ' ', '_') || '_bytes', 1, 1 FROM d""")
def near_field_names(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    camel = F.concat(F.split("p_name", " ")[0], F.initcap(F.split("p_name", " ")[1]), F.lit("Byte"))
    none = F.lit(None).cast("string")
    drafts = n.select(F.lit("d").alias("draft"), camel.alias("name"), F.lit("Integer").alias("type"), none.alias("description"))
    drafts = drafts.union(n.select(F.lit("d"), F.concat(F.lit("extent of "), "p_name"), F.lit("Integer"), F.concat(F.lit("size of "), "p_name", F.lit(" in byte"))))
    return advice.near_matches(drafts, vocabulary(spark, sf_dir)).drop("draft")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT replace(p_name, ' ', '_') || '_bytes' AS name, CASE WHEN strlen(p_name) % 3 = 1 THEN 'canonical_match' ELSE 'same_name_different_meaning' END AS kind, CASE strlen(p_name) % 3 WHEN 0 THEN 'type' WHEN 2 THEN 'description' ELSE '' END AS differs FROM n""")
def canonical_fields(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    size = F.length("name") - 6
    drafts = v.select(F.lit("d").alias("draft"), "name", F.when(size % 3 == 0, "String").otherwise("Integer").alias("type"), F.when(size % 3 == 2, "something else altogether").otherwise(F.col("description")).alias("description"), "version")
    return advice.canonical_findings(drafts, v).select("name", "kind", "differs")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT replace(p_name, ' ', '_') || '_bytes' AS name, 'Integer' AS suggested_type FROM n UNION ALL SELECT 'new_' || replace(p_name, ' ', '_'), NULL FROM n""")
def missing_types(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    bare = v.select(F.lit("d").alias("draft"), "name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description"))
    new = table(spark, sf_dir, "part").select("p_name").distinct().select(F.lit("d"), F.concat(F.lit("new_"), F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return advice.missing_types(bare.union(new), v).select("name", "suggested_type")


@query("SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - o.i AS started, count(*) AS n FROM events, (VALUES (INTERVAL '0 minutes'), (INTERVAL '30 minutes')) o(i) GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    from keylake.streaming.feeds import windowed

    e = table(spark, sf_dir, "events")
    return windowed(e, "ts", "1 hour", ["event_type"], slide="30 minutes").select("event_type", F.col("window.start").alias("started"), "n")


# extensions: what Spark adds on record fields ---------------------------------------------------------------------------
@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY CUBE (c_mktsegment, o_orderstatus)")
def field_join_cube(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.where("o_totalprice > 1000").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from keylake.streaming.feeds import windowed

    e = table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return windowed(e, "ts", "1 hour", ["event_type"]).select("event_type", F.col("window.start").alias("hour"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM i GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    from keylake.streaming.feeds import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", F.col("session_window.start").alias("started"), "n")


@query("""SELECT o_orderkey, (SELECT max(e.ts) FROM events e WHERE e.user_id = o_custkey AND e.ts <= o_orderdate) AS last_event FROM orders""")
def as_of_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), "o_orderkey", F.lit(None).cast("timestamp").alias("seen"), F.lit(1).alias("side"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(None).cast("long").alias("o_orderkey"), F.col("ts").alias("seen"), F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return o.union(e).withColumn("last_event", F.last("seen", ignorenulls=True).over(w)).where("side = 1").select("o_orderkey", "last_event")
