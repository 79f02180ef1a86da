import hashlib
import hmac
import os
import random
import shutil
import subprocess
import sys
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from keylake.functions import codec
from keylake.functions.types import FieldType, faults, valid
from keylake.operators import log, read, write
from keylake.plans.catalog import Catalog, CatalogRefused, Definition, Key, evolve
from keylake.sources import files
from keylake.sources.log_table import RecordLog
from keylake.streaming import feeds

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# codecs -----------------------------------------------------------------------------------------------------------------
def test_integers_sort_as_text(spark):
    r = random.Random(1)
    values = [-(2**63), -5, -1, 0, 7, 2**63 - 1, *[r.randint(-(2**63), 2**63 - 1) for _ in range(200)]]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("e", codec.encode_integer(F.col("v"))).withColumn("d", codec.decode_integer(F.col("e"))).collect()
    assert all(x.e == f"{x.v + 2**63:016x}" and x.d == x.v for x in rows)
    assert [x.v for x in sorted(rows, key=lambda x: x.e)] == sorted(values)


def test_dates_and_booleans(spark):
    days = [date(1, 1, 1), date(1969, 12, 31), date(1970, 1, 1), date(2024, 2, 29), date(9999, 12, 31)] + [date(1900, 1, 1) + timedelta(days=997 * i) for i in range(60)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").withColumn("e", codec.encode_date(F.col("d"))).withColumn("b", codec.decode_date(F.col("e"))).collect()
    assert all(x.e == f"{x.d.toordinal() + 365:06x}" and x.b == x.d for x in rows)
    assert spark.range(1).select(codec.encode_date(F.lit("1970-01-01").cast("date"))).first()[0] == "0afaa8"


def test_datetimes(spark):
    good = {
        "1970-01-01T00:00:00Z": ("1970-01-01T00:00:00.000000000Z", 0),
        "2024-05-06T07:08:09.123456789+02:30": ("2024-05-06T04:38:09.123456789Z", 1714970289123456789),
        "2024-05-06t07:08:09.5z": ("2024-05-06T07:08:09.500000000Z", 1714979289500000000),
    }
    bad = ["2024-05-06T07:08:09", "2024-05-06T07:08:60Z", "2024-05-06T07:08:09.1234567890Z", "2023-02-29T00:00:00Z", "x", None]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", codec.encode_datetime(F.col("t")).alias("e"), codec.canonical_datetime(F.col("t")).alias("c")).collect()
    for x in rows:
        if x.t in good:
            assert (x.c, x.e) == (good[x.t][0], f"{good[x.t][1] + 719528 * 86400 * 10**9:018x}")
        else:
            assert x.e is None and x.c is None


def test_ranges_by_kind(spark):
    rows = [("Integer", "+07", f"{7 + 2**63:016x}"), ("Integer", "1.0", None), ("Integer", "9223372036854775808", None), ("Date", "2023-02-29", None), ("Date", "1970-01-01", "0afaa8"), ("Boolean", "TRUE", None), ("Boolean", "true", "1"), ("String", "z", "z")]
    for kind, text, want in rows:
        assert spark.createDataFrame([(text,)], "t string").select(codec.encode_range(F.col("t"), kind)).first()[0] == want, (kind, text)


def test_hashes_and_payloads(spark):
    key, text = b"k" * 32, "née\0x"
    row = spark.createDataFrame([(text, "v", 5, "s", 9)], "t string, v string, ms long, s string, q long")
    got = row.select(
        codec.hmac_sha256(key, F.encode("t", "utf-8")).alias("mac"),
        codec.blinded_hash(key, "f", F.col("t")).alias("blind"),
        codec.revision(F.col("ms"), F.col("s"), F.col("q")).alias("rev"),
        codec.payload_key(codec.encode_payload(F.col("t"), F.encode("v", "utf-8"))).alias("k"),
        codec.payload_value(codec.encode_payload(F.col("t"), F.lit(b""))).alias("none"),
        codec.clip(F.col("t"), 2).alias("clip"),
        codec.escape_segment(F.col("t")).alias("esc"),
        codec.inline_file_ok(F.base64(F.encode("t", "utf-8")), F.lit(6), F.sha2(F.encode("t", "utf-8"), 256)).alias("file"),
        codec.range_seconds(F.lit("00000000000000000042/x")).alias("sec"),
    ).first()
    assert got.mac == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    assert len(got.blind) == 22 and not set(got.blind) & set("+/=")
    assert got.rev == hashlib.sha256(b"record-revision-v2\0" + (5).to_bytes(8, "big") + b"s" + (9).to_bytes(8, "big")).hexdigest()
    assert (got.k, bytes(got.none), got.clip, got.esc, got.file, got.sec) == (text, b"", "n", "née\x01\x01x", True, 42)
    assert codec.prefix_end("a") == "b" and codec.prefix_end("퟿") == "" and codec.prefix_end("a\U0010ffff") == "b" and codec.prefix_end("\U0010ffff") is None


# types ------------------------------------------------------------------------------------------------------------------
def test_types(spark):
    T = FieldType
    cases = [
        (T("Integer"), ["1", "-5"], ["1.0", '"1"', "9223372036854775808", "null"]),
        (T("Float"), ["1", "1.5"], ['"x"', "true"]),
        (T("Boolean"), ["true"], ["1", "null"]),
        (T("Date"), ['"2024-02-29"'], ['"2023-02-29"', '"2024-2-1"']),
        (T("DateTime"), ['"2024-02-29T00:00:00Z"'], ['"2024-02-29"']),
        (T("Array", (T("Integer"),)), ["[]", "[1,2]"], ['[1,"a"]', "{}"]),
        (T("Map", (T("String"),)), ['{"a":"b"}'], ['{"a":1}']),
        (T("OneOf", (T("String"), T("Null"))), ['"a"', "null"], ["1"]),
        (T("Object", members=(("a", T("OneOf", (T("String"), T("Null")))), ("b", T("Integer")))), ['{"b":1}', '{"a":"x","b":2,"c":[]}'], ['{"a":"x"}', '{"b":"1"}']),
        (T("Any"), ["[1]", "null"], ["{", ""]),
    ]
    for kind, good, bad in cases:
        rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean").select("v", "want", valid(F.col("v"), kind).alias("got")).collect()
        assert all(r.got == r.want for r in rows), (kind, rows)
    got = spark.createDataFrame([('{"n":1,"s":2,"z":0}',)], "r string").select(faults(F.col("r"), {"n": T("Integer"), "s": T("String"), "gone": T("String")})).first()[0]
    assert sorted(got) == ["s", "z"]


# reads ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def records(spark):
    r = random.Random(3)
    rows = sorted({(r.choice("abcd"), f"{r.randint(0, 40):02d}") for _ in range(120)})
    return spark.createDataFrame([(h, e, e, i) for i, (h, e) in enumerate(rows)], "hash string, range string, range_enc string, value int").cache()


def test_pages_concatenate_to_the_full_read(records):
    every = [(r.hash, r.range) for r in records.orderBy("range_enc", "hash").collect()]
    for limit in (1, 7, 50, 1000):
        seen, cursor = [], None
        while True:
            rows, cursor = read.read_page(records, "s", read.Filter(start="00"), limit, cursor)
            seen += [(r["hash"], r["range"]) for r in rows]
            if cursor is None:
                break
            if limit == 1 and len(seen) > 12:
                every = every[:13]
                break
        assert seen == every if limit > 1 else seen == every[: len(seen)]
        every = [(r.hash, r.range) for r in records.orderBy("range_enc", "hash").collect()]


def test_refusals(records):
    with pytest.raises(read.ReadRefused):
        read.select(records, read.Filter())
    with pytest.raises(read.ReadRefused):
        read.select(records, read.Filter(prefix="a"), "Integer")
    with pytest.raises(read.ReadRefused):
        read.page(records, 5, cursor=("a", "01"), descending=True)
    _, cursor = read.read_page(records, "s", read.Filter(hash="a"), 2)
    with pytest.raises(read.CursorMismatch):
        read.read_page(records, "s", read.Filter(hash="b"), 2, cursor)
    with pytest.raises(read.CursorMismatch):
        read.cursor_key("%%%", "x")
    assert read.select(records, read.Filter(start="09", end="03")).count() == 0
    assert read.read_page(records, "s", read.Filter(hash="a"), 0) == ([], None)


@pytest.mark.parametrize("limit", [999, 1000, 1500])
def test_large_pages_lose_nothing(spark, limit):
    rows = spark.range(2500).selectExpr("'h' AS hash", "lpad(id, 6, '0') AS range", "lpad(id, 6, '0') AS range_enc")
    seen, cursor, sizes = [], None, []
    while True:
        page, cursor = read.read_page(rows, "s", read.Filter(hash="h"), limit, cursor, expected=2500)
        seen += [r["range"] for r in page]
        sizes.append(len(page))
        if cursor is None:
            break
    assert seen == [f"{i:06d}" for i in range(2500)] and sizes[0] == min(limit, 1000)
    with pytest.raises(read.CountMismatch):
        read.read_page(rows, "s", read.Filter(hash="h"), limit, expected=2499)


def test_pages_by_an_alternate(spark):
    def rows(wrong=()):
        at = "CASE WHEN id % 5 = 0 THEN NULL ELSE map('by_k', named_struct('hash', {}, 'range_enc', lpad(id div 7, 3, '0'))) END AS alternates"
        moved = f"CASE WHEN id IN ({', '.join(map(str, wrong)) or -1}) THEN 'zz' ELSE concat('k', id % 3) END"
        return spark.range(60).selectExpr("lpad(id, 4, '0') AS hash", "'' AS range_enc", at.format(moved), "id")

    index = read.alternate_index(rows(), "by_k")
    want = sorted((f"{i // 7:03d}", f"k{i % 3}", f"{i:04d}") for i in range(60) if i % 5)
    key = read.Filter(start="000", end="009")
    for limit in (1, 7, 1000):
        seen, cursor = [], None
        while True:
            page, cursor = read.read_alternate_page(index, rows(), "s", "by_k", key, limit, cursor)
            seen += [(r["alt_range_enc"], r["alt_hash"], r["hash"]) for r in page]
            if cursor is None or (limit == 1 and len(seen) > 4):
                break
        assert seen == want[: len(seen)] and (limit == 1 or len(seen) == len(want))
    _, cursor = read.read_alternate_page(index, rows(), "s", "by_k", key, 3)
    for wrong in (lambda: read.read_alternate_page(index, rows(), "s", "other", key, 3, cursor), lambda: read.read_alternate_page(index, rows(), "s", "by_k", read.Filter(start="001"), 3, cursor)):
        with pytest.raises(read.CursorMismatch):
            wrong()
    outside = read.cursor_text("ak2:" + read.binding('["s", "by_k"]', key), "k0", "009", "0001", "")
    with pytest.raises(read.CursorMismatch):
        read.read_alternate_page(index, rows(), "s", "by_k", key, 3, outside)
    with pytest.raises(read.IndexMismatch):
        read.read_alternate_page(index, rows([3]), "s", "by_k", key, 10)


def test_lists_of_reads(spark):
    rows = spark.range(50).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS schema", "concat('h', id % 3) AS hash", "lpad(id, 3, '0') AS range_enc")
    got = read.read_list(rows, [("b", read.Filter(hash="h1"), 3), ("a", read.Filter(), 5), ("a", read.Filter(prefix="00"), 100), ("b", read.Filter(prefix="0"), 5), ("none", read.Filter(hash="h0"), 5)], {"b": "Integer"})
    assert [r["range_enc"] for r in got[0]["rows"]] == ["001", "007", "013"] and got[0]["more"]
    assert "key" in got[1]["error"] and "String" in got[3]["error"]
    assert [r["range_enc"] for r in got[2]["rows"]] == ["000", "002", "004", "006", "008"] and not got[2]["more"] and got[4] == {"rows": [], "more": False}
    for wrong in ([], [("a", read.Filter(hash="x"), 1)] * 65):
        with pytest.raises(read.ReadRefused):
            read.read_list(rows, wrong)
    assert read.holding(spark.createDataFrame([("a",), ("z",)], "schema string"), rows).where("holds").collect()[0].schema == "a"


def test_predicates_push_down(records, tmp_path, spark):
    records.write.parquet(f"{tmp_path}/r")
    rows = read.select(spark.read.parquet(f"{tmp_path}/r"), read.Filter(hash="a", prefix="1")).select("hash", "range")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hash,a)" in plan and "StringStartsWith(range_enc,1), GreaterTh" in plan and "value" not in plan.split("ReadSchema")[1]


# log and writes ---------------------------------------------------------------------------------------------------------
def items(spark, *rows):
    return spark.createDataFrame([(i, op, "s", h, "", rev, rec) for i, (op, h, rev, rec) in enumerate(rows)], "index long, op string, schema string, hash string, range_enc string, revision string, record string")


def test_conditional_writes_and_feed(spark, tmp_path):
    table = RecordLog(spark, f"file://{tmp_path}/log")
    assert table.snapshot().count() == 0
    table.write(items(spark, ("create", "a", None, "{}"), ("create", "b", None, "{}")), 1000, "n1", "ann")
    now = {r.hash: r for r in table.snapshot().collect()}
    assert sorted(now) == ["a", "b"] and now["a"].created_by == now["a"].updated_by == "ann"
    for rows, index, reason in (
        ([("create", "c", None, "{}"), ("create", "a", None, "{}")], 1, "exists"),
        ([("replace", "z", "r", "{}")], 0, "absent"),
        ([("replace", "a", "stale", "{}")], 0, "revision"),
        ([("delete", "q", "r", None)], 0, "absent"),
        ([("create", "d", None, "{}"), ("create", "d", None, "{}")], 0, "repeated"),
        ([("create", "e", None, "x" * 70_000)], 0, "size"),
        ([("create", "", None, "{}")], 0, "shape"),
        ([("create", "f", "rev", "{}")], 0, "shape"),
    ):
        with pytest.raises(write.WriteRefused) as refused:
            table.write(items(spark, *rows), 2000, "n1", "bob")
        assert (refused.value.index, refused.value.reason) == (index, reason)
    assert table.snapshot().count() == 2  # nothing of a refused batch was written
    table.write(items(spark, ("replace", "a", now["a"].revision, '{"v":2}'), ("delete", "b", now["b"].revision, None)), 500, "n1", "bob")
    live = table.snapshot().collect()
    assert [(r.hash, r.created_by, r.updated_by, r.authored_ms) for r in live] == [("a", "ann", "bob", 1000)]  # time doesn't fall back
    table.write(items(spark, ("create", "b", None, "{}")), 3000, "n1", "cat")  # a tombstone doesn't stop a create
    assert sorted(r.hash for r in table.snapshot().collect()) == ["a", "b"] and sorted(r.hash for r in table.snapshot(1).collect()) == ["a", "b"]
    assert [r.seq for r in log.change_page(table.read(), 0).collect()] == [1, 2, 3, 4, 5]
    seen = []
    stream = feeds.follow(spark, f"file://{tmp_path}/log", lambda df, _: seen.extend((r.seq, r.hash, r.deleted) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(seen) == [(1, "a", False), (2, "b", False), (3, "a", False), (4, "b", True), (5, "b", False)]
    replay = {}
    for seq, h, gone in sorted(seen):
        replay[h] = not gone
    assert sorted(h for h, on in replay.items() if on) == sorted(r.hash for r in table.snapshot().collect())


FILED = "index long, op string, schema string, hash string, range_enc string, revision string, record string, file struct<name:string,media_type:string,size:bigint,sha256:string,path:string>, clear_file boolean"


def filed(spark, *rows):
    mark = lambda name: name and (name, None, 1, name * 64, None)
    return spark.createDataFrame([(i, op, "s", h, None, rev, rec, mark(name), clear) for i, (op, h, rev, rec, name, clear) in enumerate(rows)], FILED)


def test_files_clocks_and_empty_batches(spark, tmp_path):
    table = RecordLog(spark, f"file://{tmp_path}/log")
    assert table.write(filed(spark).limit(0), 1, "n", "ann") == 0 and table.epoch() is None
    table.write(filed(spark, ("create", "a", None, "{}", "a", False), ("create", "b", None, "{}", None, False), ("create", "c", None, "{}", "c", False)), 1000, "n", "ann")
    assert table.write(filed(spark).limit(0), 2000, "n", "ann") == 1  # an empty batch makes no commit and harms nothing
    with pytest.raises(write.WriteRefused) as refused:  # a null range is an empty one: the key is there
        table.write(filed(spark, ("create", "a", None, "{}", None, False)), 2000, "n", "ann")
    assert refused.value.reason == "exists"
    now = {r.hash: r.revision for r in table.snapshot().collect()}
    table.write(filed(spark, ("replace", "a", now["a"], "{}", None, False), ("replace", "c", now["c"], "{}", None, True), ("replace", "b", now["b"], "{}", "b", False)), 500, "n", "bob")
    live = {r.hash: r for r in table.snapshot().collect()}
    assert {h: r.file and r.file.name for h, r in live.items()} == {"a": "a", "b": "b", "c": None}
    clock = [r.written_nanos for r in table.read().orderBy("seq").collect()]
    assert clock == [10**9 + i for i in range(6)] and {r.authored_ms for r in live.values()} == {1000}
    with pytest.raises(ValueError):
        table.append(table.snapshot().withColumn("mine", F.lit(1)), table.state())
    with pytest.raises(write.WriteRefused) as refused:
        table.write(filed(spark, ("create", "x", None, "{}", None, False)).withColumn("index", F.lit(5)), 2000, "n", "ann")
    assert refused.value.reason == "index"


def test_compaction_restores_and_erasing(spark, tmp_path):
    table = RecordLog(spark, f"file://{tmp_path}/log")
    for k in range(3):
        table.write(items(spark, *[("create", f"{k}{i}", None, "{}") for i in range(4)]), 1000 * k, "n", "ann")
    old = {r.hash: r.revision for r in table.snapshot().collect()}
    table.write(items(spark, *[("replace", f"0{i}", old[f"0{i}"], '{"v":1}') for i in range(4)]), 9000, "n", "ann")
    before, epoch = sorted(table.read().collect()), table.epoch()
    number = table.compact()
    assert sorted(table.read().collect()) == before and table.epoch() == epoch and len(list((tmp_path / "log/data").iterdir())) == 5
    assert table.snapshot(number - 1).count() == 12 and table.snapshot(1).count() == 4  # older versions can still be read
    swept = table.snapshot().where("hash < '11'").select("schema", "hash", "range_enc", "seq")
    stale = swept.withColumn("seq", F.when(F.col("hash") == "02", 1).otherwise(F.col("seq")))
    table.erase(stale, 10_000, "n", "sweeper")
    assert sorted(r.hash for r in table.snapshot().collect()) == ["02", "11", "12", "13", "20", "21", "22", "23"]  # what was written since stays
    gone = table.read().where("deleted").orderBy("seq").collect()
    assert [r.seq for r in gone] == [17, 18, 19, 20] and {r.verb for r in gone} == {"purge"} and len({r.written_nanos for r in gone}) == 4
    policies = spark.createDataFrame([("s", "Hash", 6)], "schema string, layout string, ttl_seconds long")
    table.sweep(policies, 8000, "n", "sweeper", verb="delete")
    assert sorted(r.hash for r in table.snapshot().collect()) == ["02", "20", "21", "22", "23"]
    table.compact(history=0)
    rows = table.read().collect()
    assert sorted((r.hash, r.deleted) for r in rows) == [("02", False), ("11", True), ("12", True), ("13", True), ("20", False), ("21", False), ("22", False), ("23", False)]
    table.restore(2)
    assert table.epoch() != epoch and sorted(r.hash for r in table.snapshot().collect()) == ["00", "01", "02", "03", "10", "11", "12", "13"]
    table.write(items(spark, ("create", "z", None, "{}")), 1, "n", "ann")
    assert table.read().agg(F.max("seq")).first()[0] == 24


def test_writes_heed_the_catalog(spark, tmp_path):
    T = FieldType
    catalog = Catalog([Definition("s", "ann", "S", {"v": "Integer", "tags": T("Array", (T("String"),))}, file_required=True), Definition("r", "ann", "R", {"v": "Integer"}, primary=Key("hash_range", "String"))])
    catalog.set_ttl("s", "manifest", 7200)
    assert catalog.save(spark, f"file://{tmp_path}/catalog") == 1 and Catalog.load(spark, f"file://{tmp_path}/none").by_name == {}
    loaded = Catalog.load(spark, f"file://{tmp_path}/catalog")
    assert loaded.by_name == catalog.by_name and loaded.ttl("s") == 7200 and loaded.frame(spark, active=True).count() == 2
    table = RecordLog(spark, f"file://{tmp_path}/log")
    for record, name, schema, reason in (('{"v":"x"}', "f", "s", "field"), ('{"w":1}', "f", "s", "field"), ('{"tags":[1]}', "f", "s", "field"), ('{"v":1}', None, "s", "file"), ('{"v":1}', "f", "r", "shape"), ('{"v":1}', "f", "q", "schema")):
        with pytest.raises(write.WriteRefused) as refused:
            table.write(filed(spark, ("create", "a", None, record, name, False)).withColumn("schema", F.lit(schema)), 1, "n", "ann", catalog=loaded)
        assert refused.value.reason == reason
    table.write(filed(spark, ("create", "a", None, '{"v":1,"tags":["x"]}', "f", False)), 1, "n", "ann", catalog=loaded)
    table.write(filed(spark, ("create", "k", None, '{"v":1}', None, False)).withColumns({"schema": F.lit("r"), "range_enc": F.lit("1")}), 1, "n", "ann", catalog=loaded)
    table.drop_schema(loaded, "s", 2, "n", "ann")
    assert [r.schema for r in table.snapshot().collect()] == ["r"] and "s" not in loaded.by_name


def test_files_by_content_and_by_link(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta")):
        (tmp_path / "in" / name).write_text(text)
    contents = spark.createDataFrame([(1, b"alpha"), (2, b"gamma"), (3, b"alpha"), (4, None)], "id long, content binary")
    for _ in range(2):
        files.store(contents, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store").count() == 2
    none = F.lit(None).cast("string")
    rows = contents.select("id", F.when(F.col("content").isNotNull(), files.marker(F.lit("n"), none, F.col("content"))).alias("file"))
    linked = files.links(spark, f"file://{tmp_path}/in").select(F.lit(9).alias("id"), "file")
    assert sorted((r.id, r.content and bytes(r.content)) for r in files.opened(rows, f"file://{tmp_path}/store").collect()) == [(1, b"alpha"), (2, b"gamma"), (3, b"alpha"), (4, None)]
    got = spark.createDataFrame(linked.collect(), linked.schema)
    (tmp_path / "in" / "b.txt").write_text("changed")
    assert sorted((r.file.name, r.content and bytes(r.content)) for r in files.opened(got, f"file://{tmp_path}/store").collect()) == [("a.txt", b"alpha"), ("b.txt", None)]


def test_jobs_run_by_the_period(spark):
    runs = []
    stream = feeds.every(spark, "1 second", runs.append).start()
    for _ in range(100):
        if len(runs) > 1:
            break
        time.sleep(0.2)
    stream.stop()
    assert runs[:2] == [0, 1]


def test_change_pages(spark):
    rows = spark.createDataFrame([(i, "s" if i % 3 else "t", str(i), "", False) for i in range(1, 31)], "seq long, schema string, hash string, range_enc string, deleted boolean")
    assert log.page_state(rows, 0, 10) == {"head": 30, "through": 10, "gap": False}
    assert log.page_state(rows, 25, 10) == {"head": 30, "through": 30, "gap": False}
    assert log.page_state(rows, 30, 10) == {"head": 30, "through": 30, "gap": False}
    assert log.page_state(rows, 31, 10)["gap"] and log.page_state(rows, 1, 10, history=5)["gap"]
    assert [r.seq for r in log.change_page(rows, 0, 3, ["t"]).collect()] == [3] and log.change_page(rows, 3, 2, ["t"]).count() == 0
    assert log.change_page(rows, 0, 0).count() == 0


def test_expiry(spark):
    rows = [(1, "h", "a", "", False, 10), (2, "h", "a", "", False, 90), (3, "h", "b", "", False, 20), (4, "r", "c", f"{15:020d}/x", False, 99), (5, "r", "d", f"{95:020d}", False, 1), (6, "r", "e", "word", False, 1), (7, "h", "f", "", True, 1)]
    events = spark.createDataFrame([(*r[:5], r[5] * log.NANOS) for r in rows], "seq long, schema string, hash string, range_enc string, deleted boolean, written_nanos long")
    policies = spark.createDataFrame([("h", "Hash", 50), ("r", "HashRange", 50)], "schema string, layout string, ttl_seconds long")
    swept = log.sweep(events, policies, 100)
    assert sorted(r.hash for r in swept.collect()) == ["b", "c"]
    later = events.union(spark.createDataFrame([(8, "h", "b", "", False, 100 * log.NANOS)], events.schema))
    assert [r.hash for r in log.still_expired(swept, later).collect()] == ["c"]


def test_a_run_of_tombstones(spark):
    ids = spark.range(12_000).selectExpr("id + 1 AS seq", "'s' AS schema", "'h' AS hash", "lpad(id, 6, '0') AS range_enc", "false AS deleted")
    gone = ids.where("seq BETWEEN 2 AND 11999").selectExpr("seq + 20000 AS seq", "schema", "hash", "range_enc", "true AS deleted")
    live = log.snapshot(ids.union(gone)).withColumn("range", F.col("range_enc"))
    rows, cursor = read.read_page(live, "s", read.Filter(hash="h"), 1)
    more, end = read.read_page(live, "s", read.Filter(hash="h"), 1, cursor)
    assert [r["range_enc"] for r in rows + more] == ["000000", "011999"] and end is None


# catalog ----------------------------------------------------------------------------------------------------------------
def test_catalog():
    d = Definition("notes", "ann", "My Notes", {"title": "String", "n": "Any"}, {"title": "what it is called"})
    c = Catalog()
    assert c.declare(d) == "install" and c.declare(d) == "same"
    grown = Definition("notes", "ann", "My Notes", {**d.fields, "more": "Integer"}, d.descriptions)
    assert c.declare(grown) == "install" and c.declare(d) == "reuse"
    assert evolve(d, Definition("notes", "ann", "My Notes", {"title": "String", "n": "Integer"}, d.descriptions)) == "install"
    for wrong in (
        Definition("notes", "ann", "My Notes", {"title": "Integer"}),
        Definition("notes", "bob", "My Notes", grown.fields),
        Definition("notes", "ann", "My Notes", grown.fields, primary=Key("hash_range", "String")),
        Definition("x", "ann", "X", {"bad name": "String"}),
        Definition("x", "ann", "X", {"a": ""}),
        Definition("x", "ann", "X", {"a": "String"}, primary=Key("hash_range")),
        Definition("x", "ann", "X", {"a": "String"}, primary=Key("single")),
    ):
        with pytest.raises(CatalogRefused):
            c.declare(wrong)
    for name in ("notes", grown.identity(), "ann/notes", "My Notes", " My Notes ", "my notes"):
        assert c.resolve(name) == grown
    assert d.identity() != grown.identity() and grown.identity() == Definition("other", "ann", "My Notes", dict.fromkeys(grown.fields, "Any")).identity()
    c.declare(Definition("n2", "ann", "My Notes", {"a": "String"}))
    with pytest.raises(CatalogRefused):
        c.resolve("My Notes")
    c.set_ttl("notes", "manifest", 7200)
    with pytest.raises(CatalogRefused):
        c.set_ttl("notes", "operator", 60)
    c.set_ttl("notes", "operator", 60, confirm=True)
    assert c.ttl("notes") == 60
    c.set_ttl("notes", "operator", None)
    assert c.ttl("notes") == 7200
    with pytest.raises(CatalogRefused):
        c.set_ttl("notes", "manifest", 10)
    c.block("notes")
    with pytest.raises(CatalogRefused):
        c.readable("notes")
    c.drop("notes")
    with pytest.raises(CatalogRefused):
        c.resolve("notes")


# version counts ---------------------------------------------------------------------------------------------------------
def test_version_counts_need_no_table_of_keys_and_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(log, "SORTED_ROWS", 50)
    r = random.Random(8)
    rows = [("s", None if r.random() < 0.05 else str(int(r.paretovariate(0.7))), r.choice(["", "a"]), i, r.random() < 0.3) for i in r.sample(range(5000), 600)]
    want = {}
    for s, h, g, _, dead in sorted(rows, key=lambda x: x[3]):
        n = want.setdefault((s, h, g), [0, 0, 0, 0, True])
        n[0] += 1
        if not dead:
            n[1 if n[4] else 2] += 1
        elif not n[4]:
            n[3] += 1
        n[4] = dead
    frame = spark.createDataFrame(rows, "schema string, hash string, range_enc string, seq long, deleted boolean")
    other = frame.select("schema", "hash", "range_enc", "deleted", F.expr("seq div 10").alias("at"), F.expr("seq % 10").alias("then"))
    for got in (log.version_counts(frame), log.version_counts(other, order=["at", "then"])):
        assert got.columns == ["schema", "hash", "range_enc", "versions", "created", "updated", "deletes"]
        assert {tuple(x)[:3]: list(x)[3:] for x in got.collect()} == {k: n[:4] for k, n in want.items()} and got.count() == len(want)
        plan = got._jdf.queryExecution().toString()
        assert "HashAggregate" not in plan.split("Physical Plan")[1] and "REPARTITION_BY_NUM" in plan and ", 12)" in plan
    assert log.version_counts(frame.limit(0)).count() == 0


# streaming --------------------------------------------------------------------------------------------------------------
def test_windows_drop_late_rows_and_duplicates(spark, tmp_path):
    schema = "entry_hash string, ts timestamp, value long"
    os.makedirs(f"{tmp_path}/in")
    stream = feeds.distinct_entries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), "ts", "10 minutes")
    q = stream.writeStream.format("memory").queryName("distinct_entries").option("checkpointLocation", f"{tmp_path}/cp").start()
    for i, lines in enumerate((["a 00:01", "a 00:01", "b 00:02"], ["c 02:00"], ["e 02:05", "c 02:00"], ["d 00:03"])):
        with open(f"{tmp_path}/in/{i}.json", "w") as f:
            f.writelines(f'{{"entry_hash":"{h}","ts":"2024-01-01T{t}:00Z","value":1}}\n' for h, t in map(str.split, lines))
        q.processAllAvailable()
    q.stop()
    assert sorted(r.entry_hash for r in spark.table("distinct_entries").collect()) == ["a", "b", "c", "e"]


# the contract of the entry module ---------------------------------------------------------------------------------------
def test_stands_without_the_training_data_operators(tmp_path):
    for name in ("keylake", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "keylake/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q), len(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr
