import random

import pytest
from pyspark.sql import functions as F

from keylake.operators import advice, report, sync

ENTRY = (
    "database_id string, node_key string, device_id string, writer_seq long, prev_hash string, lamport long, seen_heads array<string>, kind string, stream string, "
    "role string, grantee string, cutoffs array<struct<device_id:string,writer_seq:long>>, grant_device string, grant_seq long, incorporated boolean, entry_hash string, signature_valid boolean, arrival long"
)


class Log:
    """Builds entries as a test reads: each stream's chain and the Lamport times are filled in."""

    def __init__(self):
        self.rows, self.heads, self.lamports = [], {}, {}

    def add(self, node, kind="data", seen=(), device="d", stream="direct", role=None, grantee=None, cutoffs=None, grant=None, incorporated=None, **wrong):
        seq, prev, l = self.heads.get((node, device), (0, "", 0))
        lamport = 1 + max([l, *[self.lamports[h] for h in seen if h in self.lamports]])
        row = {
            "database_id": "db", "node_key": node, "device_id": device, "writer_seq": seq + 1, "prev_hash": prev, "lamport": lamport, "seen_heads": list(seen), "kind": kind, "stream": stream, "role": role, "grantee": grantee,
            "cutoffs": cutoffs or [], "grant_device": grant and "d", "grant_seq": grant, "incorporated": incorporated, "entry_hash": f"{node}{device}{seq + 1}", "signature_valid": True, "arrival": len(self.rows),
        } | wrong
        self.rows.append(row)
        self.heads[node, device] = (row["writer_seq"], row["entry_hash"], row["lamport"])
        self.lamports[row["entry_hash"]] = row["lamport"]
        return row["entry_hash"]

    def outcomes(self, spark, rows=None):
        names = [c.split()[0] for c in ENTRY.split(", ")]
        frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows or self.rows], ENTRY)
        return {r.entry_hash: r.outcome if r.outcome != "rejected" else r.reason for r in sync.accept(frame, lambda df: df.cache()).collect()}


def started():
    log = Log()
    log.add("o", "birth", grantee="o")
    grant = log.add("o", "grant", role="write", grantee="m")
    return log, grant


def test_a_good_log_is_accepted_in_any_order(spark):
    log, grant = started()
    a = log.add("m", seen=[grant], grant=2)
    log.add("m", seen=[grant], grant=2)
    log.add("o", seen=[a])
    want = {r["entry_hash"]: "accepted" for r in log.rows}
    assert log.outcomes(spark) == want
    shuffled = log.rows[::-1] + log.rows[:2]
    random.Random(1).shuffle(shuffled)
    assert log.outcomes(spark, shuffled) == want


def test_acceptance_writes_whole_entries_once(spark):
    log, grant = started()
    a = log.add("m", seen=[grant], grant=2)
    b = log.add("n", seen=[a, "lost"])  # no grant, and waits
    c = log.add("o", seen=[b])  # waits one hop on
    d = log.add("o")
    log.add("m", seen=[grant, d], grant=2)  # and two
    forged = log.add("o", device="e", seen=["lost"], signature_valid=False)
    names = [x.split()[0] for x in ENTRY.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in log.rows], ENTRY).withColumn("payload", F.repeat("entry_hash", 1000))
    tables = []

    def cut(df):
        tables.append(df.columns)
        return df.cache()

    got = sync.accept(frame, cut)
    assert got.columns == [*frame.columns, "outcome", "reason"]
    assert {r.entry_hash: (r.outcome, r.reason) for r in got.collect()} == {
        "od1": ("accepted", None), "od2": ("accepted", None), a: ("accepted", None), b: ("pending", None), c: ("pending", None), d: ("pending", None), "md2": ("pending", None), forged: ("rejected", "signature")
    }
    assert sum("payload" in names for names in tables) == 1 and sum("prev_hash" in names for names in tables) == 1


def test_what_is_rejected(spark):
    log, grant = started()
    log.add("x", seen=[grant], grant=2)  # no grant to x
    log.add("m", grant=2)  # names a grant that it hasn't seen
    log.add("m", seen=[grant], device="e", grant=2, lamport=99)
    log.add("m", seen=[grant], device="f", grant=2, signature_valid=False)
    log.add("m", "grant", seen=[grant], device="g", role="write", grantee="x")
    log.add("m", seen=[grant], device="h", stream="proposal")
    log.add("o", seen=[])
    log.rows.append(log.rows[-1] | {"entry_hash": "other", "arrival": 99})
    assert log.outcomes(spark) == {
        "od1": "accepted", "od2": "accepted", "xd1": "unauthorised", "md1": "unauthorised", "me1": "lamport", "mf1": "signature", "mg1": "unauthorised", "mh1": "accepted", "od3": "accepted", "other": "equivocation",
    }


def test_what_waits(spark):
    log, grant = started()
    lost = log.add("o")
    late = log.add("o")
    on_late = log.add("m", seen=[grant, late], grant=2)
    after = log.add("m", seen=[grant], grant=2)
    free = log.add("m", seen=[grant], device="e", grant=2)
    rows = [r for r in log.rows if r["entry_hash"] != lost]
    got = log.outcomes(spark, rows)
    assert got == {"od1": "accepted", "od2": "accepted", late: "pending", on_late: "pending", after: "pending", free: "accepted"}
    assert set(log.outcomes(spark).values()) == {"accepted"}


def test_cutoffs_after_a_reduction(spark):
    log, grant = started()
    early = log.add("m", seen=[grant], grant=2)
    cut = log.add("o", "grant", seen=[early], role="read", grantee="m", cutoffs=[("d", 1)])
    past = log.add("m", seen=[grant], grant=2)
    other = log.add("m", seen=[grant], device="e", grant=2)
    got = log.outcomes(spark)
    assert (got[early], got[cut], got[past], got[other]) == ("accepted", "accepted", "unauthorised", "unauthorised")


def test_grants_fold(spark):
    rows = [("db", "a", "write", 1, "o", "d", "1"), ("db", "a", "revoked", 2, "o", "d", "2"), ("db", "b", "read", 5, "o", "d", "3"), ("db", "b", "revoked", 5, "o", "d", "4"), ("db", "c", "read", 1, "o", "d", "5"), ("db", "c", "write", 2, "o", "d", "6")]
    g = spark.createDataFrame([(*r, [("x", 7)]) for r in rows], "database_id string, grantee string, role string, lamport long, node_key string, device_id string, entry_hash string, cutoffs array<struct<device_id:string,writer_seq:long>>")
    assert {r.grantee: r.role for r in sync.roles(g).collect()} == {"a": "revoked", "b": "revoked", "c": "write"}
    assert {(r.node_key, r.device_id, r.cutoff) for r in sync.cutoffs(g).collect()} == {("a", "x", 7), ("b", "x", 7)}


def test_winners_do_not_depend_on_arrival(spark):
    r = random.Random(2)
    rows = [("n", str(r.randint(0, 9)), r.randint(1, 4), r.choice("ab"), r.choice("xy"), str(i)) for i in range(200)]
    unique = list({(k, l, n, d): (ns, k, l, n, d, v) for ns, k, l, n, d, v in rows}.values())
    names = "namespace string, key string, lamport long, node_key string, device_id string, value string"
    want = {}
    for row in unique:
        if row[1] not in want or row[2:5] > want[row[1]][2:5]:
            want[row[1]] = row
    for order in (unique, unique[::-1]):
        assert {x.key: tuple(x) for x in sync.lww(spark.createDataFrame(order, names)).collect()} == want


def test_bundles_outbox_and_relay(spark):
    pack = lambda k: len(k).to_bytes(2, "big") + k.encode() + b"v"
    rows = [("ok", [("a", pack("1")), ("a", pack("2"))]), ("twice", [("a", pack("1")), ("a", pack("1"))]), ("unsorted", [("b", pack("1")), ("a", pack("1"))])]
    b = spark.createDataFrame(rows, "entry_hash string, changes array<struct<namespace:string,payload:binary>>")
    assert sorted((r.entry_hash, bytes(r.payload)[2:3]) for r in sync.unpacked(b).collect()) == [("ok", b"1"), ("ok", b"2")]
    q = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], "entry_hash string, queued_at long")
    sent = spark.createDataFrame([("b",)], "entry_hash string")
    assert [tuple(r) for r in sync.outbox(q, sent).orderBy("queued_at").collect()] == [("a", 1), ("c", 4)]
    held = spark.createDataFrame([("db", "n", "d", 1, "h1")], "database_id string, node_key string, device_id string, writer_seq long, entry_hash string")
    page = spark.createDataFrame([("db", "n", "d", 1, "h1"), ("db", "n", "d", 2, "h2"), ("db", "n", "d", 1, "hx")], held.schema)
    assert {r.entry_hash: r.outcome for r in sync.append_page(page, held).collect()} == {"h1": "duplicate", "h2": "new", "hx": "conflict"}


# reports and advice -----------------------------------------------------------------------------------------------------
def test_nearest_rank_and_caps(spark):
    rows = spark.createDataFrame([("a", v) for v in [5, 1, 3, 3, None]] + [("b", 9)], "k string, v int")
    got = {r.k: (r.samples, r.p50, r.p99) for r in report.nearest_rank(rows, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (4, 3, 5), "b": (1, 9, 9)}
    events = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("x", 4), ("w", 5)], "k string, t int")
    assert {r.k: r.n for r in report.capped(events, "k", "t", 2).collect()} == {"x": 2, "y": 1, report.OVERFLOW: 2}


def test_names_and_descriptions(spark):
    def of(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    assert of(advice.normal_name, "fileMimeType") == "file_media_type" and of(advice.normal_name, "idPerson") == "person_id" and of(advice.normal_name, "HTTPServer_ms") == "http_server_milliseconds"
    pair = spark.createDataFrame([("The size of a file in bytes", "size file in byte")], "a string, b string")
    assert pair.select(advice.descriptions_agree(F.col("a"), F.col("b"))).first()[0]
    fault = lambda n: of(lambda c: advice.name_fault(c, ["id", "of"], ["psi", "qty"]), n)
    assert [fault(n) for n in ("file_size_bytes", "", "File_size", "size", "file_x", "file_qq", "item_size", "order_qty", "tire_pressure_psi")] == [None, "length", "form", "one concept", "one letter", "short word", "vague", "abbreviation", None]


@pytest.fixture(scope="module")
def vocabulary(spark):
    rows = [("file_size_bytes", "Integer", "size of a file in bytes", 1), ("created_at_time", "DateTime", "when the thing was made", 1), ("file_media_type", "String", "media type of a file", 2), ("person_id", "String", "stable opaque identifier of a person", 1)]
    return spark.createDataFrame(rows, "name string, type string, description string, version int")


def test_findings(spark, vocabulary):
    drafts = spark.createDataFrame(
        [("d", "file_size_bytes", "String", None, None), ("d", "fileSizeByte", "Integer", None, None), ("d", "mime_type", None, None, None), ("d", "extent", "Integer", "the size of file in byte", None), ("d", "updated_at_time", "DateTime", "when the thing was made", None), ("d", "person_id", "String", "stable opaque identifier of a person", 1)],
        "draft string, name string, type string, description string, version int",
    )
    near = {(r.name, r.other, r.score) for r in advice.near_matches(drafts, vocabulary).collect()}
    assert near == {("fileSizeByte", "file_size_bytes", 2), ("mime_type", "file_media_type", 2), ("extent", "file_size_bytes", 1)}  # created and updated conflict
    own = {(r.name, r.kind, r.differs, r.exact) for r in advice.canonical_findings(drafts, vocabulary).collect()}
    assert own == {("file_size_bytes", "same_name_different_meaning", "type", False), ("person_id", "canonical_match", "", True)}
    assert {(r.name, r.suggested_type) for r in advice.missing_types(drafts, vocabulary).collect()} == {("mime_type", "String")}


def test_similar_schemas_and_faults(spark, vocabulary):
    fields = spark.createDataFrame([(s, f) for s, fs in {"a": "xyz", "b": "xyq", "c": "x", "d": "xyzw"}.items() for f in fs], "schema string, field string")
    got = {(r.schema, r.other, r.shared, r.score, r.place) for r in advice.similar_schemas(fields).collect()}
    assert got == {("a", "d", 3, 768, 1), ("a", "b", 2, 512, 2), ("b", "a", 2, 512, 1), ("b", "d", 2, 409, 2), ("d", "a", 3, 768, 1), ("d", "b", 2, 409, 2)}
    assert advice.vocabulary_faults(vocabulary).count() == 0
    worse = vocabulary.union(spark.createDataFrame([("person_id", "String", "too short", 1), ("other_name", "String", "Size of a file, in BYTES", 1)], vocabulary.schema))
    assert {(r.name, r.fault) for r in advice.vocabulary_faults(worse).collect()} == {("person_id", "name"), ("person_id", "description"), ("other_name", "duplicate"), ("file_size_bytes", "duplicate")}
    policy = spark.createDataFrame([("n", None), ("m", "a")], "namespace string, field string")
    shared = spark.createDataFrame([("n", "q"), ("m", "a"), ("m", "b"), ("z", "a")], "namespace string, field string")
    assert sorted(map(tuple, advice.admitted(shared, policy).collect())) == [("m", "a"), ("n", "q")]
