"""Keyed reads of a record table: points, key sets, partitions, prefixes, ranges, alternates, pages.

A record table has columns `hash`, `range` (text, empty for hash layouts), `range_enc` (the range encoded so that text order
is typed order) and record fields. All reads are predicates or joins on these; selective ones push down to Parquet. Page
order is range first, then hash; tables keyed by hash alone order by hash. A table may be huge, a page never is.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.functions.codec import prefix_end

RECORD_LIMIT, RECORD_LIMIT_MOST, KEY_LIMIT, KEY_LIMIT_MOST, READS_MOST = 100, 1000, 100, 1000, 64
KEYS = ["hash", "range", "range_enc"]
RESERVED = ("created_by", "updated_by")


class ReadRefused(ValueError):
    """A request that names no key filter, or combines what cannot be combined."""


class CursorMismatch(ValueError):
    """A cursor made for another schema, filter or order."""


class CountMismatch(ValueError):
    """The records under a filter are not as many as the caller expects."""


class IndexMismatch(ValueError):
    """An entry of an alternate index that its record does not bear out."""


@dataclass(frozen=True)
class Filter:
    """One key filter: a hash alone, a hash with a range, a prefix or bounds [start, end) of encoded ranges."""

    hash: str | None = None
    range: str | None = None
    prefix: str | None = None
    start: str | None = None
    end: str | None = None

    def check(self, range_kind: str | None = "String") -> None:
        if all(v is None for v in asdict(self).values()):
            raise ReadRefused("name a key: hash, hash with range, prefix or bounds; or list keys by page")
        if self.prefix is not None and range_kind != "String":
            raise ReadRefused("a prefix needs a String range")
        if sum(x is not None for x in (self.range, self.prefix)) + (self.start is not None or self.end is not None) > 1:
            raise ReadRefused("give one of range, prefix and bounds")

    def column(self) -> Column:
        out = F.lit(True) if self.hash is None else F.col("hash") == self.hash
        if self.range is not None:
            out &= F.col("range_enc") == self.range
        if self.prefix is not None:
            out &= F.col("range_enc").startswith(self.prefix)
            if (end := prefix_end(self.prefix)) is not None:  # bounds prune row groups where startswith alone may not
                out &= (F.col("range_enc") >= self.prefix) & (F.col("range_enc") < end)
        if self.start is not None:
            out &= F.col("range_enc") >= self.start
        if self.end is not None:
            out &= F.col("range_enc") < self.end
        return out


    def holds(self, hash_: str, range_enc: str) -> bool:
        """Whether a key is under the filter (code point order is the order of text in Spark)."""
        bounds = (self.start is None or range_enc >= self.start) and (self.end is None or range_enc < self.end)
        return bounds and self.hash in (None, hash_) and self.range in (None, range_enc) and range_enc.startswith(self.prefix or "")


def select(records: DataFrame, key: Filter, range_kind: str | None = "String") -> DataFrame:
    """Records under a filter. Bounds that hold nothing (start at or past end) give no rows without a scan."""
    key.check(range_kind)
    if key.start is not None and key.end is not None and key.start >= key.end:
        return records.limit(0)
    return records.where(key.column())


def by_keys(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records at any of the keys (hash, range_enc), each once however often it is asked for.

    Spark broadcasts the key set if it is small and shuffles both sides by key if not.
    """
    return records.join(keys.select("hash", "range_enc").distinct(), ["hash", "range_enc"], "left_semi")


def absent_keys(keys: DataFrame, records: DataFrame) -> DataFrame:
    """Keys asked for that have no record."""
    return keys.select("hash", "range_enc").distinct().join(records, ["hash", "range_enc"], "left_anti")


def keys_only(records: DataFrame) -> DataFrame:
    return records.select("hash", "range")


def page_order(descending: bool = False) -> list[Column]:
    """Typed range, then hash; a descending read turns the range alone round."""
    return [F.desc("range_enc") if descending else F.asc("range_enc"), F.asc("hash")]


def after(hash_: str, range_enc: str) -> Column:
    """Strictly past a key in page order."""
    return (F.col("range_enc") > range_enc) | ((F.col("range_enc") == range_enc) & (F.col("hash") > hash_))


def page(records: DataFrame, limit: int = RECORD_LIMIT, offset: int = 0, cursor: tuple[str, str] | None = None, descending: bool = False) -> DataFrame:
    """One page in page order. A cursor is the (hash, range_enc) of the last record seen."""
    if not 0 <= limit <= RECORD_LIMIT_MOST:
        raise ReadRefused(f"a page has at most {RECORD_LIMIT_MOST} records")
    if cursor and (descending or offset):
        raise ReadRefused("a cursor goes with ascending order and no offset")
    return _ordered(records, limit, offset, cursor, descending)


def _ordered(records: DataFrame, limit: int, offset: int = 0, cursor: tuple[str, str] | None = None, descending: bool = False) -> DataFrame:
    rows = records.where(after(*cursor)) if cursor else records
    rows = rows.orderBy(*page_order(descending))
    return (rows.offset(offset) if offset else rows).limit(limit)


def key_page(records: DataFrame, limit: int = KEY_LIMIT, cursor: tuple[str, str] | None = None) -> DataFrame:
    """One page of all live keys, by hash and then range: the only read without a filter."""
    if not 1 <= limit <= KEY_LIMIT_MOST:
        raise ReadRefused(f"a key page has 1 to {KEY_LIMIT_MOST} keys")
    rows = records
    if cursor:
        rows = rows.where((F.col("hash") > cursor[0]) | ((F.col("hash") == cursor[0]) & (F.col("range_enc") > cursor[1])))
    return rows.orderBy("hash", "range_enc").limit(limit).select("hash", "range")


def may_hold_records(records: DataFrame) -> bool:
    return not records.limit(1).isEmpty()


def holding(schemas: DataFrame, records: DataFrame) -> DataFrame:
    """The existence probe for many schemas at once: schema, holds."""
    some = records.select("schema").distinct()
    return schemas.select("schema").distinct().join(some.withColumn("_found", F.lit(True)), "schema", "left").select("schema", F.col("_found").isNotNull().alias("holds"))


def counted(records: DataFrame, key: Filter, expected: int | None = None, range_kind: str | None = "String") -> int:
    """Number of records under a filter; CountMismatch if the caller expects another."""
    n = select(records, key, range_kind).count()
    if expected not in (None, n):
        raise CountMismatch(f"expected {expected} records, there are {n}")
    return n


def binding(schema_id: str, key: Filter, descending: bool = False) -> str:
    """What a cursor is bound to: schema, filter and order."""
    return hashlib.sha256(json.dumps([schema_id, asdict(key), descending], sort_keys=True).encode()).hexdigest()


def cursor_text(bound: str, *key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"b": bound, "k": key}).encode()).decode().rstrip("=")


def cursor_key(text: str, bound: str, parts: int = 2) -> tuple[str, ...]:
    """The key that a cursor resumes after; refuses one of another request."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        key = tuple(found["k"])
        if found["b"] != bound:
            raise CursorMismatch("this cursor belongs to another schema, filter or order")
        if len(key) != parts or not all(isinstance(k, str) for k in key):
            raise CursorMismatch("this is no cursor")
        return key
    except (ValueError, KeyError, TypeError) as error:
        raise error if isinstance(error, CursorMismatch) else CursorMismatch("this is no cursor") from error


def read_page(records: DataFrame, schema_id: str, key: Filter, limit: int = RECORD_LIMIT, cursor: str | None = None, descending: bool = False, range_kind: str | None = "String", expected: int | None = None) -> tuple[list, str | None]:
    """A page of records as rows, and the cursor for the next one (None at the end): one record more than asked for tells.

    A larger limit counts as RECORD_LIMIT_MOST. With expected, the count under the filter must be that.
    """
    limit = max(0, min(limit, RECORD_LIMIT_MOST))
    bound = binding(schema_id, key, descending)
    start = cursor_key(cursor, bound) if cursor else None
    if start and descending:
        raise ReadRefused("a cursor goes with ascending order and no offset")
    if expected is not None:
        counted(records, key, expected, range_kind)
    rows = _ordered(select(records, key, range_kind), limit + 1, cursor=start, descending=descending).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, cursor_text(bound, rows[-1]["hash"], rows[-1]["range_enc"]) if more and rows and not descending else None


def read_list(records: DataFrame, reads: list[tuple[str, Filter, int]], kinds: dict[str, str | None] | None = None) -> list[dict]:
    """Answers of up to READS_MOST reads (schema, filter, limit), in their order, by one job: {rows, more}, or {error} for a read refused.

    records has a column schema; kinds gives a schema's range type (String where it doesn't).
    """
    if not 1 <= len(reads) <= READS_MOST:
        raise ReadRefused(f"a list holds 1 to {READS_MOST} reads")
    out: list[dict] = [{"rows": [], "more": False} for _ in reads]
    for i, (schema, key, _) in enumerate(reads):
        try:
            key.check((kinds or {}).get(schema, "String"))
        except ReadRefused as error:
            out[i] = {"error": str(error)}
    fine = [(i, s, k, max(0, min(n, RECORD_LIMIT_MOST))) for i, (s, k, n) in enumerate(reads) if "error" not in out[i]]
    if fine:
        for row in listed(records, fine, 1).orderBy("item", "place").collect():
            out[row["item"]]["rows"].append(row)
    for i, _, _, n in fine:
        out[i] = {"rows": out[i]["rows"][:n], "more": len(out[i]["rows"]) > n}
    return out


def listed(records: DataFrame, reads: list[tuple[int, str, Filter, int]], extra: int = 0) -> DataFrame:
    """Pages of several reads (item, schema, filter, limit) in one plan: item, place (from 1) and the record; `extra` records beyond each limit."""
    pages = []
    for item, schema, key, limit in reads:
        page_ = _ordered(records.where(F.col("schema") == schema).where(key.column()), limit + extra)
        pages.append(page_.select(F.lit(item).alias("item"), "*"))
    order = Window.partitionBy("item").orderBy(*page_order())
    return reduce(DataFrame.unionByName, pages).withColumn("place", F.row_number().over(order))


# alternates -----------------------------------------------------------------------------------------------------------


def alternate_index(records: DataFrame, name: str) -> DataFrame:
    """The index of a named alternate: its key, then the primary key. Records without that alternate are not in it.

    records has `alternates`, a map of name to struct<hash, range_enc>.
    """
    alt = F.col("alternates")[name]
    return records.where(alt.isNotNull()).select(alt["hash"].alias("alt_hash"), alt["range_enc"].alias("alt_range_enc"), "hash", "range_enc")


def by_alternate(index: DataFrame, records: DataFrame, key: Filter, range_kind: str | None = "String") -> DataFrame:
    """Records whose alternate key is under a filter, with that key."""
    return _entries(index, key, range_kind).join(records, ["hash", "range_enc"])


def alternate_after(alt_hash: str, alt_range_enc: str, hash_: str, range_enc: str) -> Column:
    """Strictly past an entry in the order of alternate pages: its key, then the primary key."""
    out = F.lit(False)
    for name, value in reversed(list(zip(ALT_ORDER, (alt_range_enc, alt_hash, range_enc, hash_), strict=True))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


ALT_ORDER = ["alt_range_enc", "alt_hash", "range_enc", "hash"]


def _entries(index: DataFrame, key: Filter, range_kind: str | None) -> DataFrame:
    if key.range is not None and key.hash is None:
        raise ReadRefused("an alternate takes one key, a hash, a prefix or bounds")
    found = select(index.withColumnsRenamed({"hash": "p_hash", "range_enc": "p_range_enc", "alt_hash": "hash", "alt_range_enc": "range_enc"}), key, range_kind)
    return found.withColumnsRenamed({"hash": "alt_hash", "range_enc": "alt_range_enc", "p_hash": "hash", "p_range_enc": "range_enc"})


def alternate_page(index: DataFrame, records: DataFrame, key: Filter, limit: int = RECORD_LIMIT, start: tuple[str, str, str, str] | None = None, range_kind: str | None = "String") -> DataFrame:
    """One page in the order of an alternate, with its records (null where there is none). start: the last entry seen (alt_hash, alt_range_enc, hash, range_enc).

    The index alone is filtered, sorted and cut; the records of at most limit keys are then looked up.
    """
    found = _entries(index, key, range_kind)
    found = (found.where(alternate_after(*start)) if start else found).orderBy(*ALT_ORDER).limit(limit)
    held = records.select("hash", "range_enc", F.struct(*records.columns).alias("found"))
    return found.join(held, ["hash", "range_enc"], "left").select("alt_hash", "alt_range_enc", "hash", "range_enc", "found").orderBy(*ALT_ORDER)


def read_alternate_page(index: DataFrame, records: DataFrame, schema_id: str, name: str, key: Filter, limit: int = RECORD_LIMIT, cursor: str | None = None, range_kind: str | None = "String") -> tuple[list, str | None]:
    """A page of records in the order of a named alternate, each a row with alt_hash, alt_range_enc and `found`, and the next cursor.

    Records must have `alternates`; an entry that its record does not bear out is an IndexMismatch. A cursor is bound to
    schema, alternate and filter, and its entry must be under the filter.
    """
    limit = max(0, min(limit, RECORD_LIMIT_MOST))
    bound = "ak2:" + binding(json.dumps([schema_id, name]), key)
    start = cursor_key(cursor, bound, 4) if cursor else None
    if start and not key.holds(start[0], start[1]):
        raise CursorMismatch("this cursor lies outside the filter")
    rows = alternate_page(index, records, key, limit + 1, start, range_kind).collect()
    more, rows = len(rows) > limit, rows[:limit]
    for r in rows:
        own = (r["found"]["alternates"] or {}).get(name) if r["found"] else None
        if own is None or (own["hash"], own["range_enc"]) != (r["alt_hash"], r["alt_range_enc"]):
            raise IndexMismatch(f"the entry of {name} at {r['alt_hash']!r}, {r['alt_range_enc']!r} does not match its record")
    return rows, cursor_text(bound, *(rows[-1][c] for c in ("alt_hash", "alt_range_enc", "hash", "range_enc"))) if more and rows else None


def index_faults(index: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Entries of an index that no record bears out, and alternates of records that the index lacks."""
    true = alternate_index(records, name)
    columns = ["alt_hash", "alt_range_enc", "hash", "range_enc"]
    same = [index[c].eqNullSafe(true[c]) for c in columns]
    spare = index.join(true, same, "left_anti").select(*columns, F.lit("spare").alias("fault"))
    return spare.union(true.join(index, same, "left_anti").select(*columns, F.lit("missing").alias("fault")))


# shapes ---------------------------------------------------------------------------------------------------------------


def full_rows(records: DataFrame, fields: list[str]) -> DataFrame:
    """Key, revision, authors, alternates and a struct of fields."""
    carried = [c for c in ("revision", *RESERVED, "alternates") if c in records.columns]
    return records.select(F.struct("hash", "range").alias("key"), *carried, F.struct(*fields).alias("fields"))


def api_rows(records: DataFrame, fields: list[str]) -> DataFrame:
    """Key, revision, the record as JSON (absent authors are left out), and the file marker if records have one."""
    authors = [c for c in RESERVED if c in records.columns]
    file = [c for c in ("file",) if c in records.columns]
    return records.select(F.struct("hash", "range").alias("key"), "revision", F.to_json(F.struct(*fields, *authors)).alias("record"), *file)


def user_fields(fields: Column) -> Column:
    """A map of fields without the reserved ones."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*RESERVED))


def granted(items: DataFrame, grants: DataFrame, wants: str) -> DataFrame:
    """Items (caller, schema) that a grant of that kind (read or write) allows, by schema name or for all schemas (*)."""
    allowed = grants.where(F.col("access") == wants).select("caller", F.col("schema").alias("granted"))
    named = items.join(allowed.distinct(), (items["caller"] == allowed["caller"]) & (items["schema"] == allowed["granted"]), "left_semi")
    every = allowed.where("granted = '*'").select("caller").distinct()
    return named.unionByName(items.join(every, "caller", "left_semi").join(allowed.select(F.col("caller").alias("c"), "granted").distinct(), (F.col("caller") == F.col("c")) & (F.col("schema") == F.col("granted")), "left_anti"))
