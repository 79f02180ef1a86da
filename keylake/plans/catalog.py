"""Schema definitions: identity, evolution, state, name resolution, retention policies. A catalog is small and lives on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions.types import FieldType

RANGE_KINDS = ("String", "Integer", "Date", "DateTime", "Boolean")
RESERVED = ("created_by", "updated_by")
ALTERNATES_MOST, HOUR, DAY = 16, 3600, 86400
TTL_LEAST, TTL_MOST = HOUR, 3650 * DAY


class CatalogRefused(ValueError):
    """A definition, change or name that the catalog doesn't take; code as an HTTP status would be."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Key:
    """A hash key, or a hash and typed range key."""

    kind: str = "hash"
    range_kind: str | None = None
    allow_absent: bool = False

    def check(self) -> None:
        if self.kind not in ("hash", "hash_range"):
            raise CatalogRefused(f"layout {self.kind} can't be used")
        if (self.range_kind is not None) != (self.kind == "hash_range"):
            raise CatalogRefused("a hash_range key has a range type, a hash key has none")
        if self.range_kind and self.range_kind not in RANGE_KINDS:
            raise CatalogRefused(f"{self.range_kind} can't be a range")


@dataclass(frozen=True)
class Definition:
    name: str
    owner: str
    descriptive_name: str
    fields: dict[str, str | FieldType]
    descriptions: dict[str, str] = field(default_factory=dict)
    primary: Key = field(default_factory=Key)
    alternates: dict[str, Key] = field(default_factory=dict)
    file_required: bool = False
    blocked: bool = False

    def check(self) -> None:
        self.primary.check()
        if len(self.alternates) > ALTERNATES_MOST:
            raise CatalogRefused(f"at most {ALTERNATES_MOST} alternates")
        for k in self.alternates.values():
            k.check()
        for name, kind in self.fields.items():
            if not name or re.search(r"[\s\x00-\x1f\x7f,:]", name) or name in RESERVED:
                raise CatalogRefused(f"bad field name {name!r}")
            if not kind:
                raise CatalogRefused(f"field {name} has no type")

    def types(self) -> dict[str, FieldType]:
        return {n: t if isinstance(t, FieldType) else FieldType(t) for n, t in self.fields.items()}

    def identity(self) -> str:
        """Digest of what makes the schema itself: owner, descriptive name, field names, keys, file rule. Types don't count."""
        keys = {n: [k.kind, k.range_kind, k.allow_absent] for n, k in {"": self.primary, **self.alternates}.items()}
        return _digest([self.owner, self.descriptive_name, sorted(self.fields), keys, self.file_required])

    def portable(self) -> str:
        """Digest of the whole definition."""
        return _digest([self.identity(), self.name, self.fields, self.descriptions])


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=repr).encode()).hexdigest()


def field_hash(name: str, kind: str, description: str, version: int = 1) -> str:
    return _digest([description, name, kind, version])


def evolve(old: Definition, new: Definition) -> str:
    """What re-declaring a schema does: same, reuse (a subset of fields) or install (a superset). Anything else is refused.

    Keys, owner and descriptive name stay; shared fields keep type (Any may become a concrete one) and description.
    """
    for what in ("primary", "alternates", "owner", "descriptive_name", "file_required"):
        if getattr(old, what) != getattr(new, what):
            raise CatalogRefused(f"{what} can't change", 409)
    for name in old.fields.keys() & new.fields.keys():
        if old.fields[name] not in ("Any", new.fields[name]):
            raise CatalogRefused(f"field {name} can't change its type", 409)
        if old.descriptions.get(name, new.descriptions.get(name)) != new.descriptions.get(name, old.descriptions.get(name)):
            raise CatalogRefused(f"field {name} can't change its description", 409)
    if new.fields.keys() == old.fields.keys():
        return "same" if new.fields == old.fields else "install"
    if new.fields.keys() > old.fields.keys():
        return "install"
    if new.fields.keys() < old.fields.keys():
        return "reuse"
    raise CatalogRefused("fields may be added, not removed and added at once", 409)


class Catalog:
    """Definitions by name."""

    def __init__(self, definitions: list[Definition] = ()):  # type: ignore[assignment]
        self.by_name = {d.name: d for d in definitions}
        self.policies: dict[str, dict[str, int]] = {}

    def declare(self, new: Definition) -> str:
        new.check()
        old = self.by_name.get(new.name)
        if old and old.blocked:
            raise CatalogRefused(f"{new.name} is being dropped", 409)
        done = evolve(old, new) if old else "install"
        if done == "install":
            self.by_name[new.name] = new
        return done

    def resolve(self, name: str) -> Definition:
        """By exact name, identity, owner/local name, descriptive name, the same trimmed, the same in lower case; several matches are refused."""
        all_ = list(self.by_name.values())
        fold = lambda s: s.strip().casefold()
        rules = (
            lambda d: d.name == name,
            lambda d: d.identity() == name,
            lambda d: f"{d.owner}/{d.name}" == name,
            lambda d: d.descriptive_name == name,
            lambda d: d.descriptive_name.strip() == name.strip(),
            lambda d: fold(name) in (fold(d.descriptive_name), fold(d.name)),
        )
        for rule in rules:
            found = [d for d in all_ if rule(d)]
            if len(found) > 1:
                raise CatalogRefused(f"{name} may be {', '.join(sorted(d.name for d in found))}", 409)
            if found:
                return found[0]
        raise CatalogRefused(f"no schema {name}", 404)

    def readable(self, name: str) -> Definition:
        found = self.resolve(name)
        if found.blocked:
            raise CatalogRefused(f"{found.name} is being dropped", 409)
        return found

    def block(self, name: str) -> None:
        self.by_name[name] = replace(self.by_name[name], blocked=True)

    def drop(self, name: str) -> None:
        self.block(name)
        del self.by_name[name]
        self.policies.pop(name, None)

    def set_ttl(self, name: str, source: str, seconds: int | None, confirm: bool = False) -> None:
        """A manifest's or an operator's time to live (None takes it away). An operator's goes first; making it shorter wants confirmation."""
        if source == "manifest" and seconds is not None and not TTL_LEAST <= seconds <= TTL_MOST:
            raise CatalogRefused("a manifest's time to live is one hour to 3650 days")
        if seconds is not None and seconds <= 0:
            raise CatalogRefused("a time to live is over 0")
        policy = self.policies.setdefault(name, {})
        before = self.ttl(name)
        after = {k: v for k, v in {**policy, source: seconds}.items() if v is not None}
        shorter = after.get("operator", after.get("manifest"))
        if shorter is not None and (before is None or shorter < before) and source == "operator" and not confirm:
            raise CatalogRefused("confirm a shorter time to live", 409)
        self.policies[name] = after

    def ttl(self, name: str) -> int | None:
        policy = self.policies.get(name, {})
        return policy.get("operator", policy.get("manifest"))

    def frame(self, spark: SparkSession, active: bool = False) -> DataFrame:
        """The catalog as a DataFrame: schema, layout, identity, ttl_seconds, blocked; all of it, or what can be read."""
        rows = [(d.name, "HashRange" if d.primary.kind == "hash_range" else "Hash", d.identity(), self.ttl(d.name), d.blocked) for d in self.by_name.values() if not (active and d.blocked)]
        return spark.createDataFrame(rows, "schema string, layout string, identity string, ttl_seconds long, blocked boolean")

    def save(self, spark: SparkSession, path: str) -> int:
        """Appends the whole catalog, a row a schema, as the next version of a small table; returns the version."""
        version = (_saved(spark, path).agg(F.max("version")).first()[0] or 0) + 1
        rows = [(version, d.name, json.dumps(_plain(d)), json.dumps(self.policies.get(d.name, {}))) for d in self.by_name.values()]
        spark.createDataFrame(rows or [(version, None, None, None)], SAVED).coalesce(1).write.mode("append").parquet(path)
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Catalog:
        """The last version saved, or an older one; an empty catalog if there is none."""
        saved = _saved(spark, path)
        version = version or saved.agg(F.max("version")).first()[0]
        out = cls()
        for r in saved.where((F.col("version") == F.lit(version)) & F.col("name").isNotNull()).orderBy("name").collect():
            out.by_name[r["name"]] = _definition(json.loads(r["definition"]))
            out.policies |= {r["name"]: p} if (p := json.loads(r["policy"])) else {}
        return out


SAVED = "version long, name string, definition string, policy string"


def _saved(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(SAVED).parquet(path) if there else spark.createDataFrame([], SAVED)


def _plain(d: Definition) -> dict:
    kind = lambda t: t if isinstance(t, str) else [t.name, [kind(i) for i in t.inner], [[n, kind(m)] for n, m in t.members]]
    return {**asdict(d), "fields": {n: kind(t) for n, t in d.fields.items()}}


def _definition(plain: dict) -> Definition:
    kind = lambda t: t if isinstance(t, str) else FieldType(t[0], tuple(map(whole, t[1])), tuple((n, whole(m)) for n, m in t[2]))
    whole = lambda t: FieldType(t) if isinstance(t, str) else kind(t)
    fields = {n: kind(t) for n, t in plain["fields"].items()}
    return Definition(**{**plain, "fields": fields, "primary": Key(**plain["primary"]), "alternates": {n: Key(**k) for n, k in plain["alternates"].items()}})
