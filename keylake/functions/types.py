"""Field types: checks of JSON values against declared types, as column expressions over text.

A value is given as JSON text. Variant functions look into it, so nested declarations stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from keylake.functions.codec import datetime_micros, valid_date

SCALARS = ("String", "Integer", "Float", "Number", "Boolean", "Null", "Any", "Date", "DateTime")


@dataclass(frozen=True)
class FieldType:
    """A declared type: a scalar by name, Array or Map (of `inner[0]`), OneOf (`inner`), or Object (`members`)."""

    name: str
    inner: tuple[FieldType, ...] = ()
    members: tuple[tuple[str, FieldType], ...] = field(default=())

    def spark(self) -> str:
        """The Spark type to store such values in; VARIANT where no single type holds them."""
        plain = {"String": "STRING", "Integer": "BIGINT", "Float": "DOUBLE", "Boolean": "BOOLEAN", "Date": "DATE", "DateTime": "STRING"}
        if self.name == "Array":
            return f"ARRAY<{self.inner[0].spark()}>"
        if self.name == "Map":
            return f"MAP<STRING, {self.inner[0].spark()}>"
        if self.name == "OneOf":
            rest = [t for t in self.inner if t.name != "Null"]
            return rest[0].spark() if len(rest) == 1 else "VARIANT"
        return plain.get(self.name, "VARIANT")


def _kind(json: Column) -> Column:
    """What a JSON text holds: object, array, string, number, boolean or null; null if it isn't JSON."""
    start = F.substring(F.trim(json), 1, 1)
    shape = F.when(start == "{", "object").when(start == "[", "array").when(start == '"', "string").when(F.trim(json).isin("true", "false"), "boolean").when(F.trim(json) == "null", "null").when(start.rlike("[-0-9]"), "number")
    return F.when(F.try_parse_json(json).isNotNull(), shape)


def _text(json: Column) -> Column:
    """The string that a JSON text holds."""
    return F.try_variant_get(F.try_parse_json(json), "$", "string")


def valid(json: Column, kind: FieldType) -> Column:
    """Whether a JSON text is a value of the type; never null. Missing object members count as null, extra ones are allowed."""
    is_ = lambda k: F.coalesce(_kind(json) == k, F.lit(False))
    whole = json.rlike(r"^\s*-?[0-9]+\s*$") & F.trim(json).try_cast("long").isNotNull()
    simple = {
        "Any": lambda: _kind(json).isNotNull(), "Null": lambda: is_("null"), "String": lambda: is_("string"), "Boolean": lambda: is_("boolean"), "Number": lambda: is_("number"),
        "Float": lambda: is_("number") & F.trim(json).try_cast("double").isNotNull(), "Integer": lambda: is_("number") & whole,
        "Date": lambda: is_("string") & valid_date(_text(json)), "DateTime": lambda: is_("string") & datetime_micros(_text(json)).isNotNull(),
    }
    if kind.name in simple:
        return F.coalesce(simple[kind.name](), F.lit(False))
    if kind.name == "OneOf":
        out = F.lit(False)
        for t in kind.inner:
            out |= valid(json, t)
        return out
    if kind.name == "Array":
        items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
        return is_("array") & F.coalesce(F.forall(items, lambda v: valid(F.coalesce(F.to_json(v), F.lit("null")), kind.inner[0])), F.lit(False))
    if kind.name == "Map":
        values = F.map_values(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))
        return is_("object") & F.coalesce(F.forall(values, lambda v: valid(F.coalesce(F.to_json(v), F.lit("null")), kind.inner[0])), F.lit(False))
    if kind.name == "Object":
        out = is_("object")
        for name, t in kind.members:
            member = F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "variant")), F.lit("null"))
            out &= valid(member, t)
        return out
    raise ValueError(f"no type {kind.name}")


def faults(record: Column, declared: dict[str, FieldType]) -> Column:
    """Names of the fields of a record (JSON object) that aren't declared, or whose value isn't of the declared type. Only fields supplied are checked."""
    supplied = F.map_keys(F.coalesce(F.try_variant_get(F.try_parse_json(record), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    unknown = F.filter(supplied, lambda k: ~k.isin(*declared))
    bad = []
    for name, t in declared.items():
        value = F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(record), f"$['{name}']", "variant")), F.lit("null"))
        bad.append(F.when(F.array_contains(supplied, name) & ~valid(value, t), F.lit(name)))
    return F.concat(unknown, F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
