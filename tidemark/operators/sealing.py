"""Canonical JSON and hashes of nested records in VARIANT columns, without leaving the JVM.

The JSON of a VARIANT has sorted keys and no blanks, so it is the canonical form as it stands. Departures from Python's form, none of which a sealed
record holds: numbers written with a fraction or an exponent lose closing zeros, doubles from 10^7 on have the JVM's exponent, control characters other
than tab and line feed are escaped in upper case, and keys outside the basic plane sort by UTF-16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what marks the mentions that the vocabulary pass appended.
PASS_ORIGIN = "skill_pass"

_OBJECT = "map<string,variant>"


def canonical(value: Column) -> Column:
    return F.to_json(value)


def object_hash(value: Column) -> Column:
    """Hash of one object of a record, as its canonical JSON. Null stays null."""
    return F.sha2(canonical(value), 256)


def members(value: Column) -> Column:
    """An object as a map of its keys; null for anything else."""
    return value.try_cast(_OBJECT)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def with_keys(value: Column, changed: dict[str, Column]) -> Column:
    """The object with these keys set; what is no object is read as an empty one."""
    names = F.array(*map(F.lit, changed))
    empty = F.create_map().cast(_OBJECT)
    kept = F.map_filter(F.coalesce(members(value), empty), lambda k, _: ~F.array_contains(names, k))
    added = F.map_from_arrays(names, F.array(*[c.cast("variant") for c in changed.values()]))
    return F.to_variant_object(F.map_concat(kept, added))


def candidate_hash(record: Column) -> Column:
    """Identity of an extraction: the record without its quality, its own hash and the mentions of the vocabulary pass. Null stays null."""
    get = lambda path, kind: F.try_variant_get(record, path, kind)
    unsealed = with_keys(get("$.extraction", "variant"), {"candidate_hash": F.lit("")})
    own = F.filter(get("$.mentions", "array<variant>"), lambda m: ~F.coalesce(text(m, "$.origin") == PASS_ORIGIN, F.lit(False)))
    mentions = F.when(own.isNotNull(), F.to_variant_object(own)).otherwise(get("$.mentions", "variant"))
    shadow = with_keys(record, {"extraction": unsealed, "quality": F.lit(None), "mentions": mentions})
    without = F.to_variant_object(F.map_filter(members(shadow), lambda k, _: k != "mentions"))
    return F.when(record.isNotNull(), object_hash(F.when(get("$.mentions", "variant").isNull(), without).otherwise(shadow)))


def text(value: Column, path: str = "$") -> Column:
    """The string at a path; null where there is none or something else."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, path, "string"))


def listed(value: Column, path: str = "$") -> Column:
    """The list at a path; empty where there is none or something else."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
