"""Content addresses and normal forms that identity depends on."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value) -> str:
    """Sorted keys, no blanks, letters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Fields of a posting that make a version, in alphabetical order (fixed by the stored hashes).
VERSION_FIELDS = ("compensation", "department", "description_html", "employment_type", "is_remote", "locations", "team", "title", "workplace_type")


def version_fields(record: dict) -> dict:
    """Trimmed texts, sorted distinct locations, lower-case workplace, single blanks in HTML."""
    def tidy(k):
        v = record.get(k)
        if k == "locations":
            return sorted({x.strip() for x in v or [] if x and x.strip()})
        if not isinstance(v, str):
            return v
        v = v.strip()
        return " ".join(v.split()) if k == "description_html" else v.lower() if k == "workplace_type" else v

    return {k: tidy(k) for k in VERSION_FIELDS}


def version_hash_of(record: dict) -> str:
    return sha256_hex(canonical_json(version_fields(record)))


@F.pandas_udf(StringType())
def version_hash(record_json: pd.Series) -> pd.Series:
    """Version hash of a posting given as JSON: one implementation, so that numbers and nulls print one way."""
    return record_json.map(lambda s: None if s is None else version_hash_of(json.loads(s)))


def hash_slot(hex_hash: Column, modulus: int) -> Column:
    """A bounded slot from the first eight hex digits of a hash."""
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long") % modulus


def opt_str(c: str) -> Column:
    """Trimmed of all white space, null if empty."""
    trimmed = F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def norm_list(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")))


def norm_token(c: str) -> Column:
    """Snake case; fulltime and parttime get their underscore."""
    snake = F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s\-]+", "_")
    return F.when(snake == "fulltime", "full_time").when(snake == "parttime", "part_time").otherwise(snake)
