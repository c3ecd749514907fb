"""Identifiers, object paths and credentials."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed shape of a table or column name, the separator
# between a namespace and an access key, and the path segment before a namespace.
SAFE_NAME = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
KEY_SEPARATOR = "::"
CATALOG_SEGMENT = "iceberg"


def check_name(name: str, what: str) -> str:
    if not re.fullmatch(SAFE_NAME, name):
        raise ValueError(f"invalid {what} name: {name!r}")
    return name


def bundle_id(key: Column, version: str) -> Column:
    return F.concat(F.lit("bundle-"), F.sha2(F.concat(key.cast("string"), F.lit(version)), 256))


def namespace_of(qualified: Column) -> Column:
    """Text before the first separator (all of it when there is none)."""
    return F.substring_index(qualified, KEY_SEPARATOR, 1)


def access_key_of(qualified: Column) -> Column:
    """Text after the first separator; a key may itself hold the separator."""
    at = F.instr(qualified, KEY_SEPARATOR)
    return F.when(at > 0, F.substr(qualified, at + F.lit(len(KEY_SEPARATOR)))).otherwise(F.lit(""))


def bucket_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def object_of(path: Column) -> Column:
    at = F.instr(path, "/")
    return F.when(at > 0, F.substr(path, at + F.lit(1))).otherwise(F.lit(""))


def path_namespace(path: Column) -> Column:
    """The segment after the first catalog segment that has a successor, else empty."""
    segments = F.split(path, "/")
    at = F.array_position(segments, CATALOG_SEGMENT)
    return F.when(at > 0, F.coalesce(F.try_element_at(segments, (at + 1).cast("int")), F.lit(""))).otherwise(
        F.lit("")
    )


def public_location(location: Column) -> Column:
    return F.regexp_replace(location, "^s3a://", "s3://")


def usable_credential(key: Column, expiration: Column, now: Column, secret: Column | None = None) -> Column:
    """Key (and secret) present and not past its expiry; no expiry never ends."""
    present = F.coalesce(key != "", F.lit(False))
    if secret is not None:
        present = present & F.coalesce(secret != "", F.lit(False))
    return present & (expiration.isNull() | (now <= expiration))
