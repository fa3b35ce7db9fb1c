"""Deterministic ids and content hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: This engine's own namespace for name-based ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "quillmill.invalid")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_hash(version: str, texts: Column) -> Column:
    """SHA-256 over a version and all texts of a document, each after a zero byte."""
    return F.sha2(F.concat(F.lit(version), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("\0"), t)), "")), 256)


def entity_id(collection: Column, name: Column) -> Column:
    """The first 16 digits of the MD5 of collection and folded name."""
    return F.substring(F.md5(F.concat(collection, F.lit(":"), F.lower(folded(name)))), 1, 16)


def folded(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def relation_type(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), r"\s+", "_")
