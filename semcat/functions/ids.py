"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semcat.functions.text import normalise_string

# Fixed value: namespace of the catalogue's name-based uuids.
NAMESPACE = "12345678-1234-5678-1234-567812345678"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version-5 uuid of a string, as a native expression."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))

    def part(start: int, length: int) -> Column:
        return F.substring(digest, start, length)

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.when(
        name.isNotNull(),
        F.concat(
            part(1, 8), F.lit("-"),
            part(9, 4), F.lit("-5"),
            part(14, 3), F.lit("-"),
            variant, part(18, 3), F.lit("-"),
            part(21, 12),
        ),
    )


def id_source(*candidates: Column) -> Column:
    """First candidate that is neither null nor blank, stripped."""
    return F.coalesce(*[normalise_string(c) for c in candidates])


def id_hash(source: Column) -> Column:
    return F.md5(source)


def topic_url(identifier: Column, prefix: str) -> Column:
    """Public page of a call; null without an identifier."""
    return F.when(F.length(identifier) > 0, F.concat(F.lit(prefix), identifier))
