"""Stable pseudonymous identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps this project's identifiers apart from any other's.
DOMAIN = "usagebook/1"


def framed(part: Column) -> Column:
    """A part's UTF-8 bytes behind their number as eight little-endian bytes; null counts as empty."""
    raw = F.coalesce(part.cast("string"), F.lit("")).cast("binary")
    return F.concat(_length(raw), raw)


def _length(raw: Column) -> Column:
    big = F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)]))


def digest(*parts: Column) -> Column:
    """SHA-256 in hex over the framed parts."""
    return F.sha2(F.concat(*[framed(p) for p in parts]), 256)


def stable_id(*parts: Column) -> Column:
    """evt_ and 24 hex digits."""
    return F.concat(F.lit("evt_"), F.substring(digest(*parts), 1, 24))


def pseudonym(prefix: str, kind: str, *parts: Column) -> Column:
    """An identifier of a kind (session, message, request, source, import) that can't be mistaken for another kind's."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest(F.lit(DOMAIN), F.lit(kind), *parts), 1, 24))


def short(identifier: Column, digits: int = 16) -> Column:
    """An identifier for display."""
    return F.substring(stable_id(identifier), 1, digits)
