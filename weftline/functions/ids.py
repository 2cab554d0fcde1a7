"""Ids: stable hashes, seeded masks and orders, dotted versions, canonical order of public ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_id(*parts: Column | str, sep: str = "::") -> Column:
    """sha1 of the parts joined by sep."""
    return F.sha1(F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def hash_share(name: Column, seed: str | int) -> Column:
    """A number in [0, 1) by the first 12 hex digits of sha1(seed|name)."""
    digits = F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), name.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**12))


def allowed(name: Column, rate: float, seed: str | int) -> Column:
    """A mask that lets rate of the names through; what a smaller rate lets through, a larger one does."""
    if rate <= 0:
        return F.lit(False)
    return F.lit(True) if rate >= 1 else hash_share(name, seed) < rate


def stable_int(text: Column) -> Column:
    """sha1's first 8 hex digits modulo 2**31 - 1."""
    return F.conv(F.substring(F.sha1(text.cast("string")), 1, 8), 16, 10).cast("bigint") % (2**31 - 1)


def public_id(name: Column, sep: str = "::") -> Column:
    return F.split_part(name.cast("string"), F.lit(sep), F.lit(1))


def version_key(version: Column) -> Column:
    """A dotted version as an array of ints, which sorts as versions do; parts that are no number are -1."""
    return F.transform(F.split(F.coalesce(version.cast("string"), F.lit("")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def id_order(name: Column) -> Sequence[Column]:
    """Sort columns: numeric ids by number, then the others by text."""
    number = name.cast("string").try_cast("bigint")
    return [number.isNull().asc(), number.asc(), name.asc()]
