"""Column-expression helpers. All of them build JVM-side expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from equiloan.constants import HASH_MODULUS, HASH_MULTIPLIER, HASH_QUOTIENT


def sanitize_name(name: str) -> str:
    """``denial_reason-2_1.0`` -> ``denial_reason_2_1``: names Spark can use
    unquoted. ``-`` -> ``_``, trailing ``.0`` dropped, ``<``/``>`` spelled."""
    out = name.replace("-", "_").replace("<", "lt").replace(">", "gt")
    out = re.sub(r"\.0$", "", out)
    out = out.replace(".", "_").replace(" ", "_")
    return out


def sanitize_names(names: list[str]) -> dict[str, str]:
    """Map raw names to sanitised ones; raise if two raw names collide."""
    mapping: dict[str, str] = {}
    seen: dict[str, str] = {}
    for raw in names:
        clean = sanitize_name(raw)
        if clean in seen and seen[clean] != raw:
            raise ValueError(f"sanitised name collision: {seen[clean]!r} and {raw!r} -> {clean!r}")
        seen[clean] = raw
        mapping[raw] = clean
    return mapping


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Ratio that is null, never an error, when the denominator is 0 or null."""
    return col_of(num) / F.nullif(col_of(den), F.lit(0))


def round6(c: str | Column) -> Column:
    return F.round(col_of(c), 6)


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def code_is(c: str | Column, code: str) -> Column:
    """Null-safe code comparison: a null code is never equal (indicator 0)."""
    return F.coalesce(col_of(c) == F.lit(code), F.lit(False))


def normalize_code(c: str | Column) -> Column:
    """Codes read from float-typed sources come as ``1.0``; drop the ``.0``."""
    return F.regexp_replace(F.trim(col_of(c).cast("string")), r"\.0$", "")


def portable_hash(key: str | Column, seed: int) -> Column:
    """Repeatable arithmetic hash in [0, HASH_MODULUS) of an integer key.

    Both halves of the key (its remainder and its quotient by the prime
    modulus M) and the seed are mixed linearly, the result is raised to the
    fifth power modulo M (a permutation, as 5 has no factor in common with
    M - 1) and mixed once more. So another seed gives another order, not a
    rotated one, and keys that are equal modulo M part. It depends only on key
    and seed, never on partitioning, and any SQL engine computes the same value
    (every product fits a BIGINT); ``portable_hash_sql`` is its SQL.
    """
    m = F.lit(HASH_MODULUS).cast("bigint")
    k = col_of(key).cast("bigint")
    low = F.pmod(k, m)
    high = F.pmod(F.call_function("div", k - low, m), m)
    x = (low * F.lit(HASH_MULTIPLIER) + high * F.lit(HASH_QUOTIENT) + F.lit(seed)) % m
    x2 = (x * x) % m
    x5 = (((x2 * x2) % m) * x) % m
    return (x5 * F.lit(HASH_MULTIPLIER) + F.lit(seed)) % m


def portable_hash_sql(key: str, seed: int) -> str:
    """``portable_hash`` of a non-negative key as SQL."""
    m = HASH_MODULUS
    x = f"((({key}) % {m}) * {HASH_MULTIPLIER} + ((({key}) // {m}) % {m}) * {HASH_QUOTIENT} + {seed}) % {m}"
    x2 = f"(({x}) * ({x})) % {m}"
    x5 = f"((({x2}) * ({x2})) % {m} * ({x})) % {m}"
    return f"((({x5}) * {HASH_MULTIPLIER} + {seed}) % {m})"


def clamp(c: str | Column, lo, hi) -> Column:
    return F.least(F.greatest(col_of(c), F.lit(lo)), F.lit(hi))
