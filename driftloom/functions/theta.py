"""Tie-breaking numbers that don't depend on the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def theta(seed: int, series: Column, t: Column, k: Column | int) -> Column:
    """A number in (0, 1) that looks uniform, from 52 bits of an MD5 of its arguments."""
    k = F.lit(k) if isinstance(k, int) else k
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), series.cast("string"), t.cast("string"), k.cast("string"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def theta_value(seed: int, series: str, t: int, k: int) -> float:
    """The same number in Python."""
    digest = hashlib.md5(f"{seed}|{series}|{t}|{k}".encode(), usedforsecurity=False).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 2**52


def theta_sql(seed: int, series: str, t: str, k: str) -> str:
    """The same number in SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {series}, {t}, {k})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
