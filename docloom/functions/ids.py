"""Identity and deterministic-randomness helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_id(col) -> Column:
    """MD5 hex of the UTF-8 bytes (document id from the file name, chunk id
    from the chunk text)."""
    return F.md5(_c(col))


def md5_bucket32(col) -> Column:
    """First 32 bits of the MD5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint")


def seeded_key(seed: int | str, id_col) -> Column:
    """Repeatable pseudo-random order key: ``md5(seed || ':' || id)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(id_col).cast("string")))
