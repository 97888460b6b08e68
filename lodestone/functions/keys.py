"""Orders and samples that follow from keys alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(key: Column, seed: int) -> Column:
    """60 bits of a hash of the key and a seed, as long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")
