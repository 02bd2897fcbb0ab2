"""Random numbers derived from a hash of (seed, keys).

They do not depend on partitioning and come out the same when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | Column, *keys: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]))


def hash_uniform(seed: int | Column, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    head = F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def hash_order(seed: int | Column, *keys: Column) -> Column:
    """The first 60 bits of the hash: sorts like the hash text, in 8 bytes instead of 32."""
    head = F.conv(F.substring(hash_hex(seed, *keys), 1, 15), 16, 10).cast("bigint")
    # never null, which spares a join on it a null filter that would hash every row again
    return F.coalesce(head, F.lit(0).cast("bigint"))


def hash_order_bucket(order: Column, buckets: int) -> Column:
    """Equal-width bucket of a 60-bit hash, increasing with it."""
    return F.shiftright(F.shiftright(order, 30) * F.lit(int(buckets)), 30)

