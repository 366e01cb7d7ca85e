"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.runtime import fresh

#: A key is heavy from this share of the rows on, so there are at most 1000 heavy keys.
HEAVY_SHARE = 0.001


def heavy_keys(counts: DataFrame, key: str, count: str, total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys with at least `share` of `total` rows, and a thousand: no more than 1/share of them, so they can be broadcast."""
    if total < 1000:
        return counts.sparkSession.createDataFrame([], counts.select(key).schema)
    return counts.where(F.col(count) >= F.lit(max(1000.0, share * total))).select(key)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame, how: str = "inner", salts: int = 32, limit: int = 2000) -> DataFrame:
    """rows joined with lookup (unique key); rows of heavy keys are spread over `salts` tasks.

    Only the heavy keys' rows of lookup are repeated, once a salt. `heavy` comes
    from heavy_keys; its keys, at most `limit`, become literals of the plan, so
    both sides stay free of further joins. Without heavy keys it is a plain
    join. Rows with a null key match nothing.
    """
    keys = [r[0] for r in heavy.select(key).where(F.col(key).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(keys) > limit:
        raise ValueError(f"more than {limit} heavy keys: they must come from heavy_keys")
    if not keys:
        return rows.join(lookup, key, how)
    salt = fresh(rows.select(*rows.columns, *(F.lit(0).alias(c) for c in lookup.columns if c not in rows.columns)), "salt")[0]
    hot = F.col(key).isin(keys)
    spread = F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(salt, spread).join(lookup.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)
