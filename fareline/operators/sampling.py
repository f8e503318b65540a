"""Samples that do not depend on the order of rows or on a random state.

Rows are ordered and cut by the md5 of "seed|key", so another engine draws the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _below(digest: Column, share: Column) -> Column:
    """Whether the first 32 bits of a digest lie in the share of their range."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < share * 2**32


def hash_sample(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """The k rows with the least digest of their key; ties by the key itself."""
    return df.withColumn("__h", _digest(key, seed)).orderBy("__h", *key).limit(k).drop("__h")


def hash_sample_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """At most k rows of each group, by the least digest. A first cut within hash slices of a group comes
    before the shuffle by group, so a hot group does not meet in one task."""
    rows = df.withColumns({"__h": _digest(key, seed), "__slice": F.pmod(F.xxhash64(*key), F.lit(256))})
    for within in ([*group, "__slice"], list(group)):
        w = Window.partitionBy(*within).orderBy("__h", *key)
        rows = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return rows.drop("__h", "__slice", "__r")


def stratified(df: DataFrame, column: str, fractions: dict[str, float], key: Sequence[str], seed: int = 0) -> DataFrame:
    """The share of each stratum's keys; strata without a share are left out."""
    share = F.coalesce(F.create_map([F.lit(x) for pair in fractions.items() for x in pair])[F.col(column)], F.lit(0.0))
    return df.where(_below(_digest(key, seed), share))


def fraction_by_key(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """The rows whose key falls into the share: the same keys in every table."""
    return df.where(_below(_digest(key, seed), F.lit(share)))
