"""Top-1 per group ("latest row per key")."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each ``keys`` group under ``order``.

    ``row_number() = 1`` is planned as a WindowGroupLimit: each map task
    keeps only its own best row per key before the shuffle, so a hot key
    sends one row per task instead of its whole group. ``order`` must end
    in a unique tie-break so the pick is deterministic (and therefore the
    same after a task is recomputed).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__rn", F.row_number().over(w))
              .where(F.col("__rn") == 1)
              .drop("__rn"))
