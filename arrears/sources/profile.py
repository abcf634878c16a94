"""Profiles per day from mergeable sketches.

A day's profile holds its rows, a HyperLogLog sketch of each checked column and a KLL sketch
of each checked number. Profiles are stored per day; any span of days is their union, without
another look at the rows. Stated errors: distinct counts within 5 %, quantiles within 2 % of
the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.session import shared_path
from arrears.sources.catalog import Sources

DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02
HLL_BITS, KLL_SIZE = 14, 400


def profile_days(df: DataFrame, day, distinct: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One row per day: ``day``, ``rows``, ``hll_<column>`` and ``kll_<column>``."""
    return df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_BITS)).alias(f"hll_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(f"kll_{c}") for c in numbers])


def unite(days: DataFrame, distinct: Sequence[str], numbers: Sequence[str],
          fractions: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """One row over all given days: rows, ``distinct_<column>`` and ``quantiles_<column>``."""
    merged = days.agg(
        F.sum("rows").cast("bigint").alias("rows"),
        *[F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in distinct],
        *[F.kll_merge_agg_double(f"kll_{c}").alias(f"kll_{c}") for c in numbers])
    at = F.array(*[F.lit(float(f)) for f in fractions])
    return merged.select("rows", *[F.hll_sketch_estimate(f"hll_{c}").alias(f"distinct_{c}") for c in distinct],
                         *[F.kll_sketch_get_quantile_double(f"kll_{c}", at).alias(f"quantiles_{c}") for c in numbers])


#: relation -> (date column, columns counted distinct, numbers).
PROFILED = {
    "dialer_calls": ("call_date", ("uniqueid", "case_id"), ("duration",)),
    "contact_events": ("contact_date", ("insert_user",), ("case_id",)),
    "payments": ("payment_date", ("ref_number", "payment_id"), ("payed_capital",)),
}
FRACTIONS = (0.1, 0.5, 0.9)


def profile_report(src: Sources, p=None) -> DataFrame:
    """Profiles of each relation stored per day and united, held against exact figures:
    (relation, column_name, measure, rows, exact, within): ``exact`` is the distinct count, or for
    a quantile the rows with a number; ``within`` whether the estimate keeps its stated error."""
    out = None
    for name, (c, distinct, numbers) in PROFILED.items():
        df, path = src.rel(name), shared_path(src.spark, f"profile-{name}")
        profile_days(df, F.to_date(c), distinct, numbers).write.parquet(path)
        one = unite(src.spark.read.parquet(path), distinct, numbers, FRACTIONS)
        both = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in distinct],
                      *[F.count(c).alias(f"n_{c}") for c in numbers])
        checks = []
        for c in distinct:
            estimate, exact = one.select(f"distinct_{c}").scalar(), F.col(f"d_{c}")
            checks.append((c, "distinct", exact, F.abs(estimate - exact) <= exact * DISTINCT_ERROR))
        rows = one.select("rows").scalar()
        for c in numbers:
            for k, f in enumerate(FRACTIONS):
                q, x = one.select(F.col(f"quantiles_{c}")[k]).scalar(), F.col(c).cast("double")
                share = df.agg((F.sum(F.when(x < q, 1).otherwise(0)) / F.count(c)).alias("lo"),
                               (F.sum(F.when(x <= q, 1).otherwise(0)) / F.count(c)).alias("hi"))
                ok = share.select((F.col("lo") <= f + RANK_ERROR) & (F.col("hi") >= f - RANK_ERROR)).scalar()
                checks.append((c, f"p{round(f * 100)}", F.col(f"n_{c}"), ok))
        part = both.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("relation"), F.lit(c).alias("column_name"), F.lit(m).alias("measure"), rows.alias("rows"),
                     exact.alias("exact"), (ok & (rows == F.col("n"))).alias("within")) for c, m, exact, ok in checks])))
        out = part if out is None else out.unionByName(part)
    return out
