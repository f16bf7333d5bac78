"""Usage series: counts by bucket, percent of peak, floors, peaks and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_up


def dense(df: DataFrame, keys: list[str], bucket: Column, n: int) -> DataFrame:
    """(keys, series): counts of n buckets from 0; rows in other buckets are left out.

    One aggregation by key and bucket, then n sums a key: no list of rows is held.
    """
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    each = [F.coalesce(F.sum(F.when(F.col("_bucket") == k, F.col("_n"))), F.lit(0)) for k in range(n)]
    return counts.groupBy(*keys).agg(F.array(*each).alias("series"))


def percent_of_peak(series: Column) -> Column:
    """Each bucket as whole percent of the greatest; all 0 if that is 0."""
    peak = F.array_max(series)
    return F.transform(series, lambda c: F.when(peak > 0, half_up(100 * c / peak)).otherwise(F.lit(0).cast("long")))


def floored(series: Column, first: Column) -> Column:
    """Buckets before `first` at 0, unless nothing would be left."""
    cut = F.transform(series, lambda c, k: F.when(k < first, F.lit(0).cast("long")).otherwise(c))
    return F.when(F.array_max(cut) > 0, cut).otherwise(series)


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0).cast("long"), lambda a, c: a + c)


def peak(series: Column) -> Column:
    """The first bucket with the greatest value."""
    return F.array_position(series, F.array_max(series)).cast("long") - 1


def distinctiveness(series: Column) -> Column:
    """The greatest value less the mean."""
    return F.array_max(series) - total(series) / F.size(series)


def centroid(series: Column) -> Column:
    """Mean bucket, weighted by value; null if all are 0."""
    weighted = F.aggregate(F.transform(series, lambda c, k: c * k), F.lit(0).cast("long"), lambda a, c: a + c)
    return F.try_divide(weighted, total(series))


def non_zero(series: Column) -> Column:
    return F.size(F.filter(series, lambda c: c > 0))
