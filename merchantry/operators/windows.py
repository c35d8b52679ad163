"""Order-dependent operators.

``row_number() over (partition by description ...)`` would put every row of a hot
descriptor into one task; "first occurrence" is instead the minimum (date, id) of its
key — a partial aggregation joined back — so a key holding a third of the rows costs
one pre-combined row per task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.dates import month_bucket, year_bucket


def running_new_flags(df: DataFrame, key: str = "description", order: tuple = ("posted_date", "txn_id"),
                      out: str = "is_new") -> DataFrame:
    """``out`` is true on the first row (by ``order``) of every ``key``; null is a key like others."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    return (df.join(first, F.col(key).eqNullSafe(F.col("_key")))
            .withColumn(out, F.struct(*[F.col(c) for c in order]) == F.col("_first"))
            .drop("_key", "_first"))


def rate_by(df: DataFrame, flag: str, bucket, out: str, name: str = "bucket") -> DataFrame:
    """Share of ``flag`` per bucket (E2 by year, E3 by month), 3 decimals."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    return (df.groupBy(b.alias(name))
            .agg(F.round(F.avg(F.col(flag).cast("double")), 3).alias(out),
                 F.count(F.lit(1)).alias("n")))


def new_descriptor_rate_by_year(statement: DataFrame, types=("DEB", "DD")) -> DataFrame:
    """New-descriptor rate per year over debit rows, in date then row order."""
    s = statement.filter(F.col("type").isin(*types))
    flagged = running_new_flags(s, "description", ("date", "row_no"))
    return rate_by(flagged, "is_new", year_bucket("date"), "new_rate", "year")


def cache_hit_rate_by_month(feed: DataFrame) -> DataFrame:
    """A row hits when its exact description appeared in an earlier row (date, then
    txn_id); hit rate per posted month."""
    flagged = running_new_flags(feed, "description", ("posted_date", "txn_id"))
    flagged = flagged.withColumn("hit", ~F.col("is_new"))
    return rate_by(flagged, "hit", month_bucket("posted_date"), "hit_rate", "month")


def cumulative(df: DataFrame, weight: str, order: list[str], partition: list[str] | None = None,
               out: str = "cum") -> DataFrame:
    """E5: running sum of ``weight`` in ``order`` within ``partition`` (for bounded
    groups such as CDF tables; an unpartitioned call runs in one task)."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(weight).over(w))


def first_index(df: DataFrame, key: str, order: str, out: str = "first_index") -> DataFrame:
    """The smallest ``order`` of each key on every row (aggregate + join)."""
    return df.join(df.groupBy(key).agg(F.min(order).alias(out)), key, "left")


def count_per_key(df: DataFrame, key: str, out: str = "key_rows") -> DataFrame:
    """The number of rows of each key on every row (aggregate + join)."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(out)), key, "left")
