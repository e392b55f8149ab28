"""Exact ranks and prefix sums inside strata without bringing a stratum into one task.

A row's sort key is mapped monotonically onto [0, 1) and cut into equal buckets. Per-bucket counts and
sums are small; their running totals give each bucket's offset, and a window inside each bucket gives the
rest. A stratum that holds a third of all rows is thus spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a stratum; a bucket of 10**10 rows then holds about 2.5 million.
BUCKETS = 4096


def stratum_of(column: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), column.cast("string")))


def bucket_of(unit: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a value in [0, 1]; 1 goes to the last."""
    return F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int")


def counted_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once, with the number ``m`` of its copies. Copies are combined before they are dealt, so they share no task."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("m"))


def each_copy(df: DataFrame, m: str = "m", copy: str = "copy", part: int = 1 << 14) -> DataFrame:
    """As many rows as ``m`` says, numbered from 0 in ``copy``; sequences are made in parts, so no row grows long."""
    top = F.col(m) - 1
    parts = df.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), top, F.lit(part).cast("long"))))
    return parts.withColumn(copy, F.explode(F.sequence(copy, F.least(top, F.col(copy) + part - 1))))


def bucket_totals(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Per (keys, bucket): rows and amount before it and in all buckets of the keys."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("rows_here"), F.sum(amount).alias("amount_here"))
        .withColumns({"rows_before": F.coalesce(F.sum("rows_here").over(before), F.lit(0)), "amount_before": F.coalesce(F.sum("amount_here").over(before), F.lit(0)), "all_rows": F.sum("rows_here").over(by), "all_amount": F.sum("amount_here").over(by)})
        .drop("rows_here", "amount_here")
    )
