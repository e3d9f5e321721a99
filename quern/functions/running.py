"""Running totals without sending a whole table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, value: str, order: list[str], bucket: Column, out: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows and this one, within ``by``, in the order of (bucket, order);
    and ``total``, if named: the sum over all rows within ``by``.

    bucket must not decrease along the order. Totals of buckets are summed in a table of one row for each bucket; rows are
    only ordered inside their bucket, so buckets are spread over tasks.
    """
    by = by or []
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_n"))
    upto = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = totals.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    if total:
        before = before.withColumn(total, F.sum("_n").over(W.partitionBy(*by)))
    before = before.drop("_n")
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_inside", F.sum(value).over(inside)).join(before, [*by, "_bucket"])
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")
