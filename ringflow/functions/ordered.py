"""Global order without a global task: lead, numbers and running sums over ranges.

Rows are dealt into ranges of the order, as many as their number asks for, and
written once; windows work inside a range, and only one row for each range is
combined in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import write_table

#: Rows of a range, about. A billion rows make a thousand ranges.
RANGE_ROWS = 1_000_000


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def in_ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, str]:
    """``df`` written in ranges, and the name of the column that numbers them.

    It is read three times (counted, sampled, dealt out), so it should be a table and not a long plan.
    """
    part = unused(df, "range")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    return write_table(df.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "ranges"), part


def _before(sums: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """Per range the sum of ``amount`` over all ranges before it; one row a range."""
    earlier = W.partitionBy(F.lit(0)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(sums.select(part, F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias(out)))


def lead_over(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``out``: the next row's ``value`` in the order of ``key`` (without ties), null for the last row."""
    laid, part = in_ranges(df, [F.col(key)])
    last, after = unused(laid, "last"), unused(laid, "after")
    heads = laid.groupBy(part).agg(F.min_by(value, key).alias(after))
    afters = heads.select(part, F.lead(after).over(W.partitionBy(F.lit(0)).orderBy(part)).alias(after))
    inside = W.partitionBy(part).orderBy(key)
    inner = laid.withColumn(out, F.lead(value).over(inside)).withColumn(last, F.lead(key).over(inside).isNull())
    return inner.join(F.broadcast(afters), part).withColumn(out, F.when(F.col(last), F.col(after)).otherwise(F.col(out))).drop(part, last, after)


def running_total(df: DataFrame, key: str, amount: Column, out: str) -> DataFrame:
    """``out``: sum of ``amount`` over all rows of smaller ``key`` (without ties), 0 for the first."""
    own = unused(df, "amount")
    laid, part = in_ranges(df.withColumn(own, amount), [F.col(key)])
    before = unused(laid, "before")
    sums = _before(laid.groupBy(part).agg(F.sum(own).alias(own)), part, own, before)
    inside = W.partitionBy(part).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return laid.join(sums, part).withColumn(out, F.col(before) + F.coalesce(F.sum(own).over(inside), F.lit(0))).drop(part, own, before)


def numbered(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """``out``: 1, 2, ... in the order of the columns, nulls first."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    laid, part = in_ranges(df, cols)
    before = unused(laid, "before")
    sums = _before(laid.groupBy(part).count(), part, "count", before)
    return laid.join(sums, part).withColumn(out, F.col(before) + F.row_number().over(W.partitionBy(part).orderBy(*cols))).drop(part, before)
