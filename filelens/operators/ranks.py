"""Running counts and maxima within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of an order that are one window together.
WIDTH = 1 << 20


def running(rows: DataFrame, by: list[str], order: list[Column], bucket: Column, value: Column, out: str, largest: bool = False) -> DataFrame:
    """``rows`` with ``out``: the sum (or the largest) of ``value`` from the first row of its group to this one, in ``order``.

    ``bucket`` cuts the order into stretches of bounded size: windows are those of a bucket, and what
    comes before each bucket is summed up, a row a bucket, and joined back. So no group,
    however large, is one task's.
    """
    f = F.max if largest else F.sum
    rows = rows.withColumns({"__bucket": bucket, "__value": value})
    before = f("__total").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy(*by, "__bucket").agg(f("__value").alias("__total")).select(*by, "__bucket", before.alias("__before"))
    here = f("__value").over(Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__here", here)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "__bucket"]]
    both = rows.alias("r").join(totals.alias("t"), same).select("r.*", "t.__before")
    none = F.lit(0)
    whole = F.greatest("__here", "__before") if largest else F.coalesce("__here", none) + F.coalesce("__before", none)
    return both.withColumn(out, whole).drop("__bucket", "__value", "__here", "__before")


def numbered(rows: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """``rows`` with ``out``: from 1, in the order of a whole number that no two rows of a group share."""
    return running(rows, by, [F.col(order)], F.floor(F.col(order) / WIDTH), F.lit(1), out)
