"""Windows over a whole table in the order of a numeric column, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a range of the order has on average, and ranges whose sums are broadcast.
RANGE, FEW = 50_000, 1_000_000


def _ranges(df: DataFrame, order: str, rows: int) -> tuple[DataFrame, int]:
    low, high, n = df.agg(F.min(order).cast("long"), F.max(order).cast("long"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * rows // max(1, n))
    # In doubles, whose rounding keeps the order, as far values may be more than a long apart.
    return df.withColumn("__range", F.floor((F.col(order).cast("double") - F.lit(float(low or 0))) / F.lit(float(width)))), n // rows + 1


def _back(rows: DataFrame, sums: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(sums) if count <= FEW else sums, "__range", "left")


def previous(df: DataFrame, order: str, value: str, name: str = "before", rows: int = RANGE) -> DataFrame:
    """df with the last value before each row that is not null, in the order of a numeric column without ties.

    Ranges of the order have windows of their own; what comes into a range is the last value of the ranges before, a window
    over a row for each range.
    """
    ranged, count = _ranges(df, order, rows)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    lasts = ranged.groupBy("__range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__last"))
    carried = lasts.select("__range", F.last("__last", ignorenulls=True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    return _back(ranged.withColumn("__own", own), carried, count).withColumn(name, F.coalesce("__own", "__carried")).drop("__range", "__own", "__carried")


def running_sum(df: DataFrame, order: str, value: str, name: str = "before", rows: int = RANGE) -> DataFrame:
    """df with the sum of the values before each row, in the order of a numeric column without ties."""
    ranged, count = _ranges(df, order, rows)
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    carried = sums.select("__range", F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    total = F.coalesce("__own", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    return _back(ranged.withColumn("__own", own), carried, count).withColumn(name, total).drop("__range", "__own", "__carried")
