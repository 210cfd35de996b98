"""Windows over ordered rows: carried values, running numbers, states, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.shared import written


def carried(value: Column, keys: list[str], order: str) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def running_count(mark: Column, keys: list[str], order: str, before: bool = False) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.coalesce(F.sum(F.when(mark, 1).otherwise(0)).over(w), F.lit(0))


def first_after_opener(rows: DataFrame, key: str, order: str, opens: Column, hits: Column) -> DataFrame:
    """The first hit after each opener of a key."""
    state = rows.withColumn("session", running_count(opens, [key], order)).where(hits).where("session > 0")
    first = Window.partitionBy(key, "session").orderBy(order)
    return state.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


#: Bins of a histogram, and rows of a key that are sorted once its histogram has narrowed so far.
BINS, FEW = 4096, 10_000


def rank_percentile(rows: DataFrame, key: str, value: str, share: float, few: int = FEW) -> DataFrame:
    """(key, value): the element at the half-even-rounded place share x (n - 1) of the sorted values, nulls left out.

    Each round counts a key's values in bins between its bounds and goes on with the bin that holds the place; what is left of a key is sorted
    once it is few rows or one value.  So no task sorts a whole key, and a shuffle holds ``BINS`` rows a key and task at most.
    """
    live = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v"))
    bounds = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    bounds = written(bounds.select("key", "low", "high", "n", F.bround(F.lit(share) * (F.col("n") - 1)).cast("long").alias("at")))
    many = (F.col("low") < F.col("high")) & (F.col("n") > few)
    while not (wide := bounds.where(many)).isEmpty():
        inside = live.join(wide, "key").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy("key", "at", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = bins.withColumn("before", before).where("at >= before and at < before + n").select("key", "low", "high", "n", (F.col("at") - F.col("before")).alias("at"))
        bounds = written(bounds.where(~many).unionByName(chosen))
    left = live.join(bounds, "key").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")) & (F.col("low") < F.col("high")))
    ranked = left.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("v"))).where("rn = at + 1")
    single = bounds.where("low = high").select("key", F.col("low").alias("v"))
    return ranked.select("key", "v").unionByName(single).select(F.col("key").alias(key), F.col("v").alias("value"))
