"""Ordinals, nearest positions, runs and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(steps: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, run, value, steps): equal neighbours collapsed, runs numbered from 0."""
    w = Window.partitionBy(group).orderBy(*order)
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = steps.select(group, value, *order, begins.alias("b")).withColumn("run", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(group, "run").agg(F.first(value).alias(value), F.count("*").alias("steps"))


def side_ordinals(cells: DataFrame) -> DataFrame:
    """Cells with the side of their map's box that is nearest (ties N, S, W, E) and their ordinal on it."""
    box = Window.partitionBy("map")
    near = cells.select("*", (F.col("row") - F.min("row").over(box)).alias("n"), (F.max("row").over(box) - F.col("row")).alias("s"), (F.col("col") - F.min("col").over(box)).alias("w"), (F.max("col").over(box) - F.col("col")).alias("e"))
    least = F.least("n", "s", "w", "e")
    side = F.when(F.col("n") == least, "N").when(F.col("s") == least, "S").when(F.col("w") == least, "W").otherwise("E")
    along = F.when(F.col("side").isin("N", "S"), F.col("col")).otherwise(F.col("row"))
    placed = near.withColumn("side", side).withColumn("along", along)
    order = F.row_number().over(Window.partitionBy("map", "side").orderBy("along", "row", "col")) - 1
    return placed.withColumn("ordinal", order).drop("n", "s", "w", "e", "along")


def affine_fit(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of groups with three points or more and some spread."""
    out = points.groupBy(group).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return out.where("n >= 3 and slope is not null")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, key: str, other: str) -> DataFrame:
    """For each left row the right row of the same group whose `at` is nearest; ties go to the least `other`.

    One sort a group instead of a product: the nearest is the last at or before or the first after.
    """
    both = left.select(by, at, F.col(key).alias("l"), F.lit(None).alias("r")).unionByName(right.select(by, at, F.lit(None).alias("l"), F.col(other).alias("r")))
    w = Window.partitionBy(by).orderBy(at)
    point = F.when(F.col("r").isNotNull(), F.struct(F.col(at).alias("x"), F.col("r").alias("r")))
    best = Window.partitionBy(by, at)
    same = both.withColumn("p", F.min(point).over(best))
    found = same.withColumn("before", F.last("p", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("p", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["x"] - F.col(at)).alias("d"), F.col(c)["r"].alias("r")))
    return found.where("l is not null").select(F.col("l").alias(key), F.least(gap("before"), gap("after")).alias("hit")).select(key, F.col("hit.r").alias(other), F.col("hit.d").alias("distance"))
