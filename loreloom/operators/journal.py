"""Bookkeeping of a bundle and of routes: indexes, change log, batches, spread picks, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.operators.positions import runs


def content_namespace(c: Column) -> Column:
    """Whether a namespace holds content: not negative, even, and none of user, project and MediaWiki pages."""
    return (c >= 0) & (c % 2 == 0) & ~c.isin(2, 3, 8)


def directory_index(pages: DataFrame, path: str, title: str) -> DataFrame:
    """(dir, pages, lines): pages of each folder as list lines in the order of their titles."""
    folder = F.regexp_replace(F.col(path), r"/?[^/]*$", "")
    name = F.element_at(F.split(path, "/"), -1)
    entries = F.array_sort(F.collect_list(F.struct(F.col(title).alias("t"), name.alias("n"))))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("* ["), e["t"], F.lit("]("), e["n"], F.lit(".md)"))), "\n")
    return pages.groupBy(folder.alias("dir")).agg(F.count("*").alias("pages"), lines.alias("lines"))


def change_log(changes: DataFrame, day: str, kind: str, title: str) -> DataFrame:
    """(day, section): a section for each day with its changes by kind, counted; newest day first when ordered by day."""
    counted = changes.groupBy(day, kind).agg(F.count("*").alias("n"), F.min(title).alias("first"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "n", "first")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("* **"), r["k"], F.lit("**: "), r["n"].cast("string"), F.lit(" from "), r["first"].cast("string"))), "\n")
    return counted.groupBy(day).agg(F.concat(F.lit("## "), F.first(F.col(day).cast("string")), F.lit("\n"), body).alias("section"))


def batches(rows: DataFrame, group: str, order: str, size: int = 50) -> DataFrame:
    """(group, order, batch): consecutive numbers of batches of `size` rows in each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.select(group, order, F.floor((n - 1) / size).cast("int").alias("batch"))


def spread_pick(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows of each group, evenly spread and centred; all where there are no more."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("of", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((k * 2 + 1) * F.col("of") / (2 * n)))
    return numbered.where((F.col("of") <= n) | F.array_contains(wanted, F.col("i").cast("bigint"))).select(group, order)


def replay_command(steps: DataFrame, route: str, order: str, command: str) -> DataFrame:
    """(route, text): equal neighbouring commands counted, joined into one line to replay."""
    counted = runs(steps, route, [order], command)
    part = F.when(F.col("steps") > 1, F.concat(F.col("steps").cast("string"), F.lit(" "), command)).otherwise(F.col(command))
    rows = F.array_sort(F.collect_list(F.struct("run", part.alias("p"))))
    return counted.groupBy(route).agg(F.concat(F.lit("tue "), F.array_join(F.transform(rows, lambda x: x["p"]), ", ")).alias("text"))
