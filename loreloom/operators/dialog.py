"""Conversations: last question, bounded history, context text, replies without thoughts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import wants_route


def last_question(turns: DataFrame, tail: int = 1200) -> DataFrame:
    """(conv_id, question): the tail of the last user turn."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", F.right("text", F.lit(tail)).alias("question"))


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, from the first user turn among them on."""
    recent = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)
    started = F.max((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return recent.withColumn("started", started).where("started = 1").select("conv_id", "turn", "role", "text")


def context(turns: DataFrame, n: int = 6, tail: int = 2000) -> DataFrame:
    """(conv_id, context): the last n turns as lines of role and text, cut to the tail."""
    recent = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return recent.groupBy("conv_id").agg(F.right(joined, F.lit(tail)).alias("context"))


def route_questions(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").select("conv_id", "turn", wants_route("text").alias("wants_route"))
