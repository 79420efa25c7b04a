"""Snapshots compared: changed pages, reusable chunks, equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, change) with Creation, Update or Deprecation; what is equal is left out. One full join on hashes."""
    old = before.select(key, F.sha2(text, 256).alias("old"), F.lit(True).alias("was"))
    new = after.select(key, F.sha2(text, 256).alias("new"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "Creation").when(F.col("is").isNull(), "Deprecation").when(~F.col("old").eqNullSafe(F.col("new")), "Update")
    return old.join(new, key, "full").select(key, kind.alias("change")).where("change is not null")


def apply_changes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """The snapshot after an upsert of what is new and removal of what is gone."""
    kept = before.join(after.select(key), key, "left_semi").join(after, [*after.columns], "left_semi")
    return kept.unionByName(after.join(kept.select(key), key, "left_anti"))


def reuse(before: DataFrame, after: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """Content hashes that both snapshots have, that are missing from the old one, and that were dropped."""
    old, new = (df.select(F.sha2(text, 256).alias("hash")).where("hash is not null").distinct() for df in (before, after))
    return {"reused": new.join(old, "hash", "left_semi"), "missing": new.join(old, "hash", "left_anti"), "dropped": old.join(new, "hash", "left_anti")}


def equal_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hash, first, copies) of texts that occur more than once."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
