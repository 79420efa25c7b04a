"""Stored tables of the engine: catalog, rooms, vectors, archives and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreloom.operators.search import Index


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """Rows of JSON files, one object a line or a file; files and lines that aren't of the schema are left out; None where there are none."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_index(index: Index, path: str, partitions: int = 64) -> None:
    """A search index whose postings lie in ranges of terms, so that a query reads the few row groups that hold its own."""
    write_table(index.postings.repartitionByRange(partitions, "term").sortWithinPartitions("term", "doc_id"), f"{path}/postings")
    write_table(index.frequencies.repartitionByRange(max(1, partitions // 8), "term").sortWithinPartitions("term"), f"{path}/frequencies")
    write_table(index.lengths, f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> Index | None:
    found = [read_table(spark, f"{path}/{part}") for part in ("postings", "frequencies", "lengths")]
    return None if any(x is None for x in found) else Index(*found)


def removed(archive: DataFrame, gone: DataFrame, key: str = "concept_id") -> DataFrame:
    """What is left of an archive of sources without the pages that are gone."""
    return archive.join(gone.select(key), key, "left_anti")


def archived(archive: DataFrame, new: DataFrame, key: str = "concept_id") -> DataFrame:
    """An archive with new sources in place of old ones."""
    return removed(archive, new, key).unionByName(new)


def manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The state of the last sync; empty where there is none or it can't be read."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.limit(1).count()
        return found
    except Exception as e:  # noqa: BLE001 - whatever is wrong with it, the sync begins anew
        if "java.lang.OutOfMemoryError" in str(e):
            raise
        return spark.createDataFrame([], schema)


def synced(before: DataFrame, live: DataFrame, full: bool) -> DataFrame:
    """(title, concept_id, action) of a sync: create, update, skip, rename or delete.

    Both: title, concept_id, revid, contenthash. A page of the same revision, or of the same content in a
    new one, is skipped; one whose file moved is renamed. Pages are only found to be gone by a full scan.
    """
    old = before.select("title", F.col("concept_id").alias("old_id"), F.col("revid").alias("old_revid"), F.col("contenthash").alias("old_hash"))
    joined = live.join(old, "title", "full")
    action = (
        F.when(F.col("concept_id").isNull(), "delete")
        .when(F.col("old_id").isNull(), "create")
        .when(F.col("concept_id") != F.col("old_id"), "rename")
        .when(F.col("revid").eqNullSafe(F.col("old_revid")) | F.col("contenthash").eqNullSafe(F.col("old_hash")), "skip")
        .otherwise("update")
    )
    out = joined.select("title", F.coalesce("concept_id", "old_id").alias("concept_id"), action.alias("action"))
    return out if full else out.where("action <> 'delete'")
