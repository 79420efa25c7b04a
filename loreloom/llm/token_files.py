"""Token counts by a separator scan of flat token files.

A token file is a run of little-endian 16-bit ids and nothing else; documents end with the
end-of-document id, and one may go on in the next file of its part. The scan searches whole
files for that id at once and notes where it stands. A prefix scan over the files of a part
then gives every file the position where its first document began, so that counts are right
across files, and the ordinal of that document.

Defined cases: a null or empty text is a document of no tokens; ids after the last separator
of a part are a document that isn't ended; a folder without files gives no rows; repeated
rows are documents of their own.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.scratch import Scratch
from loreloom.llm.tokenize import PieceEncoder

FILE_BYTES = 4 << 20
_NAME = re.compile(r"part-(\d+)-(\d+)\.bin$")


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, pattern: str, end: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    encoder, part = PieceEncoder(path, pattern), TaskContext.get().partitionId()
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    attempt, ordinal, number = TaskContext.get().taskAttemptId(), 0, 0
    kept = b""

    def flush(data: bytes) -> None:
        nonlocal number
        name = posixpath.join(root, f"part-{part:05d}-{number:06d}.bin")
        with files.open_output_stream(f"{name}.{attempt}") as out:
            out.write(data)
        files.move(f"{name}.{attempt}", name)
        number += 1

    for batch in ts.slices(batches, "text"):
        ids, bounds = encoder.encode(batch.column("text"))
        kept += np.insert(ids.astype("<u2"), bounds[1:], end).tobytes()
        while len(kept) >= file_bytes:
            flush(kept[:file_bytes])
            kept = kept[file_bytes:]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(ordinal, ordinal + n), pa.int64()), batch.column("key")], names=["part", "ordinal", "key"])
        ordinal += n
    if kept:
        flush(kept)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end: int, *, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs as token files below folder, a URI; returns (part, ordinal, key), which must be read once only."""
    if end >= 1 << 16 or file_bytes % 2:
        raise ValueError("ids are 16 bits wide and files hold whole ids")
    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1], recursive=True)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(partial(_write, folder=folder, path=vocabulary, pattern=pattern, end=end, file_bytes=file_bytes), f"part bigint, ordinal bigint, key {dict(source.dtypes)['key']}")


def _find(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            m = _NAME.search(path.as_py())
            ids = np.frombuffer(content.as_buffer(), "<u2")
            at = np.flatnonzero(ids == end)
            yield pa.RecordBatch.from_arrays([pa.array([int(m[1])]), pa.array([int(m[2])]), pa.array([len(ids)]), pa.array([at.tolist()], pa.list_(pa.int32()))], names=["part", "file", "n", "ends"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, ordinal, start, last, ends, n, final in zip(*(batch.column(c) for c in ("part", "ordinal", "start", "last", "ends", "n", "final")), strict=True):
            at = ends.values.to_numpy() + start.as_py()
            count = np.diff(at, prepend=last.as_py()) - 1
            ended = np.ones(len(count), bool)
            stop = start.as_py() + n.as_py()
            rest = stop - (at[-1] if len(at) else last.as_py()) - 1
            if final.as_py() and rest:
                count, ended = np.append(count, rest), np.append(ended, False)
            first = ordinal.as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), part.as_py()), pa.int64()), pa.array(np.arange(first, first + len(count)), pa.int64()), pa.array(count, pa.int64()), pa.array(ended)], names=["part", "ordinal", "n_tokens", "ended"])


def count_tokens(spark: SparkSession, folder: str, end: int) -> DataFrame:
    """(part, ordinal, n_tokens, ended) of every document in the token files of a folder."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    found = Scratch(spark, "separators").cut(read.mapInArrow(partial(_find, end=end), "part bigint, file bigint, n bigint, ends array<int>"), "found")
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    facts = found.select("part", "file", "n", F.size("ends").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("tail"))
    facts = facts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    facts = facts.withColumn("last", F.coalesce(F.max(F.col("start") + F.col("tail")).over(before), F.lit(-1)))
    facts = facts.withColumn("final", F.lead("file").over(Window.partitionBy("part").orderBy("file")).isNull())
    whole = found.select("part", "file", "ends", "n").join(facts.select("part", "file", "start", "ordinal", "last", "final"), ["part", "file"])
    return whole.mapInArrow(_lengths, "part bigint, ordinal bigint, n_tokens bigint, ended boolean")


def document_token_counts(docs: DataFrame, vocabulary: str, pattern: str, end: int, *, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """key and n_tokens of every row: writes token files, scans them, and names the documents again."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("flat")
    names = scratch.cut(write_token_files(docs, folder, vocabulary, pattern, end, key=key, text=text, file_bytes=file_bytes), "names")
    if names.isEmpty():
        return names.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_tokens"))
    return names.join(count_tokens(spark, folder, end), ["part", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
