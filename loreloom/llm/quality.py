"""Quality classification by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of target text (the labelled good
documents) and one of all raw text, give every document a log importance ratio. Gumbel noise
that depends on the document alone turns ranking by it into sampling without replacement, and
the best k documents stay.

Counts of the raw model cover all documents. The target model is fitted on the labelled
documents, at most `max_labelled` of them, taken in the order of a hash of their ids. Models
count documents that have a feature, since one document can repeat a word at will: words,
pairs of words, shapes of words and repeats of a word, in a table for 1- and one for
2-grams. A bucket's weight is the signed log ratio of target to raw, smoothed by `PRIOR`
expected occurrences; every bucket counts, multiplied by z^4 / (z^4 + 2^4), where z is the
ratio in standard errors, so that noise over thousands of ordinary words doesn't drown the few
that tell; half the ratio counts at two standard errors. A labelled good document is judged by weights that leave its
own occurrences out of the target, as an unlabelled one is, or it would look better than all others.

For each table the mean weight is taken over a document's features, so that length alone moves
nothing. The threshold is the sum of the two means that best parts good from bad labelled
documents; a document's ratio is what its sum exceeds it by, times its number of features.
Gumbel noise of scale `TEMPERATURE` is added to that. k is the number of documents with a
positive ratio, so that the share kept follows the corpus.

The k-th largest key is found by counting keys in ever narrower bins, never by sorting in one
task; documents that tie with it stay too.

Defined cases: a document without words has ratio minus infinity and is rejected; labels that
are null are not used, a null toxic label counts as 0; without usable labels of either kind
nothing can be told apart and every document with words stays; repeated rows are judged
alike; a null id is judged like any other. Columns of the same names as results are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.scratch import Scratch

#: Of each of the two tables.
BUCKETS = 1 << 18
MAX_LABELLED = 200_000
PRIOR = 5.0
#: A good document lost weighs as much as so many bad ones kept.
CARE = 3
TEMPERATURE = 1.0
_SIZE, _PART = 2 * BUCKETS, 1 << 14


#: Letters, digits and other bytes as a word's shape shows them.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[48:58] = 48


def _shapes(w: ts.Words) -> np.ndarray:
    """Hashes of the words' shapes: runs of one class of bytes, each as one byte."""
    n = w.end - w.start
    first = np.cumsum(n) - n
    shape = _SHAPE[w.data[np.repeat(w.start - first, n) + np.arange(int(n.sum()))]]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[first] = True
    size = np.add.reduceat(keep.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    end = np.cumsum(size)
    return ts.hash_spans(shape[keep], end - size, end)


def _grams(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every distinct feature of each row.

    Features are words and pairs of words; and, with the binary order of magnitude of their
    share of the row's words, shapes of words and immediate repeats of a word.
    """
    row = w.row_of()
    n_words = np.diff(w.first)
    h2, at = ts.windows(w, 2)
    again = at[w.hash[at] == w.hash[at + 1]] if len(at) else at
    shaped = np.concatenate([_shapes(w), np.zeros(len(again), np.uint64)])
    owner = np.concatenate([row, row[again]])
    order = np.lexsort((shaped, owner))
    shaped, owner = shaped[order], owner[order]
    new = np.ones(len(shaped), bool)
    new[1:] = (shaped[1:] != shaped[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(shaped)))
    share = np.floor(np.log2(count / n_words[owner[begin]])).astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    level = ts.mix(shaped[begin] + (64 + share).astype(np.uint64))
    half = np.uint64(BUCKETS)
    bucket = np.concatenate([w.hash % half, level % half, h2 % half + half]).astype(np.int64)
    found = ts.distinct(np.concatenate([row, owner[begin], row[at]]) * _SIZE + bucket)
    return found % _SIZE, found // _SIZE


def _count(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in ts.slices(batches, text):
        w = ts.words(batch.column(text), ts.NON_SPACE)
        bucket, row = _grams(w)
        label = batch.column("__label").to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
        for kind in np.unique(label).tolist():
            seen = np.bincount(bucket[label == kind], minlength=_SIZE).astype(np.uint32)
            total[kind] = total.get(kind, 0) + seen
    for kind, counts in total.items():
        for part in range(_SIZE // _PART):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([counts[part * _PART : (part + 1) * _PART].tobytes()], pa.binary())], names=["kind", "part", "counts"])


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_PART, np.int64)
    for batch in batches:
        for value in batch.column("counts"):
            total += np.frombuffer(value.as_py(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["kind", "part", "counts"])


def gram_counts(docs: DataFrame, text: str) -> dict[int, np.ndarray]:
    """Bucket counts by `__label`: 0 none, 1 good, 2 bad. Tasks send vectors of a fixed size, added up by part."""
    counted = docs.select(text, "__label").mapInArrow(partial(_count, text=text), "kind int, part int, counts binary")
    out: dict[int, np.ndarray] = {}
    for row in counted.groupBy("kind", "part").applyInArrow(_add, "kind int, part int, counts binary").collect():
        out.setdefault(row["kind"], np.zeros(_SIZE, np.int64))[row["part"] * _PART : (row["part"] + 1) * _PART] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out


def _weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Signed log ratios of all buckets, each as far as it stands out from its sampling noise.

    Two rows: as they are, and for a document that is itself in the target.
    """
    weights = np.zeros((2, _SIZE))
    for table in (slice(0, BUCKETS), slice(BUCKETS, _SIZE)):
        expected = raw[table] * (target[table].sum() / max(1, raw[table].sum())) + PRIOR
        for own in (0, 1):
            seen = np.maximum(target[table] - own, 0) + PRIOR
            ratio = np.log(seen / expected)
            z = ratio / np.sqrt(1 / seen + 1 / expected)
            weights[own, table] = ratio * z**4 / (z**4 + 2**4)
    return weights


def _score(batches: Iterator[pa.RecordBatch], text: str, weights, keep: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in ts.slices(batches, text):
        bucket, row = _grams(ts.words(batch.column(text), ts.NON_SPACE))
        n = np.bincount(row, minlength=batch.num_rows)
        own = (batch.column("__label").to_numpy(zero_copy_only=False) == 1).astype(np.int64)
        weight = weights.value[own[row], bucket]
        mean = np.zeros(batch.num_rows)
        for of in (bucket < BUCKETS, bucket >= BUCKETS):
            mean += np.bincount(row[of], weights=weight[of], minlength=batch.num_rows) / np.maximum(1, np.bincount(row[of], minlength=batch.num_rows))
        kept = [c for c in batch.schema.names if keep or c != text]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(np.where(n > 0, mean, -np.inf))], names=[*kept, "n_grams", "mean"])


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least weighted sum of the shares that it puts on the wrong side, in the middle of its gap."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    wrong = CARE * np.searchsorted(np.sort(good), values, "right") / len(good) + 1 - np.searchsorted(np.sort(bad), values, "right") / len(bad)
    at = int(np.argmin(wrong))
    if wrong[at] >= 1:  # no cut is better than none
        return -np.inf
    return float((values[at] + values[min(at + 1, len(values) - 1)]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest finite value, by counting in ever narrower bins; -inf where there are fewer."""
    values = df.where(F.col(column) > float("-inf"))
    low, high, n = values.agg(F.min(column), F.max(column), F.count("*")).first()
    if k <= 0:
        return float("inf")
    if n is None or k >= n:
        return float("-inf")
    above = 0
    while high > low:
        width = (high - low) / 1024
        if width == 0 or low + width == low:
            break
        bins = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(bins.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                break
            above += counts[b][0]
        if (counts[b][1], counts[b][2]) == (low, high):
            break
        low, high = counts[b][1], counts[b][2]
    return low


def _luck(key: str):
    return (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(29)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _sample_key(key: str, temperature: float):
    return F.when(F.col("n_grams") > 0, F.col("ratio") - F.log(-F.log(_luck(key))) * temperature).otherwise(float("-inf"))


class Resampler:
    """Models of target and raw text, and the least sample key of the documents that stay.

    Two passes over the texts: one counts, one scores. With `carry` the second writes the documents
    beside their scores, so that `kept` reads what was written instead of judging again.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, temperature: float = TEMPERATURE, carry: bool = False):
        self.key, self.text, self.temperature, self.columns = key, text, temperature, docs.columns if carry else None
        scratch = Scratch(docs.sparkSession, "quality")
        usable = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        known = usable.select("__id", F.when((F.col("q") == 1) & (F.col("t") == 0), F.lit(1)).otherwise(F.lit(2)).alias("__label"))
        self.sample = scratch.cut(known.orderBy(F.xxhash64("__id", F.lit(17))).limit(max_labelled), "labelled")
        names = [f"__{i}" for i in range(len(docs.columns))] if carry else ["__key", "__text"]
        renamed = docs.toDF(*names) if carry else docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        self.names, self.at, at = names, *((names[docs.columns.index(c)] for c in (key, text)) if carry else names)
        marked = self._marked(renamed, self.at)
        counts = gram_counts(marked, at)
        none = np.zeros(_SIZE, np.int64)
        target = counts.get(1, none)
        self.weights = docs.sparkSession.sparkContext.broadcast(_weights(target, counts.get(0, none) + target + counts.get(2, none)))
        kept = ", ".join(f"{n} {t}" for n, t in marked.dtypes if carry or n != at)
        scored = scratch.cut(marked.mapInArrow(partial(_score, text=at, weights=self.weights, keep=carry), f"{kept}, n_grams bigint, mean double"), "scored")
        seen = scored.where("__label > 0 and n_grams > 0").orderBy(F.xxhash64(self.at, F.lit(23))).select("__label", "mean").limit(2 * max_labelled).toPandas()
        cut = _threshold(seen["mean"][seen["__label"] == 1].to_numpy(), seen["mean"][seen["__label"] == 2].to_numpy())
        self.cut = cut if np.isfinite(cut) else 0.0
        self.scored = self._keyed(scored, self.at)
        self.k = self.scored.where("ratio > 0" if np.isfinite(cut) else "n_grams > 0").count()
        self.least = kth_largest(self.scored, "sample_key", self.k)

    def _marked(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with `__label`: 0 none, 1 good, 2 bad."""
        return rows.join(F.broadcast(self.sample), F.col(key) == F.col("__id"), "left").select(*rows.columns, F.coalesce("__label", F.lit(0)).alias("__label"))

    def _keyed(self, scored: DataFrame, key: str) -> DataFrame:
        ratio = F.when(F.col("n_grams") > 0, (F.col("mean") - F.lit(self.cut)) * F.col("n_grams")).otherwise(float("-inf"))
        return scored.withColumn("ratio", ratio).withColumn("sample_key", _sample_key(key, self.temperature))

    def _selected(self):
        return (F.col("n_grams") > 0) & (F.col("sample_key") >= F.lit(self.least))

    def judged(self) -> DataFrame:
        """key, n_grams, ratio (log importance above the threshold), sample_key (ratio plus Gumbel noise) and selected of every row."""
        return self.scored.select(F.col(self.at).alias(self.key), "n_grams", "ratio", "sample_key", self._selected().alias("selected"))

    def filter(self, docs: DataFrame) -> DataFrame:
        """The rows of any docs that the fitted models select, with their columns; texts are judged where they lie, without a shuffle."""
        names = [f"__{i}" for i in range(len(docs.columns))]
        key, at = (names[docs.columns.index(c)] for c in (self.key, self.text))
        marked = self._marked(docs.toDF(*names), key)
        types = ", ".join(f"{n} {t}" for n, t in marked.dtypes)
        scored = marked.mapInArrow(partial(_score, text=at, weights=self.weights, keep=True), f"{types}, n_grams bigint, mean double")
        return self._keyed(scored, key).where(self._selected()).select(*names).toDF(*docs.columns)

    def kept(self) -> DataFrame:
        """The fitted rows that are selected, with all their columns; it takes `carry`."""
        if self.columns is None:
            raise ValueError("kept() needs carry=True")
        return self.scored.where(self._selected()).select(*self.names).toDF(*self.columns)


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Resampler.judged of docs."""
    return Resampler(docs, labels, **options).judged()
