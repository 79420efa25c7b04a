import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loreloom.llm.decontaminate import benchmark_hits, decontaminate
from loreloom.llm.registry import op2_decontaminate

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return _WORD.findall(low)


def brute(docs, items, n=10):
    known = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            known.setdefault(tuple(w[i : i + k]), set()).update([] if item is None else [str(item)])
    lengths = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                found = known.get(tuple(w[i : i + k]))
                if found is not None:
                    names |= found
                    hit |= set(range(i, i + k))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in op2_decontaminate(spark, sf).collect()), key=str)
    assert got == brute(docs, items)
    assert any(x[5] for x in got)


SENTENCE = "one two three four five six seven eight nine ten eleven"
DOCS = [(1, f"Before! {SENTENCE.upper()} after", "x"), (2, None, "x"), (3, "", "x"), (4, "clean text only", "x"), (11, "some clean words", "x"), (1, f"Before! {SENTENCE.upper()} after", "x"), (None, "short item here", "x"), (5, "a " * 60_000 + SENTENCE, "x"), (6, "short, item; and more", "x"), (7, "École " + SENTENCE[:-7], "x")]
ITEMS = [(10, SENTENCE), (11, "Short item"), (12, None), (13, "..."), (10, SENTENCE), (2, "five six seven eight nine ten eleven"), (None, "clean words")]


@pytest.fixture()
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, n_hit string")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_odd_rows(tables, limit):
    docs, items = tables
    out = benchmark_hits(docs, items, max_windows=limit).select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("s"), (F.col("n_hit") > 0).alias("c"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute([(d, t) for d, t, _ in DOCS], ITEMS)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_removal(tables, limit):
    docs, items = tables
    left = decontaminate(docs, items, max_windows=limit)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    spans = {(r["doc_id"], r["text"]) for r in decontaminate(docs, items, action="spans", max_windows=limit).collect()}
    assert (1, "Before!  after") in spans and (4, "clean text only") in spans and (2, None) in spans and (6, ", item; and more") not in spans


def test_empty_tables(spark, tables):
    docs, items = tables
    assert benchmark_hits(docs.limit(0), items).count() == 0
    assert all(r["n_hit"] == 0 for r in benchmark_hits(docs, items.limit(0)).collect())
    assert decontaminate(docs, items.limit(0)).count() == len(DOCS)
