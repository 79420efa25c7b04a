import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

from loreloom.llm import lm_score
from loreloom.llm.lm_score import score_documents
from loreloom.llm.registry import op8_lm_score

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*_WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())), None]


def check(rows, docs):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    counts = Counter(t for d, text in docs if not held[d] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, text in docs:
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))
        expected[d, held[d], len(tokens(text)), sum(t in counts for t in tokens(text)), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == expected
    assert all(r["score"] <= 0 for r in rows)


def test_query(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op8_lm_score(spark, sf).collect()
    check(rows, docs)
    held = [r for r in rows if r["held_out"]]
    # Seen pairs help on text that was held out, too.
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark):
    docs = [(i, f"some words {i % 3} again and again") for i in range(40)] + [(50, None), (51, ""), (52, "x " * 50_000), (3, "twice"), (3, "twice"), (None, "no id"), (60, "É é A a")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id bigint, text string, score double")
    for exact in (1 << 18, 3):
        check(score_documents(df, exact_tokens=exact).collect(), docs)
    assert score_documents(df.limit(0)).count() == 0


def test_filter_beyond_one_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = lambda: sorted((r["doc_id"], r["score"]) for r in score_documents(docs).collect())
    whole = score()
    monkeypatch.setattr(lm_score, "MAX_BYTES", 5 * lm_score._BLOCK)
    assert score() == whole


def test_filter_in_pieces(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = lambda: sorted((r["doc_id"], r["score"]) for r in score_documents(docs).collect())
    whole = score()
    monkeypatch.setattr(lm_score, "PIECE", 2 * lm_score._BLOCK)
    assert score() == whole
    monkeypatch.setattr(lm_score, "MAX_BYTES", 5 * lm_score._BLOCK)
    assert score() == whole


def test_driver_holds_no_filter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(lm_score, "BITS", 2000)
    monkeypatch.setattr(lm_score, "PIECE", 1 << 19, raising=False)
    context, sent = type(spark.sparkContext), []
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or real(self, value))
    tracemalloc.start()
    try:
        score_documents(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sent) > 20 << 20
    assert most < 8 << 20


def test_frequent_tokens(spark):
    counts = [(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [3] * 5 + [10**6, 10**9])]
    single = spark.createDataFrame(counts, "h bigint, n bigint")
    for most, least in ((1, 10**9), (2, 10**6), (6, 10**6), (7, 3), (26, 3), (27, 2), (77, 1), (10**6, 1)):
        assert sorted(x["h"] for x in lm_score._frequent(single, most).to_pylist()) == [h for h, n in counts if n >= least]
    assert lm_score._frequent(single, 0).num_rows == 0
    assert lm_score._frequent(single.limit(50), 49).num_rows == 0
