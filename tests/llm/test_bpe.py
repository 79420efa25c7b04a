import hashlib
import os
import random
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from loreloom.llm import bpe
from loreloom.llm.registry import op7_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def row(library, doc, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in op7_bpe(spark, sf).collect()) == sorted(row(library, r[0], r[1]) for r in docs)


def test_odd_texts(spark, library):
    rng = random.Random(3)
    alphabet = "ab's tremdvlSTI'  \n\t é日本1२.!, ' ' \U0001f600"
    texts = [None, "", " ", "'", "a'", "'s", "x 'll'd", "a" * 3000, "<|endoftext|>", "\x00\x1f", "word " * 30_000, "日本" * 900] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)]
    rows = [(i, t, [1]) for i, t in enumerate(texts)] + [(0, None, [2]), (None, "no id", [3]), (3, "'", [4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = bpe.encode(df, PATH).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(((d, library.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str) == sorted((row(library, d, t) for d, t, _ in rows), key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    plain = bpe.encode(df, PATH).select(bpe.decode("ids", PATH).alias("raw")).collect()
    assert sorted(bytes(r["raw"]) for r in plain) == sorted((t or "").encode() for _, t, _ in rows)


def test_memory_of_words_is_bounded(spark, library):
    texts = [f"some words {i} and {i * 7} others" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(2)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, PATH, remember=10, slice_bytes=50).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_rows_between_the_steps_stay_small():
    texts = [f"word{i} " * 100 for i in range(6000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    total = sum(map(len, texts))
    rows = [r for out in bpe._words_of("doc_id", "text", None, bpe.REMEMBER, bpe.SLICE_BYTES)(iter([batch])) for r in out.select(["keys", "at"]).to_pylist()]
    assert [k for r in rows for k in r["keys"]] == list(range(len(texts)))
    assert len(rows) >= total >> 20
    # A quarter of 1 MB at least is left for the words that are new.
    assert max(len(r["at"]) for r in rows) <= 3 << 18


#: A worker frees 30 MB in blocks too small to be mapped one by one, and then takes a batch.
_WORKER = """
import re, sys
import numpy as np, pyarrow as pa
from loreloom.llm import textscan as ts

def mb():
    return sum(map(int, re.findall(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

batch = pa.record_batch([pa.array(["a b"])], names=["text"])
list(ts.slices(iter([batch])))
np.ones(20 << 20, np.uint8)  # freed, it makes blocks under 20 MB come from the heap
before = mb()
blocks = [np.ones(1 << 20, np.uint8) for _ in range(30)]
del blocks
list(ts.slices(iter([batch])))
print(mb() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_workers_give_freed_memory_back():
    kept = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, timeout=60).stdout
    assert float(kept) < 10
