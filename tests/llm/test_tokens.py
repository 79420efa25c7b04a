from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loreloom.llm import bpe
from loreloom.llm.packing import best_fit_decreasing, pack_documents
from loreloom.llm.registry import END_OF_DOCUMENT, op6_token_counts, op9_packing
from loreloom.llm.token_files import document_token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = [(i, f"some words {i} and more " * (i % 7)) for i in range(60)] + [(100, None), (101, ""), (102, "x y " * 9000), (5, "again"), (5, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def encode():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH)) if t}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library.encode_ordinary(text or "")


def documents(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts(spark, sf, encode):
    assert sorted(map(tuple, op6_token_counts(spark, sf).collect())) == sorted((d, len(encode(t))) for d, t in documents(spark, sf))


@pytest.mark.parametrize("file_bytes", [2, 64, 4 << 20])
def test_token_counts_across_files(spark, encode, file_bytes):
    docs = DOCS if file_bytes > 2 else DOCS[:20]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, n_tokens int").coalesce(2)
    out = document_token_counts(df, PATH, public_tokenizers.PATTERN, END_OF_DOCUMENT, file_bytes=file_bytes)
    assert Counter(map(tuple, out.collect())) == Counter((d, len(encode(t))) for d, t in docs)
    assert document_token_counts(df.limit(0), PATH, public_tokenizers.PATTERN, END_OF_DOCUMENT).count() == 0


def check_packs(rows, docs, encode, length):
    found = defaultdict(list)
    for r in rows:
        ids, at = np.frombuffer(bytes(r["input_ids"]), "<u2"), np.frombuffer(bytes(r["position_ids"]), "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == len(at) == length and cu[-1] == r["n_tokens"] and (ids[cu[-1] :] == END_OF_DOCUMENT).all()
        for doc, offset, a, b in zip(r["doc_ids"], r["doc_offsets"], cu, cu[1:], strict=False):
            assert at[a:b].tolist() == list(range(b - a))
            found[doc].append((offset, ids[a:b].tolist()))
    expected = defaultdict(list)
    for d, t in docs:
        ids = encode(t)
        expected[d] += [(i, ids[i : i + length]) for i in range(0, len(ids), length)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items() if v}


def test_packing(spark, sf, encode):
    rows = op9_packing(spark, sf).collect()
    check_packs(rows, documents(spark, sf), encode, 2048)
    assert sum(r["n_tokens"] for r in rows) > 0.95 * 2048 * len(rows)


def test_packing_odd_rows(spark, encode):
    df = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id bigint, text string, pack int").coalesce(2)
    for pool in (100, 1 << 20):
        check_packs(pack_documents(df, PATH, public_tokenizers.PATTERN, pad=END_OF_DOCUMENT, length=32, pool=pool).collect(), DOCS, encode, 32)
    assert pack_documents(df.limit(0), PATH, public_tokenizers.PATTERN, pad=0).count() == 0


def test_best_fit():
    sizes = np.random.default_rng(1).integers(1, 101, 500)
    rows = best_fit_decreasing(sizes, 100)
    assert sorted(p for r in rows for p in r) == list(range(500))
    # Against a plain search for the fullest row that has room.
    plain: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [i for i, used in enumerate(plain) if used + s <= 100]
        if fit:
            best = max(fit, key=lambda i: plain[i])
            plain[best] += s
        else:
            plain.append(s)
    assert sorted(sum(int(sizes[p]) for p in r) for r in rows) == sorted(plain)
