import numpy as np

from loreloom.llm.pq import near_duplicate_vectors
from loreloom.llm.registry import op1_pq_near_dedup


def brute(rows, cosine=0.98):
    """rows: (id, label, vector)."""
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ok = [i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, lab, v in rows]
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], links[i], least[root(i)] if r[0] is not None else None, r[0] is None or least[root(i)] == r[0]) for i, r in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r[0], r[2], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = rows_of(op1_pq_near_dedup(spark, sf))
    assert got == brute(rows)


def test_hot_group_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, 1, (base + rng.normal(size=8) * 0.12).tolist()) for i in range(300)] + [(1000 + i, 1, base.tolist()) for i in range(50)]
    rows += [(2000 + i, i % 3, rng.normal(size=8).tolist()) for i in range(100)]
    rows += [(3000, 1, None), (3001, 1, [0.0] * 8), (3002, 1, [float("nan")] * 8), (3003, 1, [None] * 8), (3004, None, base.tolist()), (3005, 1, [1.0, 2.0]), (3006, 1, (3 * base).tolist()), (None, 1, base.tolist()), (3007, 1, [float("inf")] + [1.0] * 7), (3008, 1, [])]
    rows.append(rows[0])  # a repeated row is a vector like any other
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id bigint, label int, embedding array<double>, kept boolean")
    assert rows_of(near_duplicate_vectors(df, lists=8, sample=100)) == brute(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * n + i, i % 2, (1 + rng.normal(size=n) * 0.15).tolist()) for n, of in ((8, 30), (3, 12), (5, 9)) for i in range(of)] + [(1, 1, [2.0, 2.0]), (2, 1, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert rows_of(near_duplicate_vectors(df, lists=4, sample=100)) == brute(rows)


def test_recall_with_many_lists(spark):
    """Links found against brute force, with every pair near the threshold and as many lists as a large table has."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(150, 64))
    near = [c / np.linalg.norm(c) + d / np.linalg.norm(d) * 0.19 for c in centre for d in rng.normal(size=(4, 64))]
    rows = [(i, 1, v.tolist()) for i, v in enumerate([*near, *(c / np.linalg.norm(c) for c in centre), *rng.normal(size=(600, 64))])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    unit = np.array([np.array(r[2], np.float32).astype(float) for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum() - len(rows)
    got = sum(r["n_links"] for r in near_duplicate_vectors(df, lists=64).collect())
    assert want > 1000 and 0.99 * want <= got <= want
