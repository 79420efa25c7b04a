import random
import re

from loreloom.llm import components, minhash
from loreloom.llm.minhash import near_duplicates
from loreloom.llm.registry import op5_minhash
from loreloom.llm.scratch import Scratch

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = _WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent=80):
    """Expected (id, size, component, kept) by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shared = {}
    for i, (d, s) in enumerate(sets):
        for x in s if d is not None else ():
            shared.setdefault(x, []).append(i)
    seen = set()
    for group in shared.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= percent * len(a | b):
                        parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least[root(i)] if d is not None else None, d is None or least[root(i)] == d) for i, (d, s) in enumerate(sets)), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def test_query(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(op5_minhash(spark, sf))
    assert got == brute(docs, 4)
    assert not all(r[3] for r in got)


def test_hot_groups_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=200)
    docs = []
    for i in range(700):  # near copies of one text, a chain of them, and some just below the threshold
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 9, 12])):
            copy[rng.randrange(200)] = rng.choice(words)
        docs.append((1000 + i, " ".join(copy)))
    passage = " ".join(rng.choices(words, k=12))
    docs += [(3000 + i, passage + " " + " ".join(rng.choices(words, k=60))) for i in range(400)]
    docs += [(5000 + i, "the very same text of six words") for i in range(300)]
    docs += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "one two three"), (7, "one two three"), (8, "x " * 50_000), (9, "x x x x x"), (7, "one two three"), (10, "é É"), (11, "É É")]
    df = spark.createDataFrame([(d, t, True, 0) for d, t in docs], "doc_id bigint, text string, kept boolean, n bigint").repartition(4)
    assert rows(near_duplicates(df, shingle=4)) == brute(docs, 4)
    assert near_duplicates(df.limit(0)).count() == 0


def test_jobs_do_not_grow_with_partitions(spark):
    """A driver that runs a job for every shuffle partition, and rounds for a few links, takes most of the time of a small table."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=100)
    docs = [(i, " ".join(rng.choice(words) if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    jobs, was, sc = {}, spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    try:
        for n in (4, 24):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            sc.setJobGroup(f"minhash-{n}", "test")
            assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), shingle=4)) == brute(docs, 4)
            jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"minhash-{n}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for name in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(name, None)
    assert jobs[24] <= jobs[4] + 8, jobs


def test_nodes_that_are_mostly_one_component_are_not_branched(spark):
    rows = [(1, i, 10, 7 if i >= 20 else i) for i in range(minhash.NODE + 100)] + [(2, i, 10, i) for i in range(minhash.NODE + 100)] + [(3, i, 10, 5) for i in range(9)]
    rows += [(4, i, 10, i % 2) for i in range(minhash.WIDE + 1)] + [(5, 1, minhash.ITEMS, 1), (5, 2, 9, 1), (5, 3, 9, 2), (6, 1, minhash.ITEMS, 1), (6, 3, 9, 2)]
    level = spark.createDataFrame(rows, "node bigint, rep bigint, n bigint, comp bigint")
    join = minhash._Join(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", "text", 4, 80)
    assert {r["node"]: r["small"] for r in join.mixed(level).collect()} == {1: True, 2: False, 4: False, 5: False, 6: True}


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (None, 5), (2000, 2000)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    star, rounds = components._star, []
    monkeypatch.setattr(components, "_star", lambda *x: rounds.append(1) or star(*x))
    whole = sorted(map(tuple, components.components(df, Scratch(spark, "t")).collect()))
    assert not rounds
    monkeypatch.setattr(components, "WHOLE", 0)
    assert whole == sorted(map(tuple, components.components(df, Scratch(spark, "t")).collect()))
    assert rounds and dict(whole)[1100] == 1000 and 2000 not in dict(whole) and len(dict(whole)) == len(whole)
    text = components.components(df.selectExpr("cast(a as string) a", "cast(b as string) b"), Scratch(spark, "t"))
    assert len(text.collect()) == len(whole)
    assert components.components(df.limit(0), Scratch(spark, "t")).count() == 0
