import random

import pytest
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import catalog, graph, raster, sync
from loreloom.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.search_tokens(lit("Der Händler, ein SCHLOẞ größe x"))) == ["haendler", "schloss", "groesse"] or one(spark, tx.search_tokens(lit("Der Händler größe x"))) == ["haendler", "groesse"]
    assert one(spark, tx.compound_aliases(lit("Rätsel/Pflicht"))) == ["PflichtRätsel"]
    assert one(spark, tx.compound_aliases(lit("Rätsel/Pflicht/Campus"))) == ["PflichtRätsel Campus", "Campus PflichtRätsel"]
    assert one(spark, tx.compound_aliases(lit("plain"))) == []
    assert one(spark, tx.without_citations(lit("a\n# Citations\n[1] b"))) == "a"
    assert one(spark, tx.without_thoughts(lit("x</think>\n answer "))) == "answer"
    assert one(spark, tx.shortened(lit("a" * 181), 180)) == "a" * 180 + "…"
    assert [one(spark, tx.yaml_scalar(lit(x))) for x in ("plain", "", "12", "true", "a: b", 'q"')] == ["plain", '""', '"12"', '"true"', '"a: b"', '"q\\""']
    assert one(spark, tx.wants_route(lit("Wie komme ich von A nach B?"))) and not one(spark, tx.wants_route(lit("Was ist ein Umweg?")))


GOLDENS = [
    (["     ".replace(" ", "."), "=====", "....."], (0, 0), (0, 4), lambda path, kind: any(kind[p] == "road" for p in path)),
    (["..", " .", ".."], (0, 0), (2, 0), lambda path, kind: all(kind[p] != "ocean" for p in path)),
    (["..~~~.."], (0, 0), (0, 6), lambda path, kind: sum(kind[p] == "water" for p in path) == 3),
    ([".~~~~.", "......"], (0, 0), (0, 5), lambda path, kind: "wwww" not in "".join("w" if kind[p] == "water" else "." for p in path)),
]


@pytest.mark.parametrize("grid,start,goal,good", GOLDENS)
def test_walks(spark, grid, start, goal, good):
    kinds = {".": "grass", "=": "road", " ": "ocean", "~": "water"}
    kind = {(r, c): kinds[x] for r, line in enumerate(grid) for c, x in enumerate(line)}
    rows = [("m", r, c, k, False, *start, *goal) for (r, c), k in kind.items()]
    df = spark.createDataFrame(rows, "region string, row int, col int, terrain string, blocked boolean, from_row int, from_col int, to_row int, to_col int")
    got = raster.routes(df, raster.COSTS | {"sand": 4, "water": 6, "ocean": 12}).first()
    path = [tuple(map(int, p.split(","))) for p in got["path"]]
    assert got["ok"] and path[0] == start and path[-1] == goal and good(path, kind)


def test_graph_against_plain_python(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 9)) for _ in range(60)]
    df = spark.createDataFrame(edges, "src int, dst int, weight int")
    best = {0: 0}
    for _ in range(40):
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    rows = {r["node"]: r for r in graph.shortest_paths(df, spark.createDataFrame([(0,)], "source int")).collect()}
    assert {n: r["cost"] for n, r in rows.items()} == best
    # Predecessors replay to the source at the cost.
    for n in rows:
        at, steps = n, 0
        while at != 0:
            before = rows[at]["pred"]
            assert rows[before]["cost"] + min(w for a, b, w in edges if (a, b) == (before, at)) == rows[at]["cost"]
            at, steps = before, steps + 1
            assert steps < 40


def test_apply_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    new = spark.createDataFrame([(2, "b"), (3, "C"), (4, "d")], "doc_id int, text string")
    assert sorted(map(tuple, sync.changes(old, new).collect())) == [(1, "Deprecation"), (3, "Update"), (4, "Creation")]
    assert sorted(map(tuple, sync.apply_changes(old, new).collect())) == [(2, "b"), (3, "C"), (4, "d")]


def test_mentions(spark):
    titles = spark.createDataFrame([("Moaki", "m"), ("Moaki Bucht", "mb"), ("Bucht", "b"), ("Tor", "t"), ("Über Land", "u")], "title string, concept_id string")
    asked = spark.createDataFrame([(1, "Wo ist die Moaki Bucht am Tor?"), (2, "moaki, über  land; Bucht"), (3, "Moakis")], "query_id int, text string")
    rows = sorted((r["query_id"], r["rank"], r["concept_id"]) for r in catalog.mentions(asked, titles).collect())
    assert rows == [(1, 1, "mb"), (2, 1, "u"), (2, 2, "b"), (2, 3, "m")]


def test_catalog(spark):
    pages = spark.createDataFrame([("a", "A", "Weiterleitung [x](/b.md)", ["b"], ["K/L"]), ("b", "B", "text", ["a", "gone"], ["K/L", "M"]), ("b/c", "B/C", "", [], [])], "concept_id string, title string, body string, links array<string>, tags array<string>")
    assert {r[0]: r[1] for r in catalog.resolved(pages).collect()} == {"a": "b", "b": "b", "b/c": "b/c"}
    assert sorted((r["concept_id"], r["neighbour"]) for r in catalog.neighbours(pages).collect()) == [("a", "b"), ("b", "a")]
    assert [tuple(r) for r in catalog.variants(pages).collect()] == [("B", "b/c")]
    assert ("K/L", "lk") in {tuple(r) for r in catalog.category_forms(pages).collect()}


def test_stream_equals_batch(spark, sf, tmp_path):
    # The watermark of a finished stream closes no window in complete mode; all are compared.
    query = ev.windowed(ev.stream(spark, sf), "1 day").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    batch = ev.windowed(ev.timed(spark.read.parquet(f"{sf}/events.parquet")), "1 day")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))
