"""Operators that have no SQL, and cases that the tables don't hold."""

from loreloom.operators import retrieval, rooms, tiles
from loreloom.operators.search import bm25_index, bm25_ranked, build_index
from loreloom.sources import artifacts


def test_portal_pairs_take_the_most_alike_first(spark):
    df = spark.createDataFrame([("A", "a1", "B", "Steiler Felshang am Bach"), ("A", "a2", "B", "Dunkler Wald"), ("B", "b1", "A", "Wald mit Lichtung"), ("B", "b2", "A", "Felsterasse"), ("B", "b3", "C", "Wald")], "map string, room string, target string, text string")
    assert sorted((r["a"], r["b"]) for r in rooms.portal_pairs(df).collect()) == [("a1", "b2"), ("a2", "b1")]


def test_frontier(spark):
    start = spark.createDataFrame([("a",)], "url string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "url string, target string")
    assert sorted(map(tuple, retrieval.frontier(start, links).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert sorted(map(tuple, retrieval.frontier(start, links, most=3).collect())) == [("a", 0), ("b", 1), ("c", 1)]


def test_listing_in_german_order(spark):
    pages = spark.createDataFrame([("1", "Zebra", 0), ("2", "Äpfel", 0), ("3", "apfel", 0), ("4", "Öl", 0), ("5", "Kategorie:X", 14)], "concept_id string, title string, namespace int")
    row = retrieval.listings(pages.selectExpr("'C' as category", "concept_id"), pages, most=3).first()
    assert (row["n"], row["titles"]) == (4, ["apfel", "Äpfel", "Öl"])
    assert row["text"].endswith("… und 1 weitere.")


def test_context_without_pages_is_a_sentence(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    context = spark.createDataFrame([(1, 1, "T", "x")], "query_id int, rank int, title string, text string")
    assert {r["query_id"]: r["context"] for r in retrieval.formatted(context, queries).collect()} == {1: "[1] T\nx", 2: "(kein relevanter Kontext gefunden)"}


def test_stored_index_ranks_as_the_table_does(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert artifacts.read_index(spark, str(tmp_path / "none")) is None
    artifacts.write_index(build_index(docs), str(tmp_path / "index"), partitions=4)
    terms = ["that", "thes", "inte", "nowhere"]
    got = bm25_index(artifacts.read_index(spark, str(tmp_path / "index")), terms, 10).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, bm25_ranked(docs, terms, 10).collect()))


def test_tables_that_are_not_there(spark, tmp_path):
    assert artifacts.read_table(spark, str(tmp_path / "x")) is None
    assert artifacts.read_json(spark, str(tmp_path / "x"), "a int") is None
    (tmp_path / "j.json").write_text('{"a": 1}\n{broken\n')
    assert [r["a"] for r in artifacts.read_json(spark, str(tmp_path / "j.json"), "a int").collect()] == [1]
    assert artifacts.manifest(spark, str(tmp_path / "x"), "title string, revid bigint").count() == 0


def test_region_name_stands_for_its_middle(spark):
    sizes = spark.createDataFrame([("Asia", "karte/asia", 0, 3, 3)], "region string, page string, origin int, cols int, rows int")
    grid = spark.createDataFrame([("Asia", r, c, "grass", 3) for r in range(3) for c in range(3)], "region string, row int, col int, terrain string, cost int")
    gates = spark.createDataFrame([("Asia", 0, 0, 2, "orte/lutetia", "Lutetia (Westrand 1)"), ("Asia", 1, 2, 2, "orte/lutetia", "Lutetia (Ostrand 1)")], "region string, pos int, row int, col int, target string, label string")
    asked = spark.createDataFrame([(1, "Asia", "asia"), (2, "Asia", "Lutetia"), (3, "Asia", "1;2")], "query_id int, region string, text string")
    got = sorted((r["query_id"], r["rank"], r["row"], r["col"]) for r in tiles.resolve_tiles(asked, gates, grid, sizes).collect())
    assert got == [(1, 1, 1, 1), (2, 1, 0, 2), (2, 2, 2, 2), (3, 1, 2, 1)]
