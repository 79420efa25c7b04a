import pytest

from loreloom.operators import resolve as rs
from loreloom.serve import KnowledgeBase


def graph(spark, names):
    nodes = spark.createDataFrame([(i, n, "primary") for i, n in zip("ab", names, strict=True)], "id string, name string, origin string")
    edges = spark.createDataFrame([("a", "b", "osten", 1.0)], "src string, dst string, command string, weight double")
    return KnowledgeBase(spark, None, nodes, edges)


@pytest.mark.parametrize("names,goal,ok", [(("Bucht (Kurstafel)", "Tempel"), "Tempel der BlueOrb", False), (("Steg der Moaki-Bucht", "Tempel der 'BlueOrb'"), "Tempel der BlueOrb", True), (("Steg der Moaki-Bucht", "Tempel der 'BlueOrb'"), "Zzznonexistentroom", False)])
def test_strict_names(spark, names, goal, ok):
    rows = graph(spark, names).route("Moaki-Bucht", goal).collect()
    assert [tuple(r) for r in rows] == ([(0, "a", "b", "osten")] if ok else [])


def test_reconcile_and_merge(spark):
    kind = "id string, name string, portals array<string>"
    p = spark.createDataFrame([("p1", "Tor", ["x"]), ("p2", "Marktplatz", []), ("p3", "Raum", []), ("p4", "Alte Schmiede", []), ("p5", "Raum", [])], kind)
    s = spark.createDataFrame([("s1", "Eingang", ["x"]), ("s2", "marktplatz", []), ("s3", "?", []), ("s4", "Schmiede hinten", []), ("s5", "Raum", [])], kind)
    pe = spark.createDataFrame([("p1", "p3", "osten", None, False), ("p2", "p3", None, "hint", False)], "src string, dst string, command string, hint string, transition boolean")
    se = spark.createDataFrame([("s1", "s3", "norden", None, False), ("s2", "s3", "westen", None, False), ("s3", "s5", None, None, True)], "src string, dst string, command string, hint string, transition boolean")
    bound = rs.reconcile(p, s, pe, se)
    assert {(r["a"], r["b"], r["tier"]) for r in bound.collect()} == {("p1", "s1", "portal"), ("p2", "s2", "name"), ("p4", "s4", "word"), ("p3", "s3", "neighbours")}
    merged = {(r["src"], r["dst"], r["command"], r["origin"], r["weight"]) for r in rs.merge(pe, se, bound).collect()}
    assert merged == {("p1", "p3", "osten", "primary", 1.0), ("p2", "p3", None, "primary", 2.0), ("p2", "p3", "westen", "secondary", 2.0), ("p3", "s5", None, "secondary", 5.0)}


def test_tools(spark):
    pages = spark.createDataFrame([("a", "Anleger", "Der Fischer am Steg", ["b"], ["Orte/Hafen"], 0), ("b", "Karte/Hafen", "Fischer Karte", [], ["Orte/Hafen"], 0), ("c", "C", "nichts", [], [], 0)], "concept_id string, title string, body string, links array<string>, tags array<string>, namespace int")
    tiles = spark.createDataFrame([("r", 0, 0, "road"), ("r", 0, 1, "water"), ("q", 0, 0, "grass")], "region string, row int, col int, terrain string")
    kb = KnowledgeBase(spark, pages, tiles=tiles)
    assert [r["concept_id"] for r in kb.search("Wo ist der Fischer?").collect()] == ["a", "b"]
    assert kb.fetch("a").first()["neighbours"] == ["Karte/Hafen"]
    assert [(r["count"], r["concept_id"]) for r in kb.list_category("alle HafenOrte bitte").collect()] == [(2, "a"), (2, "b")]
    assert [tuple(r) for r in kb.map("r").collect()] == [(0, "=~")]
