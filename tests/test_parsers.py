import struct

from loreloom.operators import parsers as ps
from loreloom.sources.bundle import parse_pages, read_bundle, render_pages


def test_link_parts():
    assert ps.link_parts("Foo-Ling-Yoo") == ("foo-ling-yoo", None, "Foo-Ling-Yoo")
    assert ps.link_parts("Nankea#Karte|Kathedrale") == ("nankea", "Karte", "Kathedrale")
    assert ps.link_parts("#Weltenrand|Rand") == (None, "Weltenrand", "Rand")
    assert ps.link_parts(":Kategorie:Gallien|Gallien") == ("kategorie/gallien", None, "Gallien")


def test_region_maps():
    text = "{{#ifeq: {{{1}}} | Asia | <imagemap>\nDatei:Asia.gif|600px\nrect 0 0 11 11 [[Foo-Ling-Yoo]]\nrect 12 0 23 11 [[#Rand|Weltrand]]\n</imagemap>}}{{#ifeq:{{{1}}}|Leer|<imagemap>\nFile:x.png\n</imagemap>}}"
    assert ps.region_maps(text) == [("Asia", "Asia.gif", 600, 0, 0, 11, 11, "foo-ling-yoo", None, "Foo-Ling-Yoo"), ("Asia", "Asia.gif", 600, 12, 0, 23, 11, None, "Rand", "Weltrand")]


def test_image_rects():
    text = "{{#ifeq:a|b|<imagemap>\nBild:Asia.gif|600px\nrect 0 0 11 11 [[Foo-Ling-Yoo]]\npoly 1 1 2 2 [[No]]\nrect 12 0 23 11 [[#Rand|Weltrand]]\n</imagemap>}}"
    assert ps.image_rects(text) == [(0, "Asia.gif", 0, 0, 11, 11, "foo-ling-yoo", None, "Foo-Ling-Yoo"), (0, "Asia.gif", 12, 0, 23, 11, None, "Rand", "Weltrand")]


def test_templates_and_facts(spark):
    text = "intro {{NPC|Name=Bob|Ort=[[Stadt|die Stadt]]|x={{y|z=1}}|name=Other|frei}} and {{open"
    assert [r[3:] for r in ps.template_fields(text)] == [("Name", "Bob"), ("Ort", "[[Stadt|die Stadt]]"), ("x", "{{y|z=1}}"), ("name", "Other"), (None, "frei")]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = [(r["id"], r["rank"], r["field"], r["value"]) for r in ps.facts(df, "id", "text", skip=("x",)).collect()]
    assert sorted(rows) == [(1, 1, "Name", "Bob"), (1, 2, "Ort", "die Stadt")]


def test_sections_and_chunks(spark):
    text = "before\n\n# One\n\nfirst\n### deep\nmore\n## Two\n\n# Three\nlast"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, "# only")], "id int, text string")
    rows = sorted((r["id"], r["pos"], r["heading"], r["text"]) for r in ps.sections(df, "id", "text").collect())
    assert rows == [(1, 0, "", "before"), (1, 1, "One", "first\n### deep\nmore"), (1, 3, "Three", "last"), (2, 0, "", "plain"), (3, 0, "", "# only")]
    long = " ".join(f"word{i}" for i in range(600))
    pieces = ps.split_text(long)
    assert all(len(p) <= 800 for p in pieces) and set(" ".join(pieces).split()) == set(long.split())
    assert ps.chunks(df, "id", "text").where("id = 2").first()["chunk"] == "plain"


def test_markdown():
    page = "<head><title>x</title></head><nav>menu</nav><h1>Top</h1><p>a <b>bold</b> &amp; <a href='/l'>link</a></p><ul><li>i</li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table><pre>x  y</pre>"
    assert ps.to_markdown(page) == "# Top\n\na **bold** & [link](/l)\n\n- i\n\n| A | B |\n| --- | --- |\n| 1 |  |\n\n```\nx  y\n```"


def gif(local: bool, interlaced: bool) -> bytes:
    colours = bytes([0, 0, 0, 255, 255, 255, 0, 200, 0, 0, 0, 200])
    pixels = [(x + y) % 4 for y in range(4) for x in range(3)]
    rows = [pixels[3 * y : 3 * y + 3] for y in ([0, 2, 1, 3] if interlaced else range(4))]
    codes, bits, n = [4], 0, 0
    for p in (p for r in rows for p in r):
        codes += [p, 4]  # a clear code after each pixel keeps codes three bits wide
    for c in [*codes, 5]:
        bits |= c << n
        n += 3
    data = bits.to_bytes((n + 7) // 8, "little")
    head = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0x81, 0, 0) + (bytes(12) if local else colours) + b"!\xf9\x04\0\0\0\0\0"
    return head + b"," + struct.pack("<HHHHB", 0, 0, 3, 4, (0x81 if local else 0) | (0x40 if interlaced else 0)) + (colours if local else b"") + b"\x02" + bytes([len(data)]) + data + b"\0;"


def test_gif():
    colours = [(0, 0, 0), (255, 255, 255), (0, 200, 0), (0, 0, 200)]
    expected = {(x, y): colours[(x + y) % 4] for y in range(4) for x in range(3)}
    for local in (False, True):
        for interlaced in (False, True):
            assert {(x, y): (r, g, b) for x, y, r, g, b in ps.gif_pixels(gif(local, interlaced))} == expected


def test_bundle_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("a/b", "A: title", "Wiki Article", "d", "http://x/a", ["t", "u v"], 0, 7, "Body [l](/c/d.md) and [me](/a/b.md)")], "concept_id string, title string, type string, description string, url string, tags array<string>, namespace int, revid long, body string")
    for r in render_pages(pages).collect():
        (tmp_path / "a").mkdir()
        (tmp_path / "a" / "b.md").write_text(r["raw"])
    (tmp_path / "index.md").write_text("no page")
    (tmp_path / "plain.md").write_text("# no front matter")
    found = {r["concept_id"]: r for r in parse_pages(read_bundle(spark, str(tmp_path))).collect()}
    assert sorted(found) == ["a/b", "plain"]
    row = found["a/b"]
    assert (row["title"], row["type"], row["tags"], row["revid"], row["body"], row["links"]) == ("A: title", "Wiki Article", ["t", "u v"], 7, "Body [l](/c/d.md) and [me](/a/b.md)", ["c/d"])
    assert (found["plain"]["title"], found["plain"]["namespace"]) == ("plain", 0)
