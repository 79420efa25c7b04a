"""Texts to rows: markdown sections, chunks, wiki templates, image maps, HTML to markdown, GIF pixels.

One document is one call; documents run in parallel. The regular parts are column
expressions, the nested grammars are table functions over Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import slug_text


def _table(df: DataFrame, key: str, text: str, parse: Callable[[object], list[tuple]], columns: str) -> DataFrame:
    """Rows of parse(text) for every row of df, with its key."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, x in zip(batch[key], batch[text], strict=True) if x is not None for row in parse(x)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {columns}")


def text_has_words(text: str):
    return F.col(text).rlike(r"\S")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, heading, text): parts below first and second level headings; empty ones are left out, unless there are no others."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    heading = F.col("value").rlike(r"^#{1,2}\s+")
    within = Window.partitionBy(key).orderBy("line")
    numbered = lines.withColumn("pos", F.sum(heading.cast("int")).over(within))
    rows = F.array_sort(F.collect_list(F.when(~heading, F.struct("line", "value"))))
    joined = numbered.groupBy(key, "pos").agg(F.coalesce(F.max(F.when(heading, F.btrim(F.regexp_replace("value", r"^#{1,2}\s+", "")))), F.lit("")).alias("heading"), F.array_join(F.transform(rows, lambda x: x["value"]), "\n").alias("text"))
    parts = joined.select(key, "pos", "heading", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    # A page of headings only is one part, as it is.
    whole = docs.where(text_has_words(text)).join(parts.select(key).distinct(), key, "left_anti")
    return parts.unionByName(whole.select(key, F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("heading"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")))


def with_header(title, heading, text):
    """A chunk's text below its page's title and its section's heading."""
    return F.concat(title, F.when(heading != "", F.concat(F.lit(" — "), heading)).otherwise(F.lit("")), F.lit("\n\n"), text)


def split_text(text: str, size: int = 800, overlap: int = 120) -> list[str]:
    """Pieces of at most size characters at the largest natural breaks, each beginning with the end of the one before."""

    def parts(s: str, breaks: tuple[str, ...]) -> list[str]:
        if len(s) <= size:
            return [s]
        if not breaks:
            return [s[i : i + size] for i in range(0, len(s), size)]
        return [x for p in re.split(f"(?<={re.escape(breaks[0])})", s) if p for x in parts(p, breaks[1:])]

    out, held = [], ""
    for part in parts(text, ("\n\n", "\n", " ")):
        if held and len(held) + len(part) > size:
            out.append(held.strip())
            tail = held[-overlap:] if overlap else ""
            held = tail[tail.find(" ") + 1 :] if " " in tail else ""
            if len(held) + len(part) > size:
                held = ""
        held += part
    return [x for x in [*out, held.strip()] if x]


def chunks(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 120) -> DataFrame:
    return _table(docs, key, text, lambda s: list(enumerate(split_text(s, size, overlap))), "pos int, chunk string")


def top_level(text: str, opening: str = "{{", closing: str = "}}") -> list[str]:
    """Insides of outermost brackets; an opening that is never closed is plain text."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two == opening:
            if not depth:
                begin = i + 2
            depth += 1
            i += 2
        elif two == closing and depth:
            depth -= 1
            if not depth:
                out.append(text[begin:i])
            i += 2
        else:
            i += 1
    return out


def split_outside(text: str, mark: str) -> list[str]:
    """text split at a mark that stands in no bracket."""
    out, depth, held, i = [], 0, "", 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth += 1
        elif two in ("}}", "]]"):
            depth = max(0, depth - 1)
        if two in ("{{", "[[", "}}", "]]"):
            held, i = held + two, i + 2
        elif text[i] == mark and not depth:
            out.append(held)
            held, i = "", i + 1
        else:
            held, i = held + text[i], i + 1
    return [*out, held]


def template_fields(wikitext: str) -> list[tuple[int, str, int, str | None, str]]:
    """(template number, its name, position, key or null, value) of all fields."""
    out = []
    for number, inside in enumerate(top_level(wikitext)):
        name, *fields = split_outside(inside, "|")
        for position, field in enumerate(fields):
            key, *rest = split_outside(field, "=")
            out.append((number, name.strip(), position, key.strip() if rest else None, "=".join(rest).strip() if rest else field.strip()))
    return out


def templates(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _table(docs, key, text, template_fields, "template int, name string, pos int, field string, value string")


def plain_value(c):
    """A wiki value without links, emphasis, references and tags."""
    c = F.regexp_replace(c, r"(?s)<ref[^>]*>.*?</ref>|<[^>]+>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"'{2,}", ""), r"\s+", " "))


def facts(docs: DataFrame, key: str, text: str, skip: tuple[str, ...] = (), most: int = 15) -> DataFrame:
    """(key, rank, field, value): named fields with short keys and values; the first of a key counts."""
    rows = templates(docs, key, text).withColumn("value", plain_value(F.col("value"))).where(F.col("field").isNotNull() & (F.length("field") <= 30) & F.length("value").between(1, 80))
    if skip:
        rows = rows.where(~F.lower("field").isin(*skip))
    first = F.row_number().over(Window.partitionBy(key, F.lower("field")).orderBy("template", "pos"))
    kept = rows.withColumn("n", first).where("n = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("template", "pos"))).where(F.col("rank") <= most).select(key, "rank", "field", "value")


def link_parts(link: str) -> tuple[str | None, str | None, str]:
    """(target, anchor, label) of the inside of a wiki link; category links keep their folder."""
    goal, bar, label = link.partition("|")
    page, _, anchor = goal.partition("#")
    category = re.match(r"(?i):?(?:Kategorie|Category):(.+)$", page.strip())
    target = f"kategorie/{slug_text(category[1])}" if category else slug_text(page.strip().removeprefix(":"))
    return target or None, anchor.strip() or None, (label if bar else goal).strip()


_BLOCK = re.compile(r"<imagemap>(.*?)</imagemap>", re.S)
_RECT = re.compile(r"^\s*rect\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+\[\[(.+?)\]\]", re.M)


def image_rects(wikitext: str) -> list[tuple]:
    """(block, image, x1, y1, x2, y2, target, anchor, label) of rectangles of image maps; others shapes are left out."""
    out = []
    for number, block in enumerate(_BLOCK.findall(wikitext)):
        named = re.search(r"(?:Bild|Image|Datei|File):([^|\n]+)", block)
        for *box, link in _RECT.findall(block):
            out.append((number, named[1].strip() if named else None, *map(int, box), *link_parts(link)))
    return out


#: A map of one region, chosen by the parameter of its template, and its picture.
_REGION = re.compile(r"\{\{#ifeq:\s*\{\{\{1\}\}\}\s*\|\s*([^|]+?)\s*\|\s*<imagemap>(.*?)</imagemap>", re.S)
_PICTURE = re.compile(r"^\s*(?:Image|Datei|File):\s*([^|\n]+?\.(?:gif|png|jpe?g))\s*(?:\|\s*(\d+)px)?", re.I | re.M)


def region_maps(wikitext: str) -> list[tuple]:
    """(region, image, width, x1, y1, x2, y2, target, anchor, label) of the rectangles of each region's map; a map without any has no row."""
    out = []
    for region, block in _REGION.findall(wikitext):
        picture = _PICTURE.search(block)
        for *box, link in _RECT.findall(block):
            out.append((region, picture[1].strip() if picture else None, int(picture[2]) if picture and picture[2] else None, *map(int, box), *link_parts(link)))
    return out


def image_maps(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _table(docs, key, text, image_rects, "block int, image string, x1 int, y1 int, x2 int, y2 int, target string, anchor string, label string")


def regions(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _table(docs, key, text, region_maps, "region string, image string, width int, x1 int, y1 int, x2 int, y2 int, target string, anchor string, label string")


class _Markdown(HTMLParser):
    """HTML to markdown: headings, paragraphs, lists, links, emphasis, fences and pipe tables."""

    DROP = {"script", "style", "nav", "footer", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped, self.fenced, self.link = 0, 0, None
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def put(self, s: str) -> None:
        (self.cell if self.cell is not None else self.out).append(s)

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.dropped += 1
        elif self.dropped:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.put(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("p", "div", "ul", "ol", "article", "section"):
            self.put("\n\n")
        elif tag == "li":
            self.put("\n- ")
        elif tag == "br":
            self.put("\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.fenced += 1
            self.put("\n\n```\n")
        elif tag == "a":
            self.link = dict(attrs).get("href")
            self.put("[" if self.link else "")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            return
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.fenced = max(0, self.fenced - 1)
            self.put("\n```\n\n")
        elif tag == "a" and self.link:
            self.put(f"]({self.link})")
            self.link = None
        elif tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip().replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            if rows:
                wide = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
                self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + "\n\n")

    def handle_data(self, data):
        if not self.dropped:
            self.put(data if self.fenced else re.sub(r"\s+", " ", data))


def to_markdown(text: str) -> str:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parser.out))).strip()


def markdown(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    return _table(pages, key, text, lambda s: [(to_markdown(s),)], "markdown string")


def unescape(text: str) -> str:
    return html.unescape(text)


def _lzw(data: bytes, least: int, n: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, held, bits, width, before = bytearray(), 0, 0, least + 1, b""

    def fresh() -> list[bytes]:
        return [bytes([i]) for i in range(clear)] + [b"", b""]

    table = fresh()
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                table, width, before = fresh(), least + 1, b""
                continue
            if code == end or len(out) >= n:
                return bytes(out[:n])
            if code > len(table) or code == len(table) and not before:
                raise ValueError("damaged image data")
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return bytes(out[:n])


def gif_pixels(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(x, y, r, g, b) of the first frame; a local palette goes before the global one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    flags, at = data[10], 13
    palette = b""
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + size], at + size
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise ValueError("no image")
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    wide, high = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (5, 7))
    flags, at = data[at + 9], at + 10
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + size], at + size
    least, at, coded = data[at], at + 1, bytearray()
    while data[at]:
        coded += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    index = _lzw(bytes(coded), least, wide * high)
    passes = [(0, 8), (4, 8), (2, 4), (1, 2)] if flags & 0x40 else [(0, 1)]
    order = [y for first, step in passes for y in range(first, high, step)]
    return [(x, y, *palette[3 * i : 3 * i + 3]) for row, y in enumerate(order) for x, i in enumerate(index[row * wide : (row + 1) * wide])]


def images(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return _table(files, key, content, lambda b: gif_pixels(bytes(b)), "x int, y int, r int, g int, b int")
