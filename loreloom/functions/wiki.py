"""Functions over names, links, questions and replies of a wiki, as column expressions.

Word boundaries are spelled out as ASCII ones, so that every engine reads the patterns alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions.text import _c, compound_aliases, percent_decoded, slug, transliterate

_START, _END = r"(^|[^a-z0-9_])", r"($|[^a-z0-9_])"


def trimmed(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def squeezed(x: Column | str) -> Column:
    return trimmed(F.regexp_replace(_c(x), r"\s+", " "))


def page_title(x: Column | str) -> Column:
    """A title as a key: percent-decoded, with spaces for underscores."""
    return trimmed(F.replace(percent_decoded(x), F.lit("_"), F.lit(" ")))


def concept_id(title: Column | str, namespace: Column | str, name: Column | str) -> Column:
    """Path of a page in the bundle; other namespaces than the main one, if they have a name, are folders."""
    plain, name = page_title(title), F.coalesce(_c(name), F.lit(""))
    prefixed = (name != "") & F.startswith(plain, F.concat(name, F.lit(":")))
    local = F.when(prefixed, F.substring(plain, F.length(name) + 2, F.length(plain))).otherwise(plain)
    file = F.when(slug(local) == "", F.lit("index-page")).otherwise(slug(local))
    return F.when((_c(namespace) == 0) | (name == ""), file).otherwise(F.concat(slug(name), F.lit("/"), file))


def concept_type(namespace: Column | str, name: Column | str) -> Column:
    # The numbers of the namespaces of categories and of help.
    kinds = F.when(_c(namespace) == 14, "Wiki Category").when(_c(namespace) == 12, "Wiki Help")
    return kinds.when(F.coalesce(_c(name), F.lit("")) != "", F.concat(F.lit("Wiki "), _c(name))).otherwise("Wiki Article")


def clean_name(x: Column | str) -> Column:
    """A room's name without markdown links (their text stays), brackets, asterisks and backticks."""
    unlinked = F.regexp_replace(_c(x), r"\[([^\]]+)\]\([^()]*(?:\([^()]*\)[^()]*)*\)", "$1")
    return squeezed(F.regexp_replace(unlinked, r"[\[\]*`]", ""))


#: Names of colours.
COLORS = {
    "blue": "0000FF", "red": "FF0000", "green": "008000", "black": "000000", "white": "FFFFFF",
    "yellow": "FFFF00", "lime": "00FF00", "aqua": "00FFFF", "cyan": "00FFFF", "magenta": "FF00FF",
    "fuchsia": "FF00FF", "gray": "808080", "grey": "808080", "silver": "C0C0C0", "orange": "FFA500",
    "maroon": "800000", "olive": "808000", "navy": "000080", "teal": "008080", "purple": "800080",
}


def color_code(x: Column | str) -> Column:
    """A colour as six upper-case hexadecimal digits; empty where there is none, upper-cased where it is neither name nor code."""
    c = F.regexp_replace(F.lower(trimmed(x)), "^#", "")
    named = F.create_map(*(F.lit(v) for pair in COLORS.items() for v in pair))
    doubled = F.regexp_replace(c, "(.)", "$1$1")
    return F.when(_c(x).isNull() | (_c(x) == ""), "").otherwise(F.coalesce(F.try_element_at(named, c), F.upper(F.when(c.rlike("^[0-9a-f]{3}$"), doubled).otherwise(c))))


def link_title(href: Column | str, prefix: str) -> Column:
    """Title of the page that an internal link names, also a link to a page that is still to be written; else null."""
    c = _c(href)
    inside = page_title(F.regexp_extract(F.substring(c, len(prefix) + 1, 1 << 20), r"^([^?#]*)", 1))
    missing = F.when(c.rlike("action=edit|redlink=1") & c.rlike("[?&]title=[^&]"), page_title(F.regexp_extract(c, "[?&]title=([^&]+)", 1)))
    return F.when(F.startswith(c, F.lit(prefix)), inside).otherwise(missing)


def link_base(href: Column | str) -> Column:
    """Name of the HTML file that a link leads to, without folders and ending; null for other links."""
    path = F.regexp_replace(_c(href), r"(?s)[?#].*$", "")
    return F.when(path.rlike(r"(?i)\.html$"), percent_decoded(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.html$", "")))


def page_of_link(href: Column | str) -> Column:
    """Name of the page at the end of a link of the bundle."""
    return F.regexp_replace(percent_decoded(F.element_at(F.split(_c(href), "/"), -1)), r"\.md$", "")


def region_and_slug(path: Column | str, root: str) -> Column:
    """struct<region, slug> of a map's path below root: the folder above it, or itself where there is none; null for the index."""
    parts = F.filter(F.split(F.regexp_replace(_c(path), f"(?i)^{root}", ""), "/"), lambda p: p != "")
    base = F.regexp_replace(percent_decoded(F.try_element_at(parts, F.lit(-1))), r"(?is)\.html.*$", "")
    region = F.when(F.size(parts) >= 2, percent_decoded(F.try_element_at(parts, F.lit(-2)))).otherwise(base)
    return F.when((F.size(parts) > 0) & ~((F.lower(base) == "index") & (F.size(parts) < 2)), F.struct(region.alias("region"), base.alias("slug")))


def wants_list(x: Column | str) -> Column:
    """Whether a text asks for all members of a category."""
    # Cues of such a question.
    cue = "alle|sämtliche|saemtliche|liste|auflisten|list|welche|übersicht|uebersicht|gibt es|jede[nrs]?"
    return F.lower(_c(x)).rlike(f"{_START}(?:{cue}){_END}")


def wants_map(x: Column | str) -> Column:
    # Cues of a question for a map.
    return F.lower(_c(x)).rlike(f"{_START}(?:karte|stadtplan|lageplan|landkarte|plan|map){_END}")


def _endpoint(x: Column) -> Column:
    """A place without articles before it and verbs after it."""
    # What stands around a place in a question.
    bare = F.regexp_replace(x, r"(?i)^(the|a|an|dem|der|das|den|die|einem|einer|ein|zur|zum|ich|bitte)\s+", "")
    bare = F.regexp_replace(bare, r"(?i)(^|[^a-zA-Z0-9_])(?:ausgang|ausgan|tor|eingang)\s+von\s+", "$1")
    verbs = r"(?is)\s+(komme|komm|gelange|gelangen|laufe|laufen|gehe|gehen|finde|hinkomme|hin|kommt|komme\s+ich|denn|bitte|ich)($|[^a-zA-Z0-9_].*$)"
    return trimmed(F.regexp_replace(bare, verbs, ""))


def route_ends(x: Column | str) -> Column:
    """struct<source, goal> of a question for a way, in three forms of which the first that fits counts; else null."""
    c = _c(x)
    # The forms, and which of their groups is the source.
    forms = [(r"(?:von|vom)\s+(.+?)\s+(?:nach|zu|zum|zur|bis\s+zum?)\s+(.+?)[?.!]*\s*$", 2, 3), (r"weg\s+(?:nach|zum?|zur)\s+(.+?)\s+(?:von|vom|ab)\s+(.+?)[?.!]*\s*$", 3, 2), (r"from\s+(.+?)\s+to\s+(.+?)[?.!]*\s*$", 2, 3)]
    out = F.lit(None)
    for form, source, goal in reversed(forms):
        pattern = f"(?i)(^|[^a-z0-9_]){form}"
        out = F.when(c.rlike(pattern), F.struct(_endpoint(F.regexp_extract(c, pattern, source)).alias("source"), _endpoint(F.regexp_extract(c, pattern, goal)).alias("goal"))).otherwise(out)
    return out


def reply_object(x: Column | str) -> Column:
    """The JSON object that a reply ends with, as text: the last flat one that parses, else all from the first to the last brace."""
    spoken = F.element_at(F.split(F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", ""), "</think>"), -1)
    flat = F.filter(F.regexp_extract_all(spoken, F.lit(r"\{[^{}]*\}"), 0), lambda o: F.get_json_object(o, "$").isNotNull())
    greedy = F.regexp_extract(spoken, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_element_at(flat, F.lit(-1)), F.when(F.get_json_object(greedy, "$").isNotNull(), greedy))


def content_text(x: Column | str) -> Column:
    """Plain text of a message's content in JSON: a string, or a list of strings and of objects with a text; else empty."""
    value = F.try_parse_json(_c(x))
    parts = F.try_variant_get(value, "$", "array<variant>")
    part = F.transform(parts, lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.when(F.startswith(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")), F.lit("STRING")), F.try_variant_get(p, "$.text", "string")), F.lit("")))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).when(parts.isNotNull(), F.array_join(part, "")).otherwise("")


def question_forms(x: Column | str) -> Column:
    """struct<forms, hint> of a place: as it is, and without an area after a preposition, which is the hint as a slug."""
    # Prepositions before an area.
    pattern = r"(?i)^(.*\S)\s+(?:in|im|von|vom|bei|auf|am|an)\s+(\S[\w äöüÄÖÜß-]*)$"
    c = trimmed(x)
    area = F.regexp_replace(F.regexp_replace(transliterate(F.regexp_extract(c, pattern, 2)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    named = c.rlike(pattern)
    return F.struct(F.when(named, F.array(c, trimmed(F.regexp_extract(c, pattern, 1)))).otherwise(F.array(c)).alias("forms"), F.when(named & (area != ""), area).alias("hint"))


def category_phrase(name: Column | str, members: Column | str) -> Column:
    """A category as a sentence to embed: its path in words, its natural names and its members."""
    head = F.array_join(F.concat(F.array(F.replace(_c(name), F.lit("/"), F.lit(" "))), compound_aliases(name)), ". ")
    return F.when(F.size(_c(members)) > 0, F.concat(head, F.lit(". Enthält: "), F.array_join(_c(members), ", "))).otherwise(head)


def short_name(x: Column | str) -> Column:
    """What a legend says before its first colon, bracket or line break."""
    return squeezed(F.regexp_extract(_c(x), r"^([^:(\n]*)", 1))


def special_way(x: Column | str) -> Column:
    """How a legend says that one goes on: the bracket that tells, else all of it."""
    # Words of such a bracket.
    told = F.regexp_extract(_c(x), r"(?i)\(([^)]*(?:kriech|spalt|weiter geht|indem|klettert|seil|schwimmt|schlüpf|zwäng)[^)]*)\)", 1)
    return squeezed(F.when(told != "", told).otherwise(_c(x)))


def climb_note(x: Column | str) -> Column:
    """What to try where a way changes the map, from the legend of the room one leaves."""
    # Words for up and down, and the note.
    up = F.lower(_c(x)).rlike("(^|[^a-z0-9_])hoch|hinauf|aufsteig")
    down = F.lower(_c(x)).rlike("(^|[^a-z0-9_])runter|hinab|hinunter")
    verb = F.when(up & ~down, "hochklettern").when(down & ~up, "runterklettern").otherwise("klettern")
    return F.concat(F.lit("Kartenwechsel – "), verb, F.lit(" (genauer Befehl unklar)"))


def landmarks(x: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """Distinct nouns of a legend, in lower case: capitalised words of four letters or more."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit("[A-ZÄÖÜ][a-zäöüß]{3,}"), 0), F.lower))
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>"))


def affinity(a: Column, b: Column) -> Column:
    """How alike two lists of landmarks are: two for every word that both have, and one for every first four letters."""
    stems = lambda words: F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 4)))
    return 2 * F.size(F.array_intersect(a, b)) + F.size(F.array_intersect(stems(a), stems(b)))


def paragraph(html: Column | str, most: int = 200) -> Column:
    """The first paragraph of a page that has text, without tags, cut at `most` characters."""
    paragraphs = F.regexp_extract_all(_c(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    texts = F.filter(F.transform(paragraphs, lambda p: squeezed(F.regexp_replace(p, "<[^>]*>", ""))), lambda p: p != "")
    return F.coalesce(trimmed(F.substring(F.try_element_at(texts, F.lit(1)), 1, most)), F.lit(""))


def unescaped(x: Column | str) -> Column:
    """Text in which doubled backslashes are single ones again."""
    return F.replace(_c(x), F.lit("\\\\"), F.lit("\\"))


def draws_map(x: Column | str) -> Column:
    """Whether a page holds a character map: rooms with a wire, or at the beginning of a line."""
    return _c(x).rlike(r"[o~]--|--[o~]|\n\s*[o~]\s")


def draws_boxes(x: Column | str) -> Column:
    """Whether a page is to be audited for a character map; another test than draws_map."""
    return _c(x).rlike("[┌┐└┘┼]|o--|--o")


def is_map_page(x: Column | str) -> Column:
    """Whether a page shows a map, so that all of it is kept as context."""
    # Marks of a map.
    return _c(x).rlike(r"Nord/Süd|˄|˅|o--o|```|Hoch.*Runter")


def needs_own_render(x: Column | str) -> Column:
    """Whether a page's source speaks of its own title, so that it can't be rendered with others."""
    return _c(x).rlike(r"(?i)\{\{\s*(PAGENAME|FULLPAGENAME|subst:)")


def names_water(x: Column | str) -> Column:
    # Words for water in names of rooms.
    return F.lower(_c(x)).rlike("bach|fluss|ufer|dijala|graben|bucht|passage|kanal|see|teich|wasser|moat|steg|furt|brücke|bruecke")


def borders_water(x: Column | str) -> Column:
    """Whether a legend speaks of open water, where no road comes in; another test than names_water."""
    # Words for open water.
    return F.lower(_c(x)).rlike("fluss|fluß|wasser|(^|[^a-z0-9_])see($|[^a-z0-9_])|meer|bach|seine|ozean|teich|sumpf|hafen")


def single_glyph(x: Column | str) -> Column:
    return _c(x).rlike(r"^\S$")


def same_tokens(a: Column, b: Column) -> Column:
    """Whether two lists hold the same tokens, and any."""
    return (F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))
