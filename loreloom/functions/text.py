"""Text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for search.
SEARCH_STOP = (
    "der die das dem den des ein eine einen einem einer und oder aber mit ohne von vom zum zur zu im in "
    "auf aus bei am an ist sind war wie was wer wo man ich du es sich auch nur noch fuer ueber the of and a to is for"
).split()
#: Words that carry no meaning in the names of rooms.
ROOM_STOP = "der die das dem den des ein eine einen einem einer mit in im von vom zum zur und oder am an auf aus bei ueber the of".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def transliterate(x: Column | str) -> Column:
    out = F.lower(_c(x))
    for letter, two in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def search_tokens(x: Column | str) -> Column:
    """Lower-case, transliterated tokens of two characters or more that are no stop words."""
    return F.filter(F.split(transliterate(x), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(SEARCH_STOP))


def room_tokens(x: Column | str) -> Column:
    """Distinct tokens of three characters or more of a room's name."""
    return F.array_distinct(F.filter(F.split(transliterate(x), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(ROOM_STOP)))


def tokens_overlap(a: Column, b: Column) -> Column:
    """Whether a token of one list is part of a token of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def normal(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


def padded(x: Column | str) -> Column:
    """`` a b ``: words between single spaces, for contains() on whole words."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(transliterate(x), "[^a-z0-9]+", " ")), F.lit(" "))


def shortened(x: Column | str, n: int) -> Column:
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def without_citations(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?is)\n#\s+Citations.*$", "")


def without_thoughts(x: Column | str) -> Column:
    """A reply without its <think> part; an unopened part ends at the first closing tag that is left."""
    closed = F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?s)^.*?</think>", ""), r"^\s+|\s+$", "")


def compound_aliases(x: Column | str) -> Column:
    """Natural names of a category path: B+A for A/B, and both orders with the rest of a deeper path."""
    parts = F.filter(F.transform(F.split(_c(x), "/"), lambda p: F.btrim(p)), lambda p: p != "")
    joined = F.concat(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)))
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), " ")
    none = F.array().cast("array<string>")
    return F.when(F.size(parts) < 2, none).when(F.size(parts) == 2, F.array(joined)).otherwise(F.array(F.concat_ws(" ", joined, rest), F.concat_ws(" ", rest, joined)))


def slug(x: Column | str) -> Column:
    """A name as part of a path; text is taken to be in composed Unicode form."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"(?U)[\s_]+", "-"), r"""[\\/:*?"<>|#]+""", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def slug_text(x: str) -> str:
    """The same for a Python string, which is composed first."""
    dashed = re.sub(r"""[\s_]+|[\\/:*?"<>|#]+""", "-", unicodedata.normalize("NFC", x).lower())
    return re.sub("^-|-$", "", re.sub("-+", "-", dashed))


def yaml_scalar(x: Column | str) -> Column:
    """A scalar for front matter, quoted where plain text would read as something else."""
    c = _c(x)
    marked = F.replace(c, F.lit('"'), F.lit('\\"'))
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    between = lambda inner: F.concat(F.lit('"'), inner, F.lit('"'))
    # What a reader would take for a number, a truth value or syntax.
    literal = c.rlike(r"^[\d.+-]+$") | F.lower(c).isin("true", "false", "null", "yes", "no", "on", "off")
    special = c.rlike(r"""[:#\-?{}\[\],&*!|>'"%@`]|^\s|\s$""")
    return F.when(c == "", F.lit('""')).when(literal, between(marked)).when(special, between(escaped)).otherwise(c)


def percent_decoded(x: Column | str) -> Column:
    """Percent-decoded text in which a plus stays one; text that can't be decoded stays."""
    c = _c(x)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def outbound_links(x: Column | str, own: Column | str | None = None, most: int = 40) -> Column:
    """Distinct targets of markdown links to other pages of the bundle, in order, decoded and without the ending."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(r"\]\(/([^)\s#]+?)\.md"), 1), percent_decoded))
    return F.slice(found if own is None else F.filter(found, lambda t: t != _c(own)), 1, most)


def wants_route(x: Column | str) -> Column:
    """Whether a text asks for a way; word boundaries are ASCII ones, spelled out."""
    # Cues of a question for a way.
    cue = r"weg|route|wegbeschreibung|wie\s+(?:komme|gelange|laufe)|how\s+(?:do|can|to)|get\s+(?:to|from)|way\s+(?:to|from)|directions?|von\s.*\s(?:nach|zu|zum|zur)|from\s.*\sto"
    return F.lower(_c(x)).rlike(rf"(?s)(^|[^a-z0-9_])(?:{cue})($|[^a-z0-9_])")
