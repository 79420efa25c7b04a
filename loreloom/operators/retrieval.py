"""What stands between a question and a model: category listings, lists of context, and links between pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import compound_aliases, normal, percent_decoded, without_citations
from loreloom.functions.wiki import category_phrase, is_map_page, trimmed

#: How much of a page goes into the context, by what it is.
PAGE, NEIGHBOUR, MAP = 2500, 600, 16000
LISTED = 250
#: Categories that say nothing about content.
META = ("Todo", "Hidden", "Subpages", "Tabs", "Spalten", "Set", "Adjektiv", "ZusatzAussehen", "Zustand", "Angebot", "Brett", "Info", "Vorlage", "Schriften")


def content_members(members: DataFrame, pages: DataFrame) -> DataFrame:
    """(category, concept_id, title): members that are pages and no categories themselves. members: category, concept_id; pages: concept_id, title, namespace."""
    return members.join(pages.where("namespace <> 14").select("concept_id", "title"), "concept_id").select("category", "concept_id", "title")


def listings(members: DataFrame, pages: DataFrame, most: int = LISTED, collation: str = "de") -> DataFrame:
    """(category, n, titles, text): the members of each category by title, in the order of a language, cut at `most` with a note of the rest."""
    found = content_members(members, pages)
    order = Window.partitionBy("category").orderBy(F.expr(f"collate(title, '{collation}')"), "title", "concept_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "title")))), lambda x: x["title"])
    out = ranked.groupBy("category").agg(F.count("*").alias("n"), kept.alias("titles"))
    head = F.concat(F.lit("Kategorie „"), F.col("category"), F.lit('" — '), F.col("n").cast("string"), F.lit(" Einträge:\n"), F.array_join("titles", ", "))
    rest = F.when(F.col("n") > most, F.concat(F.lit("\n… und "), (F.col("n") - most).cast("string"), F.lit(" weitere."))).otherwise("")
    return out.withColumn("text", F.concat(head, rest))


def eligible(members: DataFrame, pages: DataFrame) -> DataFrame:
    """(category) that may be found by meaning: at the top level, about content, and with a member that is a page."""
    names = members.where(~F.contains("category", F.lit("/")) & ~F.contains("category", F.lit(":")) & ~F.col("category").isin(*META))
    return names.join(pages.where("namespace <> 14").select("concept_id"), "concept_id", "left_semi").select("category").distinct()


def phrases(members: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    """(category, phrase): what is embedded for each eligible category: its names and the titles of `most` members."""
    titled = members.join(eligible(members, pages), "category", "left_semi").join(pages.where("namespace <> 14").select("concept_id", "title"), "concept_id")
    first = titled.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("concept_id"))).where(F.col("rank") <= most)
    sample = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])
    return first.groupBy("category").agg(sample.alias("members")).select("category", category_phrase("category", "members").alias("phrase"))


def named_categories(queries: DataFrame, categories: DataFrame, most: int = 2, shortest: int = 4) -> DataFrame:
    """(query_id, rank, category): categories that a question names by a whole form, the longest first, each once.

    queries: query_id, text; categories: category. Only a form's first occurrence is looked at. The first word of the form makes it an equi-join.
    """
    forms = categories.select("category", F.explode(F.concat(F.array("category"), compound_aliases("category"))).alias("form")).select("category", normal("form").alias("form")).where(F.length("form") >= shortest)
    forms = forms.groupBy("form").agg(F.min("category").alias("category")).withColumn("word", F.regexp_extract("form", r"([\p{L}\p{N}]+)", 1)).where("word <> ''")
    asked = queries.select("query_id", normal("text").alias("text"))
    words = asked.select("query_id", "text", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("word"))
    met = words.join(forms, "word").withColumn("at", F.position(F.col("form"), F.col("text"))).where("at > 0")
    before, after = F.substring(F.col("text"), F.col("at") - 1, F.lit(1)), F.substring(F.col("text"), F.col("at") + F.length("form"), F.lit(1))
    whole = met.where(((F.col("at") == 1) | ~before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]"))
    best = whole.groupBy("query_id", "category").agg(F.max(F.length("form")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "category"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "category")


def page_texts(pages: DataFrame) -> DataFrame:
    """(concept_id, title, full, brief): what a page gives the context as a hit and as a neighbour; maps are kept longer."""
    body = F.substring(trimmed(without_citations("body")), 1, MAP)
    full = F.when(is_map_page(body), body).otherwise(F.substring(body, 1, PAGE))
    return pages.select("concept_id", "title", full.alias("full"), F.substring(body, 1, NEIGHBOUR).alias("brief"))


def assembled(exact: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, rank, concept_id, title, text): the context of a question: exact pages, then ranked ones that are not among them.

    Both: query_id, pos, concept_id, title, text. A page counts once in each list, at its first place; within a list paper maps sink to its end.
    """
    once = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "concept_id").orderBy("pos"))).where("nth = 1").drop("nth")
    first = once(exact)
    second = ranked.join(first.select("query_id", "concept_id"), ["query_id", "concept_id"], "left_anti").select(exact.columns)
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("list", F.startswith("title", F.lit("Karte/")), "pos")
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "concept_id", "title", "text")


def formatted(context: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): a numbered list; a fixed sentence for questions without any. context: query_id, rank, title, text."""
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("Eintrag")), F.lit("\n"), F.coalesce("text", F.lit("")))
    lists = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), "\n\n").alias("context"))
    if queries is None:
        return lists
    return queries.select("query_id").distinct().join(lists, "query_id", "left").fillna("(kein relevanter Kontext gefunden)", "context")


def linked_titles(links: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """(page, pos, title, url): links by title to a page of the bundle, else to the site. links: page, pos, title; pages: concept_id, title."""
    known = pages.groupBy(normal("title").alias("key")).agg(F.min("concept_id").alias("goal"))
    found = links.withColumn("key", normal("title")).join(known, "key", "left")
    outside = F.concat(F.lit(base), F.replace(F.col("title"), F.lit(" "), F.lit("_")))
    return found.select("page", "pos", "title", F.coalesce(F.concat(F.lit("/"), F.col("goal"), F.lit(".md")), outside).alias("url"))


def with_facts(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """pages with a section of facts before the citations, or at the end; those that have one stay as they are. facts: concept_id, facts."""
    mark = F.lit("## Kenndaten")
    joined = pages.join(facts, "concept_id", "left")
    at = F.regexp_instr("body", F.lit(r"(?i)\n#\s+Citations"))
    before = F.concat(F.expr("substring(body, 1, regexp_instr(body, r'(?i)\\n#\\s+Citations') - 1)"), F.lit("\n\n"), F.col("facts"), F.lit("\n"), F.expr("substring(body, regexp_instr(body, r'(?i)\\n#\\s+Citations'))"))
    after = F.concat(F.regexp_replace("body", r"\s+$", ""), F.lit("\n\n"), F.col("facts"), F.lit("\n"))
    wanted = F.col("facts").isNotNull() & ~F.contains("body", mark)
    return joined.withColumn("body", F.when(wanted & (at > 0), before).when(wanted, after).otherwise(F.col("body"))).select(pages.columns)


def spoken(chunks: DataFrame) -> DataFrame:
    """(reply, pos, text): a reply's stream without its thoughts: nothing until the first closing tag, then all as it comes.

    chunks: reply, pos, text. A stream without a closing tag is sent whole, with its last chunk. The tag may
    be cut over chunks, so it is sought in the whole of what has come so far.
    """
    mark = "</think>"
    whole = chunks.groupBy("reply").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    joined = whole.withColumn("all", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    end = F.when(F.contains("all", F.lit(mark)), F.locate(mark, F.col("all")) + len(mark) - 1).otherwise(0)
    sent = joined.withColumn("end", end).select("reply", "all", "end", F.posexplode("parts").alias("i", "part"), F.size("parts").alias("n"))
    order = Window.partitionBy("reply").orderBy("i")
    stop = F.sum(F.length(F.coalesce("part.text", F.lit("")))).over(order)
    placed = sent.withColumn("stop", stop).withColumn("start", stop - F.length(F.coalesce("part.text", F.lit(""))))
    first = (F.col("start") < F.col("end")) & (F.col("stop") >= F.col("end"))
    rest = F.substring(F.col("part.text"), F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("int") + 1, F.length("part.text"))
    text = F.when(F.col("end") == 0, F.when(F.col("i") == F.col("n") - 1, F.when(F.col("all").rlike(r"\S"), F.col("all")))).when(first, F.regexp_replace(rest, r"^\s+", "")).when(F.col("start") >= F.col("end"), F.col("part.text"))
    return placed.select("reply", F.col("part.pos").alias("pos"), text.alias("text")).where("text <> ''")


def crawl_targets(html: DataFrame, origin: str, folder: str) -> DataFrame:
    """(url, target): distinct links of pages to HTML files below a folder of one site, without query and fragment. html: url, html."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+?\.html[^"]*)"'), 1))
    found = html.select("url", href.alias("href")).withColumn("path", F.regexp_replace("href", r"(?s)[?#].*$", ""))
    site = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)
    here = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*(?:/[^?#]*/|/))", 1)
    target = F.when(F.col("path").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("path")).when(F.startswith("path", F.lit("/")), F.concat(site, F.col("path"))).otherwise(F.concat(here, F.col("path")))
    return found.select("url", target.alias("target")).where(F.startswith("target", F.lit(origin + folder))).distinct()


def merged_pages(fetched: DataFrame) -> DataFrame:
    """One row a page of a scan that went on over several replies: the first title and text, and all categories in order, each once.

    fetched: page_id, pos, title, text, categories.
    """
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", "categories"))), lambda x: F.coalesce(x["categories"], F.array().cast("array<string>")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return fetched.groupBy("page_id").agg(first("title"), first("text"), F.array_distinct(F.flatten(lists)).alias("categories"))


def rendered_parts(replies: DataFrame, wanted: DataFrame) -> DataFrame:
    """(batch, pos, html): a reply that rendered several pages at once, taken apart at its marks; pages whose mark was lost have none.

    replies: batch, nonce, html; wanted: batch, pos.
    """
    mark = F.concat(F.lit("@@"), F.col("nonce"), F.lit(r"\s+(\d+)\s+"), F.col("nonce"), F.lit("@@"))
    parts = replies.select("batch", F.split("html", mark).alias("parts"), F.regexp_extract_all("html", mark, 1).alias("marks"))
    each = parts.select("batch", F.posexplode("marks").alias("i", "mark"), "parts").select("batch", F.col("mark").cast("int").alias("pos"), F.get("parts", F.col("i") + 1).alias("html"), "i")
    last = each.groupBy("batch", "pos").agg(F.max_by("html", "i").alias("html"))
    return wanted.join(last, ["batch", "pos"], "left").select("batch", "pos", F.coalesce("html", F.lit("")).alias("html"))


def frontier(start: DataFrame, links: DataFrame, most: int = 5000) -> DataFrame:
    """(url, level): pages reached over links, level by level, each once; no page beyond the first `most` is followed.

    start: url; links: url, target. Within a level pages are taken in the order of their urls.
    """
    from loreloom.plans.checkpoint import cut

    seen = cut(start.select("url").distinct().withColumn("level", F.lit(0)))
    level, n = 0, seen.count()
    while n < most:
        level += 1
        next_ = seen.where(F.col("level") == level - 1).join(links, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        new = cut(next_.orderBy("url").limit(most - n).withColumn("level", F.lit(level)))
        found = new.count()
        if not found:
            break
        n += found
        seen = cut(seen.unionByName(new))
    return seen


def decoded_links(x):
    return F.transform(x, percent_decoded)
