"""Queries over names, links, replies and context, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.functions import wiki
from loreloom.operators import catalog, pages, retrieval
from loreloom.registry import query, t
from loreloom.sources import artifacts


def _slug(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\s_]+', '-', 'g'), '[\\/:*?"<>|#]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"""


_TITLES = "title as (select page_id, url, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages)"


def _titled(s, d):
    return t(s, d, "pages").join(pages.titles(t(s, d, "pages")), "page_id")


@query("title_slug", f"with {_TITLES} select page_id, {_slug('title')} as slug from title")
def _(s, d):
    return _titled(s, d).select("page_id", tx.slug("title").alias("slug"))


@query(
    "page_concepts",
    f"""with {_TITLES}, n as (select *, cast(page_id % 3 * 7 as int) as ns, case page_id % 3 when 1 then 'Hilfe' when 2 then 'Kategorie' else '' end as name from title),
f as (select *, case when {_slug('title')} = '' then 'index-page' else {_slug('title')} end as file from n)
select page_id, case when name = '' then file else {_slug('name')} || '/' || file end as concept_id, case ns when 14 then 'Wiki Category' when 0 then 'Wiki Article' else 'Wiki Hilfe' end as kind from f""",
)
def _(s, d):
    named = _titled(s, d).withColumn("ns", (F.col("page_id") % 3 * 7).cast("int")).withColumn("name", F.when(F.col("page_id") % 3 == 1, "Hilfe").when(F.col("page_id") % 3 == 2, "Kategorie").otherwise(""))
    full = named.withColumn("title", F.when(F.col("name") != "", F.concat("name", F.lit(":"), "title")).otherwise(F.col("title")))
    return full.select("page_id", wiki.concept_id("title", "ns", "name").alias("concept_id"), wiki.concept_type("ns", "name").alias("kind"))


def _quoted(x: str) -> str:
    special = r"""regexp_matches({x}, '[:#\-?{}\[\],&*!|>''"%@`]|^\s|\s$')""".replace("{x}", x)
    return rf"""case when {x} = '' then '""' when regexp_matches({x}, '^[\d.+-]+$') or lower({x}) in ('true', 'false', 'null', 'yes', 'no', 'on', 'off') then '"' || replace({x}, '"', '\"') || '"' when {special} then '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' else {x} end"""


@query("yaml_scalars", f"select event_id, {_quoted('props')} as props, {_quoted('event_type')} as kind, {_quoted('cast(event_id - 5 as varchar)')} as number from events")
def _(s, d):
    return t(s, d, "events").select("event_id", tx.yaml_scalar("props").alias("props"), tx.yaml_scalar("event_type").alias("kind"), tx.yaml_scalar((F.col("event_id") - 5).cast("string")).alias("number"))


@query("color_codes", "select p_partkey, case p_partkey % 4 when 0 then 'FF0000' when 1 then printf('%06X', p_partkey) when 2 then 'AABBCC' else upper(p_type) end as color from part")
def _(s, d):
    raw = F.when(F.col("p_partkey") % 4 == 0, " Red").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("#"), F.lower(F.lpad(F.hex("p_partkey"), 6, "0")))).when(F.col("p_partkey") % 4 == 2, "#abc").otherwise(F.col("p_type"))
    return t(s, d, "part").select("p_partkey", wiki.color_code(raw).alias("color"))


@query("url_parts", r"""select page_id, split_part(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/', 1) as region, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) as path from pages where regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) <> '' and len(string_split(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/')) = 2""")
def _(s, d):
    path = F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1)
    parts = t(s, d, "pages").select("page_id", path.alias("path"), wiki.region_and_slug(F.concat(F.lit("/Karten/"), path, F.lit(".html")), "/Karten/").alias("at"))
    return parts.where(F.size(F.split("path", "/")) == 2).where("at is not null").select("page_id", "at.region", "path")


@query("reply_objects", r"select event_id, regexp_extract_all(props, '\{[^{}]*\}')[-1] as object from events")
def _(s, d):
    reply = F.concat(F.lit('<think>say {"a": 1}</think>a draft {"b": 2} and more</think>Here: {"c": 3} or '), "props", F.lit(" {no object}"))
    return t(s, d, "events").select("event_id", wiki.reply_object(reply).alias("object"))


@query("message_texts", "select conv_id, turn, case turn % 3 when 0 then text when 1 then text || '!' else '' end as text from conversations where text is not null")
def _(s, d):
    said = t(s, d, "conversations").where("text is not null")
    parts = F.expr("to_json(array(to_variant_object(named_struct('type', 'text', 'text', text)), to_variant_object(named_struct('type', 'image')), to_variant_object(named_struct('text', '!'))))")
    quoted = F.expr("substring(to_json(named_struct('a', text)), 6, length(to_json(named_struct('a', text))) - 6)")
    raw = F.when(F.col("turn") % 3 == 0, quoted).when(F.col("turn") % 3 == 1, parts).otherwise(F.lit("null"))
    return said.select("conv_id", "turn", wiki.content_text(raw).alias("text"))


@query("route_ends", "select c_custkey, n_name as source, lower(c_mktsegment) as goal from customer join nation on c_nationkey = n_nationkey")
def _(s, d):
    asked = t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    a, b = F.col("n_name"), F.lower("c_mktsegment")
    first = F.concat(F.lit("Wie komme ich von der "), a, F.lit(" zum "), b, F.lit("?"))
    second = F.concat(F.lit("Bitte den Weg nach dem "), b, F.lit(" vom "), a)
    third = F.concat(F.lit("how do I get from the "), a, F.lit(" to "), b, F.lit(" bitte!"))
    text = F.when(F.col("c_custkey") % 3 == 0, first).when(F.col("c_custkey") % 3 == 1, second).otherwise(third)
    return asked.select("c_custkey", wiki.route_ends(text).alias("e")).select("c_custkey", "e.source", "e.goal")


@query("question_forms", "select c_custkey, 'Markt ' || c_custkey as place, lower(replace(c_mktsegment, ' ', '-')) as hint from customer")
def _(s, d):
    text = F.concat(F.lit(" Markt "), F.col("c_custkey"), F.lit(" in "), F.initcap("c_mktsegment"))
    return t(s, d, "customer").select("c_custkey", wiki.question_forms(text).alias("q")).select("c_custkey", F.element_at("q.forms", -1).alias("place"), "q.hint")


_EDGE = "(^|[^a-z0-9_])(?:{})($|[^a-z0-9_])"
_ASKED = "lower(case conv_id % 4 when 0 then 'Zeig die Karte. ' when 1 then 'Welche Gilden gibt es? ' else '' end || text)"


@query("question_kinds", f"""select conv_id, turn, regexp_matches({_ASKED}, '{_EDGE.format("karte|stadtplan|lageplan|landkarte|plan|map")}') as wants_map, regexp_matches({_ASKED}, '{_EDGE.format("alle|sämtliche|saemtliche|liste|auflisten|list|welche|übersicht|uebersicht|gibt es|jede[nrs]?")}') as wants_list from conversations where role = 'user' and text is not null""")
def _(s, d):
    asked = F.concat(F.when(F.col("conv_id") % 4 == 0, "Zeig die Karte. ").when(F.col("conv_id") % 4 == 1, "Welche Gilden gibt es? ").otherwise(""), "text")
    return t(s, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", wiki.wants_map(asked).alias("wants_map"), wiki.wants_list(asked).alias("wants_list"))


_NOUNS = "list_distinct(list_transform(regexp_extract_all({}, '[A-ZÄÖÜ][a-zäöüß]{{3,}}'), lambda w: lower(w)))"
_STEMS = "list_distinct(list_transform({}, lambda w: left(w, 4)))"


@query("legend_affinity", f"""with n as (select conv_id, turn, {_NOUNS.format("text")} as a, {_NOUNS.format("lag(text) over (partition by conv_id order by turn)")} as b from conversations)
select conv_id, turn, cast(len(a) as int) as nouns, cast(2 * len(list_intersect(a, b)) + len(list_intersect({_STEMS.format("a")}, {_STEMS.format("b")})) as int) as affinity from n where b is not null and a is not null""")
def _(s, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = t(s, d, "conversations").select("conv_id", "turn", wiki.landmarks("text").alias("a"), wiki.landmarks(before).alias("b"))
    return both.where("a is not null and b is not null").select("conv_id", "turn", F.size("a").alias("nouns"), wiki.affinity(F.col("a"), F.col("b")).alias("affinity"))


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("legend_notes", f"""select conv_id, turn, {_SQUEEZE.format("regexp_extract(text, '^([^:(\\n]*)', 1)")} as short, 'Kartenwechsel – ' || case turn % 3 when 0 then 'hochklettern' when 1 then 'runterklettern' else 'klettern' end || ' (genauer Befehl unklar)' as note,
case when turn % 2 = 0 then 'durch den Spalt kriechen' else {_SQUEEZE.format("text")} end as way from conversations where text is not null and not contains(text, '(') and not regexp_matches(lower(text), 'hoch|hinauf|aufsteig|runter|hinab|hinunter')""")
def _(s, d):
    said = t(s, d, "conversations").where("text is not null and not contains(text, '(') and not lower(text) rlike 'hoch|hinauf|aufsteig|runter|hinab|hinunter'")
    climb = F.concat("text", F.when(F.col("turn") % 3 == 0, " geht hoch").when(F.col("turn") % 3 == 1, " hinab").otherwise(" weiter"))
    way = F.concat("text", F.when(F.col("turn") % 2 == 0, " (durch den  Spalt kriechen)").otherwise(""))
    return said.select("conv_id", "turn", wiki.short_name("text").alias("short"), wiki.climb_note(climb).alias("note"), wiki.special_way(way).alias("way"))


@query("page_paragraph", rf"""with p as (select page_id, list_filter(list_transform(regexp_extract_all(html, '<p(?:\s[^>]*)?>(.*?)</p>', 1, 'is'), lambda x: {_SQUEEZE.format("regexp_replace(x, '<[^>]*>', '', 'g')")}), lambda x: x <> '') as t from pages) select page_id, coalesce(trim(left(t[1], 200)), '') as description from p""")
def _(s, d):
    return t(s, d, "pages").select("page_id", wiki.paragraph("html").alias("description"))


@query("clean_names", "select page_id, trim(regexp_replace(regexp_replace(title, '[\\[\\]*`]', '', 'g'), '\\s+', ' ', 'g')) || ' (alt)' as name from (select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages)")
def _(s, d):
    linked = F.concat(F.lit("**["), F.regexp_replace("title", r"[\[\]]", ""), F.lit("](/x_(y).md)**  `(alt)`"))
    return _titled(s, d).select("page_id", wiki.clean_name(linked).alias("name"))


@query("map_pages", "select doc_id, doc_id % 5 = 0 as draws_map, doc_id % 5 in (0, 1) as audited, doc_id % 3 = 0 as own_render from documents where text is not null and not regexp_matches(text, '[o~]--|--[o~]|o--|\\n\\s*[o~]\\s|┌')")
def _(s, d):
    docs = t(s, d, "documents").where(r"text is not null and not text rlike '[o~]--|--[o~]|o--|\\n\\s*[o~]\\s|┌'")
    shown = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\no--o").when(F.col("doc_id") % 5 == 1, "┌┐").otherwise(""))
    source = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "{{ pagename }}").otherwise(""))
    return docs.select("doc_id", wiki.draws_map(shown).alias("draws_map"), wiki.draws_boxes(shown).alias("audited"), wiki.needs_own_render(source).alias("own_render"))


def _concepts(s, d):
    """Documents as pages of categories."""
    docs = t(s, d, "documents")
    page = docs.select(F.col("doc_id").cast("string").alias("concept_id"), F.coalesce(F.substring("text", 1, 12), F.lit("")).alias("title"), F.when(F.col("doc_id") % 11 == 0, 14).otherwise(0).alias("namespace"))
    return docs.select(F.col("source").alias("category"), F.col("doc_id").cast("string").alias("concept_id")), page


_CONCEPTS = "m as (select source as category, cast(doc_id as varchar) as concept_id, coalesce(left(text, 12), '') as title from documents where doc_id % 11 <> 0)"


@query("category_listing", f"""with {_CONCEPTS}, r as (select *, row_number() over (partition by category order by title, concept_id) as k, count(*) over (partition by category) as n from m)
select category, any_value(n) as n, 'Kategorie „' || category || '" — ' || any_value(n) || ' Einträge:' || chr(10) || string_agg(title, ', ' order by k) filter (k <= 30) || case when any_value(n) > 30 then chr(10) || '… und ' || (any_value(n) - 30) || ' weitere.' else '' end as text from r group by category""")
def _(s, d):
    return retrieval.listings(*_concepts(s, d), most=30, collation="UTF8_BINARY").select("category", "n", "text")


@query("category_phrases", f"with {_CONCEPTS}, r as (select *, row_number() over (partition by category order by concept_id) as k from m where not contains(category, '/') and not contains(category, ':')) select category, category || '. Enthält: ' || string_agg(title, ', ' order by k) as phrase from r where k <= 20 group by category")
def _(s, d):
    return retrieval.phrases(*_concepts(s, d))


@query("named_categories", "select conv_id as query_id, 1 as rank, 'Region/' || r_name as category from (select distinct conv_id from conversations) join region on conv_id % 5 = r_regionkey where length(r_name) >= 4")
def _(s, d):
    region = t(s, d, "region")
    asked = t(s, d, "conversations").select("conv_id").distinct().join(F.broadcast(region), F.col("conv_id") % 5 == F.col("r_regionkey"))
    asked = asked.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("alle "), F.lower("r_name"), F.lit("region bitte")).alias("text"))
    return retrieval.named_categories(asked, region.where("length(r_name) >= 4").select(F.concat(F.lit("Region/"), "r_name").alias("category")))


@query("title_index", f"""with {_TITLES}, k as (select regexp_replace(lower(title), '\\s+', ' ', 'g') as title, page_id from title) select title, cast(max(page_id) as varchar) as concept_id from k group by title""")
def _(s, d):
    listed = _titled(s, d).select(F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("concept_id"), "title", F.lit("text").alias("body"), F.lit(0).alias("namespace"))
    return catalog.titles(listed)


@query("context_block", """with r as (select source, doc_id, coalesce(left(text, 40), '') as text, row_number() over (partition by source order by doc_id desc) as d from documents),
x as (select source, doc_id, text, 0 as l, d as k from r where d <= 2 union all select source, doc_id, text, 1, d from r where d between 3 and 5),
n as (select *, row_number() over (partition by source order by l, k) as i from x)
select source as query_id, string_agg('[' || i || '] doc ' || doc_id || chr(10) || text, chr(10) || chr(10) order by i) as context from n group by source""")
def _(s, d):
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    docs = t(s, d, "documents").select(F.col("source").alias("query_id"), newest.alias("pos"), F.col("doc_id").cast("string").alias("concept_id"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("text"))
    return retrieval.formatted(retrieval.assembled(docs.where("pos <= 2"), docs.where("pos <= 5")))


@query("link_resolution", f"""with {_TITLES}, l as (select page_id, row_number() over (partition by page_id order by page_id) - 1 as pos, page_id + 1 as goal from pages), k as (select lower(regexp_replace(title, '\\s+', ' ', 'g')) as key, min(cast(page_id as varchar)) as goal from title group by 1)
select l.page_id as page, coalesce(n.title, 'Rote Seite ' || l.goal) as title, case when n.title is null then 'https://wiki.example.org/Rote_Seite_' || l.goal else '/' || k.goal || '.md' end as url from l left join title n on n.page_id = l.goal left join k on k.key = lower(regexp_replace(n.title, '\\s+', ' ', 'g'))""")
def _(s, d):
    titled = _titled(s, d).select("page_id", "title")
    after = titled.select((F.col("page_id") - 1).alias("page"), "title")
    links = titled.select(F.col("page_id").alias("page")).join(after, "page", "left").select("page", F.lit(0).alias("pos"), F.coalesce("title", F.concat(F.lit("Rote Seite "), (F.col("page") + 1).cast("string"))).alias("title"))
    return retrieval.linked_titles(links, titled.select(F.col("page_id").cast("string").alias("concept_id"), "title"), "https://wiki.example.org/").select("page", "title", "url")


@query("bulk_merge", """with c as (select conv_id, role, min(turn) as first from conversations group by all), g as (select conv_id, string_agg(role, ',' order by first) as categories from c group by conv_id)
select conv_id as page_id, case when min(turn) filter (turn >= 1) is not null then 'turn ' || min(turn) filter (turn >= 1) end as title, arg_min(text, turn) filter (text is not null) as text, any_value(categories) as categories from conversations join g using (conv_id) group by conv_id""")
def _(s, d):
    title = F.when(F.col("turn") >= 1, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    fetched = t(s, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), title.alias("title"), "text", F.array("role").alias("categories"))
    return retrieval.merged_pages(fetched).withColumn("categories", F.array_join("categories", ","))


@query("render_split", "select conv_id as batch, cast(turn as int) as pos, case when turn = 3 then '' else '<p>' || coalesce(text, '') || '</p>' end as html from conversations")
def _(s, d):
    said = t(s, d, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").cast("int").alias("pos"), "text")
    part = F.concat(F.lit("<p>"), F.coalesce("text", F.lit("")), F.lit("</p>"))
    marked = F.concat(F.when(F.col("pos") != 3, F.concat(F.lit("@@a1b2 "), F.col("pos").cast("string"), F.lit(" a1b2@@"), part)).otherwise(""))
    replies = said.groupBy("batch").agg(F.concat(F.lit("<hr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", marked.alias("m")))), lambda x: x["m"]), "")).alias("html")).withColumn("nonce", F.lit("a1b2"))
    return retrieval.rendered_parts(replies, said.select("batch", "pos"))


@query("spoken_stream", """with c as (select conv_id, turn, text, max(turn) over (partition by conv_id) as last from conversations where text is not null and trim(text) <> ''),
w as (select conv_id, max(turn) as turn, string_agg(text, '' order by turn) as text from c where conv_id % 2 = 1 group by conv_id)
select conv_id as reply, turn as pos, text from w union all select conv_id, turn, case when turn = 1 then regexp_replace(text, '^\\s+', '') else text end from c where conv_id % 2 = 0 and turn >= 1""")
def _(s, d):
    said = t(s, d, "conversations").where("text is not null and trim(text) <> ''")
    cut = F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") == 0), F.concat("text", F.lit("</thi"))).when((F.col("conv_id") % 2 == 0) & (F.col("turn") == 1), F.concat(F.lit("nk> "), "text")).otherwise(F.col("text"))
    return retrieval.spoken(said.select(F.col("conv_id").alias("reply"), F.col("turn").alias("pos"), cut.alias("text")))


@query("facts_backfill", """select cast(doc_id as varchar) as concept_id, case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then text || chr(10) || '## Kenndaten' when doc_id % 4 = 2 then text || chr(10) || chr(10) || 'F' || doc_id || chr(10) || chr(10) || '# Citations' else regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || 'F' || doc_id || chr(10) end as body from documents where text is not null""")
def _(s, d):
    docs = t(s, d, "documents").where("text is not null")
    tail = F.when(F.col("doc_id") % 4 == 1, "\n## Kenndaten").when(F.col("doc_id") % 4 == 2, "\n# Citations").otherwise("")
    listed = docs.select(F.col("doc_id").cast("string").alias("concept_id"), F.concat("text", tail).alias("body"))
    facts = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("concept_id"), F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("facts"))
    return retrieval.with_facts(listed, facts)


@query("crawl_targets", """with h as (select page_id, url, unnest(['/Karten/a' || page_id || '.html?x=1', 'https://maps.example.org/Karten/sub/b.html#top', 'c.txt', '/Karten/a' || page_id || '.html', 'https://elsewhere.example.org/Karten/d.html']) as href from pages)
select distinct 'https://maps.example.org/Karten/' || page_id || '.html' as url, case when starts_with(href, '/') then 'https://maps.example.org' else '' end || regexp_replace(href, '[?#].*$', '') as target from h where (starts_with(href, '/') or starts_with(href, 'https://maps.')) and contains(href, '.html')""")
def _(s, d):
    link = lambda x: F.concat(F.lit('<a href="'), x, F.lit('">'))
    own = F.concat(F.lit("/Karten/a"), F.col("page_id").cast("string"), F.lit(".html"))
    html = F.concat("html", link(F.concat(own, F.lit("?x=1"))), link(F.lit("https://maps.example.org/Karten/sub/b.html#top")), link(F.lit("c.txt")), link(own), link(F.lit("https://elsewhere.example.org/Karten/d.html")))
    shown = t(s, d, "pages").select(F.concat(F.lit("https://maps.example.org/Karten/"), F.col("page_id").cast("string"), F.lit(".html")).alias("url"), F.regexp_replace(html, r'href="[^"]*\.html"', "").alias("rest"), html.alias("html"))
    return retrieval.crawl_targets(shown.select("url", "html"), "https://maps.example.org", "/Karten/")


@query("sync_actions", """select coalesce(n.k, o.k) as title, cast(coalesce(n.k, o.k) as varchar) || case when n.k % 13 = 0 then 'x' else '' end as concept_id,
case when n.k is null then 'delete' when o.k is null then 'create' when n.k % 13 = 0 then 'rename' when n.k % 7 <> 0 or n.k % 2 = 0 then 'skip' else 'update' end as action
from (select doc_id as k from documents where doc_id % 10 <> 1) n full join (select doc_id as k from documents where doc_id % 10 <> 0) o on n.k = o.k""")
def _(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("title"), F.col("doc_id").cast("string").alias("concept_id"), F.lit(1).alias("revid"), F.lit("h").alias("contenthash"))
    moved = F.when(F.col("title") % 13 == 0, F.concat("concept_id", F.lit("x"))).otherwise(F.col("concept_id"))
    live = docs.where("title % 10 <> 1").select("title", moved.alias("concept_id"), F.when(F.col("title") % 7 == 0, 2).otherwise(1).alias("revid"), F.when(F.col("title") % 2 == 0, "h").otherwise(F.lit("changed")).alias("contenthash"))
    return artifacts.synced(docs.where("title % 10 <> 0"), live, full=True)


@query("archive_merge", "select doc_id as concept_id, case when doc_id % 3 = 0 then 'new' else lang end as source from documents where doc_id % 9 <> 1")
def _(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("concept_id"), F.col("lang").alias("source"))
    return artifacts.removed(artifacts.archived(docs, docs.where("concept_id % 3 = 0").withColumn("source", F.lit("new"))), docs.where("concept_id % 9 = 1"))
