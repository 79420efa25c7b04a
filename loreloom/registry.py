"""Queries of the engine over the tables of a folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import catalog, dialog, graph, journal, pages, parsers, positions, raster, search, sync
from loreloom.streaming import events as ev

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TERMS = ["that", "thes", "inte"]
_STOP = ", ".join(f"'{w}'" for w in tx.SEARCH_STOP)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TOKENS = f"""tok as (select doc_id, list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(coalesce(text, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+'), lambda x: length(x) >= 2 and x not in ({_STOP})) as tokens from documents),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from tok) group by all)"""
_BM25 = f"""{_TOKENS},
q(term, pos) as (values ('that', 0), ('thes', 1), ('inte', 2)),
len as (select doc_id, len(tokens) as len from tok),
tot as (select count(*) as n, avg(len) as mean from len),
df as (select term, count(*) as df from post group by term),
scored as (select p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) as exact, round(exact, 6) as score, min(pos) as pos
  from post p join q using (term) join df using (term) join len using (doc_id) cross join tot group by p.doc_id)"""


@query("bm25_topk", f"with {_BM25} select doc_id, score from scored order by score desc, pos, doc_id limit 10")
def _(s, d):
    return search.bm25(t(s, d, "documents"), TERMS, 10)


@query("bm25_postings", f"with {_TOKENS} select doc_id, term, tf from post")
def _(s, d):
    return search.build_index(t(s, d, "documents")).postings


@query("bm25_df", f"with {_TOKENS} select term, count(*) as df from post group by term")
def _(s, d):
    return search.build_index(t(s, d, "documents")).frequencies


@query("bm25_doclen", f"with {_TOKENS} select doc_id, cast(len(tokens) as bigint) as len from tok")
def _(s, d):
    return search.build_index(t(s, d, "documents")).lengths


#: A fixed query vector, made by a rule.
VECTOR = [((7 * i) % 11 - 5) / 5 for i in range(64)]
_VEC = "[" + ", ".join(f"cast({x} as double)" for x in VECTOR) + "]"
_DENSE = f"select vec_id as doc_id, round(list_dot_product(cast(embedding as double[]), {_VEC}) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product({_VEC}, {_VEC}))), 6) as score from embeddings"


@query("dense_topk", f"select * from ({_DENSE}) order by score desc, doc_id limit 10")
def _(s, d):
    return search.dense(t(s, d, "embeddings"), VECTOR, 10)


@query(
    "hybrid_rrf",
    f"""with {_BM25}, a as (select doc_id, row_number() over (order by score desc, doc_id) - 1 as r from ({_DENSE} order by score desc, doc_id limit 40)),
b as (select doc_id, row_number() over (order by exact desc, pos, doc_id) - 1 as r from scored qualify r < 40),
u as (select doc_id, r, 0 as side from a union all select doc_id, r, 1 from b)
select doc_id, round(sum(1.0 / (60 + r)), 6) as score from u group by doc_id order by score desc, min(side), min(side * 1000 + r) limit 10""",
)
def _(s, d):
    first = search.ranked(search.dense(t(s, d, "embeddings"), VECTOR, 40))
    return search.fuse(first, search.bm25_ranked(t(s, d, "documents"), TERMS, 40), 10)


@query(
    "category_nearest",
    f"""with m as (select label, i, avg(cast(embedding[i] as double)) as x from embeddings, range(1, 65) r(i) group by all), c as (select label, list(x order by i) as v from m group by label)
select label, score from (select label, round(list_dot_product(v, {_VEC}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({_VEC}, {_VEC}))), 6) as score from c) where score >= -0.5 order by score desc, label limit 5""",
)
def _(s, d):
    return search.nearest_categories(t(s, d, "embeddings"), VECTOR, 5, -0.5)


def _snapshots(s, d):
    docs = t(s, d, "documents")
    new = docs.where("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    return docs.where("doc_id % 10 <> 0"), new


_SNAP = "old as (select * from documents where doc_id % 10 <> 0), new as (select doc_id, case when doc_id % 7 = 0 then text || ' revised' else text end as text from documents where doc_id % 10 <> 1)"


@query("sync_changes", f"with {_SNAP} select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'Creation' when n.doc_id is null then 'Deprecation' else 'Update' end as change from old o full join new n on o.doc_id = n.doc_id where o.doc_id is null or n.doc_id is null or o.text is distinct from n.text")
def _(s, d):
    return sync.changes(*_snapshots(s, d))


for _kind, _side in (("reused", "in"), ("missing", "not in"), ("dropped", "not in")):
    _a, _b = ("old", "new") if _kind == "dropped" else ("new", "old")

    @query(f"chunk_{_kind}", f"with {_SNAP} select distinct sha256(text) as hash from {_a} where text is not null and sha256(text) {_side} (select sha256(text) from {_b} where text is not null)")
    def _(s, d, kind=_kind):
        return sync.reuse(*_snapshots(s, d))[kind]


@query("exact_dup_groups", "select sha256(text) as hash, min(doc_id) as first, count(*) as copies from documents where text is not null group by all having count(*) > 1")
def _(s, d):
    return sync.equal_texts(t(s, d, "documents"))


@query("category_counts", "select source, count(*) as members from documents where source is not null group by source")
def _(s, d):
    return pages.category_sizes(t(s, d, "documents"), "source")


@query("category_members", "select source, doc_id, cast(r as int) as rank from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents where source is not null) where r <= 20")
def _(s, d):
    return pages.category_samples(t(s, d, "documents"), "source", "doc_id")


@query("page_title", "select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages")
def _(s, d):
    return pages.titles(t(s, d, "pages"))


_LINKS = """l as (select page_id, cast(i - 1 as int) as pos, h[i] as href from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages), range(1, 1000) r(i) where i <= len(h))"""


@query("page_links", f"with {_LINKS} select * from l")
def _(s, d):
    return pages.links(t(s, d, "pages"))


@query("page_shared_links", f"with {_LINKS} select href, count(distinct page_id) as pages from l group by href having count(distinct page_id) > 1")
def _(s, d):
    return pages.shared_links(t(s, d, "pages"))


@query("page_neighbors", f"""with {_LINKS}, w as (select '/' || split_part(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' ', 1) as href, max(page_id) as target from pages group by 1),
f as (select page_id, target, min(pos) as pos from l join w using (href) where page_id <> target group by all) select page_id, cast(r as int) as rank, target from (select *, row_number() over (partition by page_id order by pos) as r from f) where r <= 3""")
def _(s, d):
    return pages.neighbours(t(s, d, "pages"))


@query("page_host_rollup", "select regexp_extract(url, '://([^/?#]*)', 1) as host, count(*) as pages, min(page_id) as first_page from pages group by 1")
def _(s, d):
    return pages.host_rollup(t(s, d, "pages"))


_PLAIN = "html"
for _tag in ("head", "script", "style", "nav", "footer"):
    _PLAIN = f"regexp_replace({_PLAIN}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gs')"
_PLAIN = f"regexp_replace(regexp_replace({_PLAIN}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
for _name, _value in (("&nbsp;", " "), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_value}')"


@query("page_clean_text", f"select page_id, trim(regexp_replace({_PLAIN}, '[ \\t\\n\\r]+', ' ', 'g')) as text from pages")
def _(s, d):
    return pages.plain_text(t(s, d, "pages"))


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("benchmark_contained", f"select item_id, doc_id from (select item_id, {_NORM} as needle from benchmark) b join (select doc_id, {_NORM} as hay from documents) d on contains(' ' || hay || ' ', ' ' || needle || ' ') where needle <> ''")
def _(s, d):
    return pages.contained(t(s, d, "benchmark"), t(s, d, "documents"), "item_id", "text", "doc_id", "text")


@query("last_user_turn", "select conv_id, right(arg_max(text, turn), 1200) as question from conversations where role = 'user' group by conv_id")
def _(s, d):
    return dialog.last_question(t(s, d, "conversations"))


@query("history_window", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations), f as (select *, max(cast(role = 'user' as int)) over (partition by conv_id order by turn rows unbounded preceding) as started from r where back <= 6) select conv_id, turn, role, text from f where started = 1")
def _(s, d):
    return dialog.history(t(s, d, "conversations"))


@query("conversation_context", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, right(string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn), 2000) as context from r where back <= 6 group by conv_id")
def _(s, d):
    return dialog.context(t(s, d, "conversations"))


@query("route_intent", r"select conv_id, turn, regexp_matches(lower(text), '(?s)(^|[^a-z0-9_])(?:weg|route|wegbeschreibung|wie\s+(?:komme|gelange|laufe)|how\s+(?:do|can|to)|get\s+(?:to|from)|way\s+(?:to|from)|directions?|von\s.*\s(?:nach|zu|zum|zur)|from\s.*\sto)($|[^a-z0-9_])') as wants_route from conversations where role = 'user'")
def _(s, d):
    return dialog.route_questions(t(s, d, "conversations"))


@query("think_strip", "select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as reply from conversations where role = 'assistant'")
def _(s, d):
    turns = t(s, d, "conversations").where("role = 'assistant'")
    thought = turns.withColumn("text", F.concat(F.lit("<think>about\nit</think>\n"), "text"))
    return thought.select("conv_id", "turn", tx.without_thoughts("text").alias("reply"))


def _lanes(s, d):
    """Each customer nation's two largest supplier nations, by lines."""
    lines = t(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    from pyspark.sql import Window

    counted = lines.where("src <> dst").groupBy("src", "dst").count()
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))
    return counted.withColumn("rank", rank).where("rank <= 2").select("src", "dst", (F.col("rank") + F.col("dst") % 3).cast("double").alias("weight"))


_LANES = """lane as materialized (select src, dst, cast(r + dst % 3 as double) as weight from (select src, dst, row_number() over (partition by src order by count(*) desc, dst) as r
  from (select c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey) where src <> dst group by src, dst) where r <= 2)"""


@query("nation_shortest_path", f"with recursive {_LANES}, walk(node, cost, n) as (select 0, cast(0 as double), 0 union select dst, cost + weight, n + 1 from walk join lane on src = node where n < 14) select 0 as source, node, min(cost) as cost from walk group by node")
def _(s, d):
    start = s.createDataFrame([(0,)], "source int")
    return graph.shortest_paths(_lanes(s, d), start).select("source", "node", "cost")


@query("nation_bfs_levels", f"with recursive {_LANES}, walk(node, n) as (select 0, 0 union select dst, n + 1 from walk join lane on src = node where n < 24) select 0 as source, node, min(n) as level from walk group by node")
def _(s, d):
    return graph.levels(_lanes(s, d), s.createDataFrame([(0,)], "source int"))


_PARTS = f"{_LANES}, both_ways as (select src, dst from lane union select dst, src from lane), reach(node, other) as (select n_nationkey, n_nationkey from nation union select node, dst from reach join both_ways on src = other), comp as (select node, min(other) as component from reach group by node)"


@query("nation_components", f"with recursive {_PARTS} select node, component from comp")
def _(s, d):
    return graph.components(t(s, d, "nation").select(F.col("n_nationkey").alias("node")), _lanes(s, d))


@query(
    "graph_diagnostics",
    f"""with recursive {_PARTS}, p as (select distinct least(src, dst) as a, greatest(src, dst) as b from lane), deg as (select node, count(*) as k from (select a as node from p union all select b from p) group by node),
every as (select n_nationkey as node, coalesce(k, 0) as k from nation left join deg on node = n_nationkey)
select count(*) as nodes, (select count(*) from p) as edges, count(*) filter (k = 0) as isolated, max(k) as max_degree, (select node from every order by k desc, node limit 1) as max_node, (select count(distinct component) from comp) as components from every""",
)
def _(s, d):
    return graph.health(t(s, d, "nation").select(F.col("n_nationkey").alias("node")), _lanes(s, d))


def _two_sources(s, d):
    order = t(s, d, "orders")
    first = order.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 40).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("command"))
    second = order.where("o_orderkey % 3 <> 0").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 40).alias("dst"), F.col("o_orderstatus").alias("command"))
    return first, second


@query(
    "edge_merge_override",
    """with a as (select o_custkey % 50 as src, o_orderkey % 40 as dst, case when o_orderkey % 2 = 0 then o_orderpriority end as command from orders where o_orderkey % 3 = 0),
b as (select o_custkey % 50 as src, o_orderkey % 40 as dst, o_orderstatus as command from orders where o_orderkey % 3 <> 0)
select *, 'primary' as origin from a union all select *, 'secondary' from b where not exists (select 1 from a where a.src = b.src and a.dst = b.dst and a.command is not null)""",
)
def _(s, d):
    return graph.override(*_two_sources(s, d))


_KIND = "case (row * 7 + col * 5) % 9 when 0 then 'road' when 1 then 'water' when 2 then 'rock' when 3 then 'forest' else 'grass' end"


def _tiles(s):
    grid = s.range(24).select(F.col("id").alias("row")).join(s.range(24).select(F.col("id").alias("col")))
    return grid.select(F.lit("r").alias("region"), "row", "col", F.expr(_KIND).alias("terrain"), F.lit("grass").alias("base"))


@query("grid_road_continuity", f"with g as (select r.range as row, c.range as col from range(24) r, range(24) c), t as (select row, col, {_KIND} as terrain from g) select 'r' as region, row, col, case when terrain = 'road' and not exists (select 1 from t u where u.terrain = 'road' and abs(u.row - t.row) <= 1 and abs(u.col - t.col) <= 1 and (u.row <> t.row or u.col <> t.col)) then 'grass' else terrain end as terrain, 'grass' as base from t")
def _(s, d):
    return raster.road_continuity(_tiles(s))


@query("grid_footprint", "select l_orderkey as label, r.range as row, c.range as col from lineitem, range(20) r, range(20) c where r.range between (l_orderkey % 90) // 12 and (l_orderkey % 90 + 30) // 12 and c.range between (l_partkey % 90) // 12 and (l_partkey % 90 + 20) // 12")
def _(s, d):
    rects = t(s, d, "lineitem")
    y, x = F.col("l_orderkey") % 90, F.col("l_partkey") % 90
    return raster.footprints(rects.select(F.col("l_orderkey").alias("label"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 30).alias("y2")))


@query("grid_route")
def _(s, d):
    tiles = _tiles(s).withColumn("blocked", F.lit(False))
    for name, value in {"from_row": 0, "from_col": 0, "to_row": 23, "to_col": 23}.items():
        tiles = tiles.withColumn(name, F.lit(value))
    return raster.routes(tiles)


@query("affine_fit", "select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem group by l_returnflag having count(*) >= 3")
def _(s, d):
    return positions.affine_fit(t(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(
    "side_ordinals",
    """with c as (select distinct s_nationkey as map, s_suppkey % 17 as "row", s_suppkey % 23 as col from supplier), b as (select *, "row" - min("row") over w as n, max("row") over w - "row" as s, col - min(col) over w as w_, max(col) over w - col as e from c window w as (partition by map)),
p as (select map, "row", col, case least(n, s, w_, e) when n then 'N' when s then 'S' when w_ then 'W' else 'E' end as side from b)
select *, cast(row_number() over (partition by map, side order by case when side in ('N', 'S') then col else "row" end, "row", col) - 1 as int) as ordinal from p""",
)
def _(s, d):
    return positions.side_ordinals(t(s, d, "supplier").select(F.col("s_nationkey").alias("map"), (F.col("s_suppkey") % 17).alias("row"), (F.col("s_suppkey") % 23).alias("col")).distinct())


@query(
    "nearest_position",
    """with l as (select c_custkey, c_nationkey as g, c_acctbal as x from customer), r as (select s_suppkey, s_nationkey as g, s_acctbal as x from supplier)
select c_custkey, s_suppkey, round(dist, 4) as distance from (select c_custkey, s_suppkey, abs(l.x - r.x) as dist, row_number() over (partition by c_custkey order by abs(l.x - r.x), s_suppkey) as n from l join r using (g)) where n = 1""",
)
def _(s, d):
    left = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"))
    right = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"))
    return positions.nearest(left, right, "g", "x", "c_custkey", "s_suppkey").where("s_suppkey is not null").withColumn("distance", F.round("distance", 4))


@query(
    "step_run_length",
    """with b as (select user_id, event_type, ts, event_id, case when row_number() over w > 1 and lag(event_type) over w is not distinct from event_type then 0 else 1 end as b from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) - 1 as run from b) select user_id, cast(run as bigint) as run, any_value(event_type) as event_type, count(*) as steps from n group by user_id, run""",
)
def _(s, d):
    return positions.runs(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("events_tumbling", "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return ev.windowed(ev.timed(t(s, d, "events")), "1 day")


@query("events_sessions", "with b as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as b from events), n as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from b) select user_id, min(ts) as session_start, count(*) as n from n group by user_id, k")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return ev.sessions(ev.timed(t(s, d, "events")), "6 hours")


@query("events_sliding", "with w as (select *, unnest([time_bucket(interval 12 hours, ts, timestamp '1970-01-01'), time_bucket(interval 12 hours, ts, timestamp '1970-01-01') - interval 12 hours]) as window_start from events) select window_start, event_type, count(*) as n, round(sum(value), 4) as total from w group by all")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return ev.windowed(ev.timed(t(s, d, "events")), "1 day", "12 hours")


@query("directory_index", """select regexp_replace(p, '/?[^/]*$', '') as dir, count(*) as pages, string_agg('* [' || title || '](' || split_part(p, '/', 2) || '.md)', chr(10) order by title, split_part(p, '/', 2)) as lines
from (select source || '/' || doc_id as p, coalesce(left(trim(text), 20), '') as title from documents) group by 1""")
def _(s, d):
    docs = t(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("p"), F.coalesce(F.left(F.btrim("text", F.lit(" ")), F.lit(20)), F.lit("")).alias("title"))
    return journal.directory_index(docs, "p", "title")


@query("change_log", """select day, '## ' || day || chr(10) || string_agg('* **' || event_type || '**: ' || n || ' from ' || first, chr(10) order by event_type) as section
from (select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, min(event_id) as first from events group by all) group by day""")
def _(s, d):
    events = t(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "event_id")
    return journal.change_log(events, "day", "event_type", "event_id")


@query("fetch_batches", "select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) // 50 as int) as batch from documents")
def _(s, d):
    return journal.batches(t(s, d, "documents"), "source", "doc_id")


@query("spread_pick", "with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as c from events) select user_id, event_id from n where c <= 4 or i in (c // 8, 3 * c // 8, 5 * c // 8, 7 * c // 8)")
def _(s, d):
    return journal.spread_pick(t(s, d, "events"), "user_id", "event_id", 4)


@query("category_aliases", "select source, lang || source as alias from (select distinct source, lang from documents)")
def _(s, d):
    named = t(s, d, "documents").select("source", "lang").distinct()
    return named.select("source", F.explode(tx.compound_aliases(F.concat("source", F.lit("/"), "lang"))).alias("alias"))


@query("title_mentions")
def _(s, d):
    titles = pages.titles(t(s, d, "pages")).select(F.element_at(F.split("title", " "), 1).alias("title"), "page_id").groupBy("title").agg(F.max("page_id").alias("concept_id"))
    asked = dialog.last_question(t(s, d, "conversations")).select(F.col("conv_id").alias("query_id"), F.col("question").alias("text"))
    return catalog.mentions(asked, titles)


@query("page_markdown")
def _(s, d):
    return parsers.markdown(t(s, d, "pages"))


@query("document_chunks")
def _(s, d):
    return parsers.chunks(t(s, d, "documents"), "doc_id", "text")


from loreloom import map_queries, wiki_queries  # noqa: E402, F401 - they add their queries to those above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
