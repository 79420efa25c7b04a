"""Queries over rooms, gateways, legends and tiles, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import graph, positions, rooms, tiles
from loreloom.registry import query, t

_ROOM_STOP = ", ".join(f"'{w}'" for w in tx.ROOM_STOP)


def _plain(x: str) -> str:
    for letter, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = f"replace({x if x.startswith('replace') else f'lower({x})'}, '{letter}', '{two}')"
    return x


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({_plain(x)}, '[^a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_ROOM_STOP})))"


def _parts(s, d):
    """Parts as rooms of brands."""
    return t(s, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))


@query("rooms_by_page", "select p_brand as page, string_agg(p_name, '|' order by p_partkey) as rooms from part group by p_brand")
def _(s, d):
    return rooms.rooms_by_page(_parts(s, d)).select("page", F.array_join("rooms", "|").alias("rooms"))


@query("room_index", "select p_brand as page, p_name as name from part union all select 'karte/' || r_name, r_name from region union all select 'karte/x', n_name from nation union all select 'karte/x', n_name || '_a' from nation where n_nationkey % 2 = 0")
def _(s, d):
    grids = t(s, d, "region").select(F.concat(F.lit("karte/"), "r_name").alias("page"), F.col("r_name").alias("region"))
    gates = t(s, d, "nation").select(F.lit("karte/x").alias("page"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("_a"))).otherwise(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))).alias("anchor"))
    return rooms.room_index(_parts(s, d), grids, gates)


def _asked(s, d):
    """A question for each type of part: its first part's name, and that name's last word."""
    first = t(s, d, "part").groupBy(F.col("p_type").alias("query_id")).agg(F.min_by("p_name", "p_partkey").alias("n"))
    return first.select("query_id", F.col("n").alias("form")), first.select("query_id", F.element_at(F.split("n", " "), -1).alias("form"))


_ASKED = "f as (select p_type as query_id, arg_min(p_name, p_partkey) as n from part group by p_type), a as (select query_id, n as form from f), b as (select query_id, list_last(string_split(n, ' ')) as form from f)"


@query("room_matches", f"with {_ASKED} select query_id, p_brand as page, p_name as name, max(p_name = form) as exact from b join (select distinct p_brand, p_name from part) on contains(' ' || p_name || ' ', ' ' || form || ' ') group by all")
def _(s, d):
    return rooms.room_matches(_asked(s, d)[1], _parts(s, d))


@query("page_candidates", f"""with {_ASKED}, r as (select distinct p_brand as page, p_name as name from part), h as (select query_id, 'brand#1' as hint from f),
p as (select distinct query_id, page, 4 as pts, 1 as side from a join r on contains(' ' || name || ' ', ' ' || form || ' ') union all select distinct query_id, page, 4, 2 from b join r on contains(' ' || name || ' ', ' ' || form || ' ')
 union all select distinct query_id, page, 1, 3 from a join r on len(list_intersect({_words("form")}, {_words("name")})) > 0 union all select distinct query_id, page, 1, 4 from b join r on len(list_intersect({_words("form")}, {_words("name")})) > 0),
s as (select query_id, page, sum(pts) + max(cast(contains(lower(page), hint) as int)) as score from p join h using (query_id) group by query_id, page)
select query_id, cast(k as int) as rank, page, cast(score as bigint) as score from (select *, row_number() over (partition by query_id order by score desc, page) as k from s) where k <= 5""")
def _(s, d):
    a, b = _asked(s, d)
    return rooms.page_candidates(a, b, _parts(s, d), a.select("query_id", F.lit("brand#1").alias("hint")))


@query("shared_pages", f"with {_ASKED} select query_id, p_brand as page from a join part on p_name = form intersect select query_id, p_brand from b join part on ends_with(p_name, ' ' || form)")
def _(s, d):
    a, b = _asked(s, d)
    parts = t(s, d, "part")
    return rooms.shared_pages(a.join(parts, F.col("p_name") == F.col("form")).select("query_id", F.col("p_brand").alias("page")), b.join(parts, F.endswith("p_name", F.concat(F.lit(" "), "form"))).select("query_id", F.col("p_brand").alias("page")))


_LINKED = "l as (select s_nationkey as page, s_suppkey as pos, s_name as name, [(s_nationkey * 7 + s_suppkey) % 25, s_suppkey % 25] as targets from supplier)"


@query("reciprocal_links", f"""with {_LINKED}, o as (select page, name as room, pos as o, targets[1] as target from l where targets[1] <> page), b as (select distinct page as target, name as entry, pos as b, unnest(targets) as page from l),
m as (select *, row_number() over (partition by page, room, o, target order by len(list_intersect({_words("room")}, {_words("entry")})) > 0 desc, b) as n from o join b using (page, target)) select distinct page, room, target, entry from m where n = 1""")
def _(s, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    links = t(s, d, "supplier").select(n.alias("page"), k.alias("pos"), F.col("s_name").alias("name"), F.array((n * 7 + k) % 25, k % 25).alias("targets"))
    return rooms.reciprocal_links(links)


_SEAM = "g as (select p_brand as page, min(p_name) || ' und ' || max(p_name) as gateway from part group by p_brand)"


@query("gateway_seams", f"""with {_SEAM}, m as (select page, gateway, p_name as room, p_partkey as pos, cast(len(list_filter({_words("p_name")}, lambda t: len(list_filter({_words("gateway")}, lambda w: contains(w, t) or contains(t, w))) > 0)) as int) as shared from g join part on p_brand = page)
select page, gateway, room, shared from (select *, row_number() over (partition by page, gateway order by shared desc, pos) as n from m where shared >= 2) where n = 1""")
def _(s, d):
    gates = t(s, d, "part").groupBy(F.col("p_brand").alias("page")).agg(F.concat(F.min("p_name"), F.lit(" und "), F.max("p_name")).alias("gateway"))
    return rooms.seams(gates, _parts(s, d))


@query("entry_rooms", f"""with {_SEAM}, m as (select gateway, page as target, p_name, len(list_intersect({_words("gateway")}, {_words("p_name")})) as shared, p_partkey as pos from g join part on p_brand = page)
select gateway, target, case when shared > 0 then p_name else gateway end as room from (select *, row_number() over (partition by gateway, target order by shared desc, pos) as n from m) where n = 1""")
def _(s, d):
    gates = t(s, d, "part").groupBy(F.col("p_brand").alias("target")).agg(F.concat(F.min("p_name"), F.lit(" und "), F.max("p_name")).alias("gateway"))
    return rooms.entry_rooms(gates, _parts(s, d))


@query("anchor_uses", "select p_brand as map, p_type as anchor, count(*) as uses, count(*) <= 3 as gateway from part group by all")
def _(s, d):
    return rooms.anchor_uses(t(s, d, "part").select(F.col("p_brand").alias("map"), F.array("p_type").alias("anchors")))


@query("anchored_maps", "select n_regionkey as page, n_name as anchor, cast(n_nationkey as int) as map from nation")
def _(s, d):
    # Each tier in turn: the same name, the same in other letters, a longer name.
    key, name = F.col("n_nationkey") % 3, F.col("n_name")
    maps = t(s, d, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").cast("int").alias("map"), F.when(key == 0, name).when(key == 1, F.lower(name)).otherwise(F.concat(name, F.lit(" (alt)"))).alias("name"))
    return rooms.anchored_maps(t(s, d, "nation").select(F.col("n_regionkey").alias("page"), name.alias("anchor")), maps)


@query("name_bridges", """with r as (select 0 as page, p_brand as map, p_partkey as room, case when p_partkey % 4 = 0 then 'K' else cast(p_partkey as varchar) end as label, p_name || ' ' || (p_partkey % 97) as name from part), m as (select l.room, n.room as target, n.map from r l join r n on l.label = 'K' and n.label <> 'K' and l.name = n.name and l.map <> n.map),
o as (select room from m group by room having count(distinct map) = 1) select room, target from m join o using (room)""")
def _(s, d):
    label = F.when(F.col("p_partkey") % 4 == 0, "K").otherwise(F.col("p_partkey").cast("string"))
    name = F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 97).cast("string"))
    return rooms.name_bridges(t(s, d, "part").select(F.lit(0).alias("page"), F.col("p_brand").alias("map"), F.col("p_partkey").alias("room"), label.alias("label"), name.alias("name")))


_LEGEND = "g as (select s_nationkey as map, s_suppkey as pos, cast(s_suppkey % 7 as varchar) as label, cast(s_suppkey % 3 as varchar) as color, s_name as text from supplier)"


def _legend(s, d):
    return t(s, d, "supplier").select(F.col("s_nationkey").alias("map"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % 7).cast("string").alias("label"), (F.col("s_suppkey") % 3).cast("string").alias("color"), F.col("s_name").alias("text"))


@query("legend_entries", f"""with {_LEGEND}, c as (select c_nationkey as map, c_custkey as "row", c_custkey % 5 as col, cast(c_custkey % 7 as varchar) as label, case when c_custkey % 2 = 0 then cast(c_custkey % 3 as varchar) end as color from customer)
select map, "row", col, label, text from (select c.*, g.text, row_number() over (partition by c.map, c."row", c.col order by coalesce(c.color = g.color, false) desc, g.pos) as n from c left join g on c.map = g.map and c.label = g.label) where n = 1""")
def _(s, d):
    k = F.col("c_custkey")
    cells = t(s, d, "customer").select(F.col("c_nationkey").alias("map"), k.alias("row"), (k % 5).alias("col"), (k % 7).cast("string").alias("label"), F.when(k % 2 == 0, (k % 3).cast("string")).alias("color"))
    return rooms.legend_entries(cells, _legend(s, d))


@query("ambiguous_labels", f"with {_LEGEND} select map, label, count(distinct color) as colors from g group by all having count(distinct color) > 1")
def _(s, d):
    return rooms.ambiguous_labels(_legend(s, d))


@query("gate_words", "select distinct p_brand as map, w as word from (select p_brand, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-zäöüß]+')) as w from part where p_partkey % 2 = 0 and not regexp_matches(lower(p_name || p_type), 'fluss|wasser|meer|bach|seine|ozean|teich|sumpf|hafen')) where length(w) >= 5")
def _(s, d):
    legend = t(s, d, "part").select(F.col("p_brand").alias("map"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" (Norden)")).alias("text"), F.lit(None).cast("string").alias("color"), F.array(F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("y")).alias("pages"))
    return rooms.gate_words(legend, F.lit("x"))


_LABELS = "b as (select 'orte/' || n_nationkey as target, 'S' as label from nation union all select 'orte/' || n_nationkey, 'T' from nation where n_nationkey % 2 = 0)"


def _borders(s, d):
    """Labels of two gates and a wood for every nation; each second gate is on water."""
    k = F.col("n_nationkey")
    entry = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    rows = F.array(entry("S", F.lit("Steg")), entry("T", F.when(k % 2 == 0, "Stadttor").otherwise("Tor am Fluss")), entry("Wald-3", F.lit("Wald")))
    legend = t(s, d, "nation").select(F.concat(F.lit("orte/"), k.cast("string")).alias("map"), F.inline(rows)).withColumn("color", F.lit(None).cast("string")).withColumn("pages", F.array(F.lit("gallien")))
    return rooms.border_labels(legend, F.lit("gallien")).select(F.col("map").alias("target"), "label")


@query("border_labels", f"with {_LABELS} select * from b")
def _(s, d):
    return _borders(s, d)


_GLYPHS = "T|-/\\X S"


@query("gate_directions", f"""with {_LABELS}, l as (select s_nationkey as map, 'orte/' || s_nationkey as target, avg(s_suppkey % 17) as y, avg(s_suppkey % 23) as x from supplier group by s_nationkey),
g as (select n_nationkey as map, cast(r.range as int) as "row", cast(c.range as int) as col, substr('{_GLYPHS}', cast((n_nationkey * 31 + r.range * 7 + c.range * 13 + (r.range * c.range) % 5) % 8 as int) + 1, 1) as glyph from nation, range(30) r, range(30) c),
k as (select g.map, l.target, g."row", g.col, g."row" - y as dy, g.col - x as dx from l join b using (target) join g on g.map = l.map and g.glyph = b.label),
s as (select unnest([{", ".join(f"struct_pack(nth := {i}, name := '{name}', y := {y}, x := {x}, strokes := '{strokes}')" for i, (name, y, x, strokes) in enumerate(rooms.STROKES))}], recursive := true))
select k.map, k.target, k."row", k.col, case when abs(dx) >= abs(dy) then case when dx < 0 then 'W' else 'E' end else case when dy < 0 then 'N' else 'S' end end as side, coalesce(string_agg(name, ',' order by nth) filter (not coalesce(contains(strokes, g.glyph), false)), '') as blocked
from k cross join s left join g on g.map = k.map and g."row" = k."row" + s.y and g.col = k.col + s.x where sqrt(dy * dy + dx * dx) <= 12 group by all""")
def _(s, d):
    y, x, k = F.col("row"), F.col("col"), F.col("n_nationkey")
    axis = F.sequence(F.lit(0), F.lit(29))
    board = t(s, d, "nation").select(k, F.explode(axis).alias("row")).select(k, "row", F.explode(axis).alias("col"))
    cells = board.select(k.alias("map"), "row", "col", F.substring(F.lit(_GLYPHS), (k * 31 + y * 7 + x * 13 + (y * x) % 5) % 8 + 1, F.lit(1)).alias("glyph"))
    n = F.col("s_nationkey")
    links = t(s, d, "supplier").select(n.alias("map"), F.concat(F.lit("orte/"), n.cast("string")).alias("target"), (F.col("s_suppkey") % 17).alias("row"), (F.col("s_suppkey") % 23).alias("col"))
    return rooms.gate_directions(cells, links, _borders(s, d)).withColumn("blocked", F.array_join("blocked", ","))


@query("page_provenance", "select s_nationkey as region, case when s_suppkey % 2 = 0 then 'wiki' else 'maps' end as origin, array_to_string(list_sort(list(distinct s_name)), ',') as pages from supplier group by all")
def _(s, d):
    sources = t(s, d, "supplier").select(F.col("s_nationkey").alias("region"), F.when(F.col("s_suppkey") % 2 == 0, "wiki").otherwise("maps").alias("origin"), F.col("s_name").alias("page"))
    return rooms.provenance(sources).withColumn("pages", F.array_join("pages", ","))


@query("landmark_pairs", """with g as (select 'supplier' || lpad(cast(s_suppkey % 40 as varchar), 2, '0') as key, arg_max(s_suppkey % 11, s_suppkey) as to_col, arg_max(s_suppkey % 13, s_suppkey) as to_row from supplier group by 1),
c as (select 'supplier' || lpad(cast(c_custkey % 60 as varchar), 2, '0') as key, arg_min(c_custkey % 17, c_custkey) as from_col, arg_min(c_custkey % 19, c_custkey) as from_row from customer group by 1) select key, from_col, from_row, to_col, to_row from c join g using (key)""")
def _(s, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    gates = t(s, d, "supplier").select(k.alias("pos"), F.concat(F.lit("karte/Supplier-"), F.lpad((k % 40).cast("string"), 2, "0")).alias("target"), (k % 11).alias("col"), (k % 13).alias("row"))
    cells = t(s, d, "customer").select(c.alias("pos"), F.concat(F.lit("supplier "), F.lpad((c % 60).cast("string"), 2, "0")).alias("page"), (c % 17).alias("col"), (c % 19).alias("row"))
    return rooms.landmark_pairs(gates, cells)


def _placed(s, d):
    return t(s, d, "supplier").select(F.col("s_nationkey").alias("map"), (F.col("s_suppkey") % 17).alias("row"), (F.col("s_suppkey") % 23).alias("col")).distinct()


_PLACED = """c as (select distinct s_nationkey as map, s_suppkey % 17 as "row", s_suppkey % 23 as col from supplier), b as (select *, "row" - min("row") over w as n, max("row") over w - "row" as s, col - min(col) over w as w_, max(col) over w - col as e from c window w as (partition by map)),
p as (select map, "row", col, case least(n, s, w_, e) when n then 'N' when s then 'S' when w_ then 'W' else 'E' end as side, n, s, w_, e from b)"""


@query("paired_entrances", f"""with {_PLACED}, o as (select *, cast(row_number() over (partition by map, side order by case when side in ('N', 'S') then col else "row" end, "row", col) - 1 as int) as ordinal from p)
select map, side, ordinal, "row" || ',' || col as a, side || ordinal as b from o where ordinal <= 1""")
def _(s, d):
    first = positions.side_ordinals(_placed(s, d)).select("map", "side", "ordinal", F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string")).alias("name"))
    second = first.where("ordinal <= 1").select("map", "side", "ordinal", F.concat("side", F.col("ordinal").cast("string")).alias("name"))
    return rooms.paired_by_place(first, second)


_ALONG = """a as (select map, "row", col, side, case when side in ('W', 'E') then case when n + s > 0 then n / (n + s) else 0.5 end else case when w_ + e > 0 then w_ / (w_ + e) else 0.5 end end as frac from p)"""


@query("edge_positions", f"""with {_PLACED}, {_ALONG} select map, "row", col, side, round(frac, 6) as frac from a""")
def _(s, d):
    return rooms.along_edge(positions.side_ordinals(_placed(s, d)).drop("ordinal")).select("map", "row", "col", "side", F.round("frac", 6).alias("frac"))


@query("nearest_rooms", f"""with {_PLACED}, {_ALONG}, x as (select map, side, "row" * 100 + col as k, frac from a), m as (select x.map, x.side, x.k as crossing, y.k as room, row_number() over (partition by x.map, x.side, x.k order by abs(y.frac - x.frac) - case when y.k % 2 = 0 then 0.12 else 0.0 end, y.k) as n from x join x y on x.map = y.map and x.side = y.side and x.k <> y.k)
select map, side, crossing, room from m where n = 1""")
def _(s, d):
    along = rooms.along_edge(positions.side_ordinals(_placed(s, d))).select("map", "side", (F.col("row") * 100 + F.col("col")).alias("k"), "frac")
    # Every entrance looks for another one: it is told apart by its side's name, which holds its own key.
    crossing = along.select("map", "side", F.col("k").alias("crossing"), "frac")
    room = along.select("map", "side", F.col("k").alias("pos"), F.col("k").alias("room"), "frac", (F.col("k") % 2 == 0).alias("hit"))
    pairs = crossing.join(room.withColumnRenamed("frac", "room_frac"), ["map", "side"]).where("crossing <> room")
    own = F.concat("side", F.lit("/"), F.col("crossing").cast("string"))
    return rooms.nearest_room(pairs.select("map", own.alias("side"), "crossing", "frac").distinct(), pairs.select("map", own.alias("side"), "pos", "room", F.col("room_frac").alias("frac"), "hit")).withColumn("side", F.substring_index("side", "/", 1))


@query("map_centroids", """select s_nationkey as map, count(*) as n, round(avg(s_suppkey % 17), 6) as "row", round(avg(s_suppkey % 23), 6) as col, min(s_suppkey % 17) as top, max(s_suppkey % 17) as bottom, min(s_suppkey % 23) as "left", max(s_suppkey % 23) as "right" from supplier group by 1""")
def _(s, d):
    points = t(s, d, "supplier").select(F.col("s_nationkey").alias("map"), (F.col("s_suppkey") % 17).alias("row"), (F.col("s_suppkey") % 23).alias("col"))
    return rooms.centroids(points, "map").withColumn("row", F.round("row", 6)).withColumn("col", F.round("col", 6))


@query("run_middles", f"""with {_PLACED}, x as (select map, side, "row", col, case when side in ('W', 'E') then "row" else col end as axis from p), y as (select *, case when axis - lag(axis) over w > 1 then 1 else 0 end as b from x window w as (partition by map, side order by axis, "row", col)),
z as (select *, sum(b) over (partition by map, side order by axis, "row", col rows unbounded preceding) as run from y), k as (select *, row_number() over (partition by map, side, run order by axis, "row", col) as i, count(*) over (partition by map, side, run) as n from z) select map, side, "row", col from k where i = n // 2 + 1""")
def _(s, d):
    return rooms.run_middles(positions.side_ordinals(_placed(s, d)).drop("ordinal"))


_STEPS = "x as (select user_id as route, event_id as pos, case when event_id % 3 <> 0 then event_type end as dir, case when event_id % 3 = 0 then 'n' || event_id end as note from events)"


@query("folded_seams", f"""with {_STEPS}, g as (select *, coalesce(sum(case when dir is null then 0 else 1 end) over (partition by route order by pos rows between unbounded preceding and 1 preceding), 0) as grp from x),
w as (select route, grp, string_agg(note, '; ' order by pos) as waiting from g where dir is null group by all), k as (select route, max(grp) as top from g where dir is not null group by route),
m as (select g.route, g.pos, g.dir, w.waiting as note, g.grp from g left join w using (route, grp) where g.dir is not null), e as (select w.route, w.waiting as rest, k.top from w join k using (route) where w.grp > k.top)
select m.route, m.pos, m.dir, case when m.grp = e.top and m.note is null then e.rest else m.note end as note from m left join e using (route)
union all select e.route, (select max(pos) from x where x.route = e.route), null, e.rest from e where exists (select 1 from m where m.route = e.route and m.grp = e.top and m.note is not null)""")
def _(s, d):
    events = t(s, d, "events")
    seam = F.col("event_id") % 3 == 0
    steps = events.select(F.col("user_id").alias("route"), F.col("event_id").alias("pos"), F.when(~seam, F.col("event_type")).alias("dir"), F.when(seam, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("note"))
    return rooms.folded_seams(steps)


@query("cheapest_seam", "select o_custkey as query_id, arg_min(o_orderkey, (o_orderkey % 30 + 4 * (o_orderkey % 5)) * 10000000 + o_orderkey) as seam, min(o_orderkey % 30 + 4 * (o_orderkey % 5)) as cost from orders group by o_custkey")
def _(s, d):
    return rooms.cheapest(t(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("seam"), (F.col("o_orderkey") % 30).alias("steps"), (F.col("o_orderkey") % 5).alias("wet")))


_PAGEGRAPH = """n as (select c_mktsegment as page, c_custkey as node, case when c_custkey % 10 = 0 then 'Ufer' else 'Raum' end as name from customer), f as (select a.page, a.node as x, b.node as y, a.node % 4 = 0 as hidden from n a join n b on a.page = b.page and b.node = a.node - a.node % 7 and b.node <> a.node),
e as (select page, x as src, y as dst, hidden from f union all select page, y, x, hidden from f), d as (select page, src as node, count(*) as d from e group by all), v as (select n.*, coalesce(d, 0) as d from n left join d using (page, node)),
c as (select page, count(distinct case when b.node is null then a.node else b.node end) as components from (select page, node, node - node % 7 as hub from n) a left join (select page as p, node from n) b on b.p = a.page and b.node = a.hub group by page),
g as (select v.page, count(*) as nodes, count(*) filter (d = 0) as isolated, max(d) as max_degree, sum(case when d > 2 and name = 'Ufer' then d else 0 end) as water_degree from v group by v.page),
p as (select page, count(*) as edges, count(*) filter (hidden) as hidden from f group by page),
q as (select g.page, nodes, coalesce(edges, 0) as edges, coalesce(hidden, 0) as hidden, isolated, max_degree, cast(water_degree as bigint) as water_degree, components, cast(water_degree * 4 + coalesce(hidden, 0) * 2 + isolated * 3 + greatest(components - 1, 0) * 2 + greatest(max_degree - 4, 0) as bigint) as suspicion from g left join p using (page) join c using (page))"""


def _page_graph(s, d):
    k = F.col("c_custkey")
    nodes = t(s, d, "customer").select(F.col("c_mktsegment").alias("page"), k.alias("node"), F.when(k % 10 == 0, "Ufer").otherwise("Raum").alias("name"))
    hub = nodes.select("page", F.col("node").alias("hub"))
    pairs = nodes.withColumn("hub", F.col("node") - F.col("node") % 7).where("hub <> node").join(hub, ["page", "hub"]).select("page", "node", "hub", (F.col("node") % 4 == 0).alias("hidden"))
    edges = pairs.select("page", F.col("node").alias("src"), F.col("hub").alias("dst"), "hidden").unionByName(pairs.select("page", F.col("hub").alias("src"), F.col("node").alias("dst"), "hidden"))
    parts = graph.components(nodes.select("node"), edges.select("src", "dst")).join(nodes.select("page", "node"), "node")
    return rooms.diagnostics(nodes, edges, parts)


@query("map_diagnostics", f"with {_PAGEGRAPH} select * from q order by suspicion desc, page limit 3")
def _(s, d):
    return rooms.most_suspect(_page_graph(s, d), 3)


@query("audit_totals", f"with {_PAGEGRAPH} select count(*) as pages, cast(sum(nodes) as bigint) as nodes, cast(sum(edges) as bigint) as edges, cast(sum(hidden) as bigint) as hidden, cast(sum(isolated) as bigint) as isolated, cast(sum(components) as bigint) as components, count(*) filter (water_degree > 0) as with_water from q")
def _(s, d):
    return rooms.totals(_page_graph(s, d))


def _rects(s, d):
    """A region for each nation, with a box for every supplier."""
    k = F.col("s_suppkey")
    x, y = (k * 37) % 200, (k * 53) % 150
    return t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("region"), k.alias("pos"), x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 6 + k % 40).cast("int").alias("x2"), (y + 6 + k % 30).cast("int").alias("y2"), F.when(k % 3 != 0, F.concat(F.lit("orte/"), "s_name")).alias("target"), F.lit(None).cast("string").alias("anchor"), F.col("s_name").alias("label"))


def _sizes(s, d):
    pictures = _rects(s, d).select("region").distinct().select("region", F.lit(240).alias("width"), F.lit(180).alias("height"))
    return tiles.extents(pictures, tiles.origin(_rects(s, d)))


_RECTS = """k as (select cast(s_nationkey as varchar) as region, s_suppkey as pos, (s_suppkey * 37) % 200 as x1, (s_suppkey * 53) % 150 as y1, s_suppkey, s_name from supplier),
x as (select region, pos, x1, y1, x1 + 6 + s_suppkey % 40 as x2, y1 + 6 + s_suppkey % 30 as y2, case when s_suppkey % 3 <> 0 then 'orte/' || s_name end as target, s_name as label from k),
vote as (select region, v, count(*) as n, min(pos * 2 + axis) as first from (select region, pos, x1 % 12 as v, 0 as axis from x where x2 - x1 <= 12 and y2 - y1 <= 12 union all select region, pos, y1 % 12, 1 from x where x2 - x1 <= 12 and y2 - y1 <= 12) group by all),
o as (select region, coalesce((select case when v <= 1 then v else 0 end from vote where vote.region = x.region order by n desc, first limit 1), 0) as origin from x group by region),
z as (select region, 'karte/' || region as page, cast(origin as int) as origin, cast((240 - origin) // 12 as int) as cols, cast((180 - origin) // 12 as int) as rows_ from o)"""


@query("tile_extents", f"with {_RECTS} select region, page, origin, cols, rows_ as rows from z")
def _(s, d):
    return _sizes(s, d)


@query("tile_gateways", f"""with {_RECTS} select region, pos, cast(least(rows_ - 1, greatest(0, floor(((y1 + y2) / 2.0 - origin) / 12))) as int) as "row", cast(least(cols - 1, greatest(0, floor(((x1 + x2) / 2.0 - origin) / 12))) as int) as col, target, label from x join z using (region) where x2 - x1 <= 36 and y2 - y1 <= 36""")
def _(s, d):
    return tiles.gateways(_rects(s, d), _sizes(s, d)).drop("anchor")


_EDGE = "cast(least({1} - 1, greatest(0, floor(({0} - origin) / 12.0))) as int)"


@query("tile_areas", f"""with {_RECTS} select region, target, {_EDGE.format("y1", "rows_")} as top, {_EDGE.format("x1", "cols")} as "left", {_EDGE.format("y2", "rows_")} as bottom, {_EDGE.format("x2", "cols")} as "right" from x join z using (region) where target is not null and not (x2 - x1 <= 12 and y2 - y1 <= 12)""")
def _(s, d):
    return tiles.areas(_rects(s, d), _sizes(s, d))


_PIXEL = ["(nation * 31 + (x // 12) * 17 + (y // 12) * 7) % 4", "case when x % 12 in (5, 6) and (x // 12 + y // 12) % 3 = 0 then 4 else {} end"]


def _pixels(s, d):
    k = t(s, d, "nation").select(F.col("n_nationkey").alias("nation")).join(s.range(48).select(F.col("id").cast("int").alias("x"))).join(s.range(36).select(F.col("id").cast("int").alias("y")))
    base = (F.col("nation") * 31 + F.floor(F.col("x") / 12) * 17 + F.floor(F.col("y") / 12) * 7) % 4
    kind = F.when((F.col("x") % 12).isin(5, 6) & ((F.floor(F.col("x") / 12) + F.floor(F.col("y") / 12)) % 3 == 0), 4).otherwise(base)
    colour = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in ([90, 200, 60], [20, 30, 200], [10, 10, 10], [200, 200, 200], [140, 80, 30]))), (kind + 1).cast("int"))
    return k.select(F.col("nation").cast("string").alias("region"), "x", "y", colour[0].alias("r"), colour[1].alias("g"), colour[2].alias("b"))


@query("tile_classes", f"""with p as (select n_nationkey as nation, x.range as x, y.range as y from nation, range(48) x, range(36) y), q as (select *, {_PIXEL[1].format(_PIXEL[0])} as kind from p),
t as (select nation, y // 12 as "row", x // 12 as col, count(*) filter (kind = 2) / 144.0 as sea, count(*) filter (kind in (2, 4)) / 144.0 as stroke, count(*) filter (kind = 4) as brown, any_value(kind) filter (kind <> 4) as base, count(*) filter (kind = 2) as black from q group by all)
select cast(nation as varchar) as region, cast("row" as int) as "row", cast(col as int) as col, case when sea > 0.85 then 'ocean' when stroke > 0.08 and stroke < 0.75 then 'road' when base = 0 then 'grass' when base = 1 then 'water' when base = 3 then 'rock' else 'road' end as terrain,
case when sea > 0.85 then 'ocean' when base = 0 then 'grass' when base = 1 then 'water' when base = 3 then 'rock' else 'road' end as base, case when sea <= 0.85 and stroke > 0.08 and stroke < 0.75 then 'N,S' else '' end as road_dirs from t""")
def _(s, d):
    shapes = t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("region"), F.lit(0).alias("origin"))
    return tiles.classes(_pixels(s, d), shapes).withColumn("road_dirs", F.array_join("road_dirs", ","))


@query("tile_names", f"""with {_RECTS}, g as (select region, pos, cast(least(rows_ - 1, greatest(0, floor(((y1 + y2) / 2.0 - origin) / 12))) as int) as "row", cast(least(cols - 1, greatest(0, floor(((x1 + x2) / 2.0 - origin) / 12))) as int) as col, label from x join z using (region) where x2 - x1 <= 36 and y2 - y1 <= 36)
select pos as query_id, 1 as rank, "row", col, label as name from g union all select -1 - n_nationkey, 1, 3, 2, '2,3' from nation""")
def _(s, d):
    gates = tiles.gateways(_rects(s, d), _sizes(s, d))
    asked = gates.select(F.col("pos").alias("query_id"), "region", F.replace("label", F.lit("#"), F.lit(" ")).alias("text"))
    direct = t(s, d, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("query_id"), F.col("n_nationkey").cast("string").alias("region"), F.lit(" 2 , 3").alias("text"))
    plain = _pixels(s, d).where("false")
    flat = tiles.grid(plain, _rects(s, d))
    return tiles.resolve_tiles(asked.unionByName(direct), gates, flat, _sizes(s, d))
