"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, incremental, parse, symbols, verbs
from loomgraph.plans import projection as P
from loomgraph.plans.projection import GRAPH_SQL
from loomgraph.streaming import watch
from loomgraph.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Edges and lookups


@query(f"WITH {GRAPH_SQL} SELECT source_path, target_path, target_key, line, builtin FROM edges")
def edges_guid_left_join(s, d):
    return P.edges(s, d).drop("kind")


@query(f"WITH {GRAPH_SQL} SELECT source_path, target_key, line FROM edges WHERE target_path IS NULL AND NOT builtin")
def unresolved_refs(s, d):
    return graph.unresolved(P.edges(s, d)).select("source_path", "target_key", "line")


@query(f"WITH {GRAPH_SQL} SELECT src, dst FROM walk")
def walk_edges_distinct(s, d):
    return P.walk(s, d)


HREF = 'href="([^"]+)"'
_SITE = "regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)"
_FOLD = "array_to_string(list_reduce(list_transform(list_filter(string_split({0}, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x]), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END, []::VARCHAR[]), '/')"
_RAW = "regexp_replace(raw, '[?#].*$', '')"
PATHS_SQL = f"""pagefiles AS (SELECT page_id, {_SITE} AS path FROM pages),
hrefs AS (SELECT path AS source_path, unnest(regexp_extract_all(html, '{HREF}', 1)) AS raw FROM pages JOIN pagefiles USING (page_id)),
norms AS (SELECT source_path, raw, {_FOLD.format(f"CASE WHEN regexp_matches({_RAW}, '^(/|Assets/|Packages/)') THEN {_RAW} ELSE regexp_extract(source_path, '^(.*)/[^/]*$', 1) || '/' || {_RAW} END")} AS norm FROM hrefs)"""


def _page_files(s, d) -> DataFrame:
    return table(s, d, "pages").select(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1).alias("path"), "html")


def _page_refs(s, d) -> DataFrame:
    raw = _page_files(s, d).select(F.col("path").alias("source_path"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("raw"))
    return raw.select("source_path", "raw", T.normal_path(F.col("raw"), T.source_dir(F.col("source_path"))).alias("norm"), F.lit(1).alias("line"))


@query(f"WITH {PATHS_SQL} SELECT source_path, raw, norm, f.path AS target_path FROM norms LEFT JOIN (SELECT DISTINCT path FROM pagefiles) f ON lower(f.path) = lower(norm)")
def edges_path_resolution(s, d):
    refs = _page_refs(s, d)
    return refs.join(_page_files(s, d).select(F.col("path").alias("target_path")).distinct(), F.lower("norm") == F.lower("target_path"), "left").select("source_path", "raw", "norm", "target_path")


@query(f"""WITH {GRAPH_SQL}, {PATHS_SQL}, a AS (SELECT source_path, target_path, target_key, kind FROM edges UNION ALL
SELECT source_path, f.path, norm, 'path' FROM norms LEFT JOIN (SELECT DISTINCT path FROM pagefiles) f ON lower(f.path) = lower(norm))
SELECT kind, count(*) AS n, count(target_path) AS resolved, count(DISTINCT target_key) AS targets FROM a GROUP BY kind""")
def all_refs_union(s, d):
    both = P.edges(s, d).unionByName(graph.resolve_paths(_page_refs(s, d), _page_files(s, d).select("path").distinct()))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("target_path").alias("resolved"), F.countDistinct("target_key").alias("targets"))


@query(f"WITH {GRAPH_SQL} SELECT source_path, line FROM edges WHERE target_path = 'Part/17'")
def who_uses_direct(s, d):
    return verbs.who_uses(P.files(s, d), P.refs(s, d), ["Part/17"]).select("source_path", "line").orderBy("source_path", "line")


@query(f"WITH {GRAPH_SQL} SELECT target_path, target_key, line, builtin FROM edges WHERE source_path = 'Order/10934'")
def uses_direct(s, d):
    return verbs.uses(P.files(s, d), P.refs(s, d), ["Order/10934"]).select("target_path", "target_key", "line", "builtin").orderBy("line")


@query(f"WITH {GRAPH_SQL} SELECT source_path, line FROM refs WHERE target_guid = md5('Part/50')")
def who_uses_guid_literal(s, d):
    return P.refs(s, d).where(F.col("target_guid") == F.md5(F.lit("Part/50").cast("binary"))).select("source_path", "line")


@query(f"WITH {GRAPH_SQL} SELECT target_path, count(*) AS n, min(source_path) AS first_source FROM edges WHERE target_path IN (SELECT 'Part/' || range FROM range(1, 101)) GROUP BY target_path")
def who_uses_batch(s, d):
    found = verbs.who_uses(P.files(s, d), P.refs(s, d), [f"Part/{k}" for k in range(1, 101)]).where("target_path IS NOT NULL")
    return found.groupBy("target_path").agg(F.count("*").alias("n"), F.min("source_path").alias("first_source"))


@query(f"WITH {GRAPH_SQL} SELECT target_key, count(*) AS n, count(DISTINCT source_path) AS sources FROM edges WHERE source_path = 'Order/10934' AND target_path IS NULL AND NOT builtin GROUP BY target_key")
def uses_missing_only(s, d):
    return verbs.uses(P.files(s, d), P.refs(s, d), ["Order/10934"], missing_only=True).groupBy("target_key").agg(F.count("*").alias("n"), F.countDistinct("source_path").alias("sources"))


@query(f"WITH {GRAPH_SQL} SELECT source_path, line FROM edges WHERE target_path = 'Nation/3' AND (lower(source_path) = 'customer' OR starts_with(lower(source_path), 'customer/'))")
def under_filter(s, d):
    return P.edges(s, d).where((F.col("target_path") == "Nation/3") & T.under(F.col("source_path"), "customer\\")).select("source_path", "line")


@query(f"""WITH {GRAPH_SQL} SELECT path, kind FROM files WHERE contains(lower(path), 'art/11') ORDER BY path LIMIT 20""")
def fuzzy_resolve_top20(s, d):
    return P.files(s, d).where(F.contains(F.lower("path"), F.lit("art/11"))).select("path", "kind").orderBy("path").limit(20)


@query(f"WITH {GRAPH_SQL} SELECT path, guid, kind FROM files WHERE guid = md5('Customer/3')")
def resolve_exact_guid(s, d):
    return P.files(s, d).where(F.col("guid") == F.md5(F.lit("Customer/3").cast("binary"))).orderBy("path")


_TARGETS_SQL = f"""{GRAPH_SQL}, asked AS (SELECT DISTINCT raw, regexp_replace(replace(raw, chr(92), '/'), '^/p/', '') AS q FROM (SELECT unnest(['Part/17', 'order' || chr(92) || '10934', '/p/Customer/3', 'art/111', 'Part/50', 'nowhere', '0123456789abcdef0123456789ABCDEF']) AS raw)),
exact AS (SELECT raw, path, guid FROM asked JOIN files ON lower(path) = lower(q)),
byguid AS (SELECT raw, min(path) AS path, lower(q) AS guid FROM asked LEFT JOIN files ON guid = lower(q) WHERE raw NOT IN (SELECT raw FROM exact) AND regexp_full_match(lower(q), '[0-9a-f]{{32}}') GROUP BY raw, q),
fuzzy AS (SELECT raw, count(*) AS n, min(path) AS path, min(guid) AS guid FROM asked JOIN files ON contains(lower(path), lower(q)) WHERE raw NOT IN (SELECT raw FROM exact) AND raw NOT IN (SELECT raw FROM byguid) GROUP BY raw)"""


@query(f"""WITH {_TARGETS_SQL} SELECT raw AS input, coalesce(e.path, g.path, CASE WHEN f.n = 1 THEN f.path END) AS path, coalesce(e.guid, g.guid, CASE WHEN f.n = 1 THEN f.guid END) AS guid,
CASE WHEN e.raw IS NOT NULL THEN 'path' WHEN g.raw IS NOT NULL THEN 'guid' WHEN f.n = 1 THEN 'fuzzy' WHEN f.n > 1 THEN 'ambiguous' ELSE 'missing' END AS how, coalesce(CASE WHEN e.raw IS NULL AND g.raw IS NULL THEN f.n END, 0)::BIGINT AS candidates
FROM asked LEFT JOIN exact e USING (raw) LEFT JOIN byguid g USING (raw) LEFT JOIN fuzzy f USING (raw)""")
def target_resolution(s, d):
    asked = ["Part/17", "order\\10934", "/p/Customer/3", "art/111", "Part/50", "nowhere", "0123456789abcdef0123456789ABCDEF"]
    return verbs.targets(P.files(s, d), asked, root="/p")


# Statistics


@query(f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n, count(*) FILTER (WHERE path LIKE '%/1%') AS ones FROM files GROUP BY kind")
def scan_classify(s, d):
    return P.files(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.contains("path", F.lit("/1"))).alias("ones"))


@query("""SELECT md5(lower(text)) AS guid, count(*) AS n, list_sort(list(doc_id)) AS ids, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def guid_collisions(s, d):
    return table(s, d, "documents").groupBy(F.md5(F.lower("text").cast("binary")).alias("guid")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH {GRAPH_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE target_path IS NULL AND NOT builtin) AS missing, count(*) FILTER (WHERE builtin) AS builtins FROM edges")
def edge_stats(s, d):
    return P.edges(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("target_path").isNull() & ~F.col("builtin")).alias("missing"), F.count_if("builtin").alias("builtins"))


@query(f"""WITH {GRAPH_SQL} SELECT lower(target_key) AS target_key, count(*) AS n, list_sort(list(DISTINCT source_path)) AS sources
FROM edges WHERE target_path IS NULL AND NOT builtin GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def unresolved_grouped_topn(s, d):
    return graph.unresolved(P.edges(s, d)).groupBy(F.lower("target_key").alias("target_key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source_path")).alias("sources")).orderBy(F.desc("n"), "target_key").limit(10)


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT source_path, target_key, line FROM edges WHERE target_path IS NULL AND NOT builtin),
o AS (SELECT source_path, line, min(target_path) AS owner FROM edges WHERE target_path LIKE 'Supplier/%' GROUP BY ALL)
SELECT m.*, owner, CASE WHEN owner IS NULL THEN 'unknown' ELSE 'supplier' END AS class FROM m LEFT JOIN o USING (source_path, line)""")
def unresolved_owner_classify(s, d):
    e = P.edges(s, d)
    owner = e.where("target_path LIKE 'Supplier/%'").groupBy("source_path", "line").agg(F.min("target_path").alias("owner"))
    return graph.unresolved(e).select("source_path", "target_key", "line").join(owner, ["source_path", "line"], "left").withColumn("class", F.when(F.col("owner").isNull(), "unknown").otherwise("supplier"))


# Closures


@query(f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT 'Region/0' AS node, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN walk ON dst = node WHERE depth < 12)
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node HAVING min(depth) > 0""")
def closure_reverse(s, d):
    return graph.closure(P.walk(s, d), s.createDataFrame([("Region/0",)], "node string"), reverse=True, flag=False)[0]


@query(f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT 'Order/10934' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN walk ON src = node WHERE depth < 12)
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node HAVING min(depth) > 0""")
def closure_forward(s, d):
    return graph.closure(P.walk(s, d), s.createDataFrame([("Order/10934",)], "node string"), flag=False)[0]


@query("""WITH RECURSIVE w AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation),
r AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN w ON src = node WHERE depth < 4)
SELECT node::VARCHAR AS node, min(depth)::INTEGER AS depth, (SELECT bool_or(depth = 4) FROM r) AS truncated FROM r GROUP BY node HAVING min(depth) > 0""")
def closure_truncated_cycle(s, d):
    n = F.col("n_nationkey")
    ring = table(s, d, "nation").select(n.cast("string").alias("src"), ((n + 1) % 25).cast("string").alias("dst"))
    found, truncated = graph.closure(ring, s.createDataFrame([("0",)], "node string"), cap=4)
    return found.withColumn("truncated", F.lit(truncated))


_FORWARD = f"""{GRAPH_SQL}, r AS (SELECT 'Order/10934' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN walk ON src = node WHERE depth < 12),
depths AS (SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node)"""


def _forward_depths(s, d):
    seeds = s.createDataFrame([("Order/10934",)], "node string")
    return graph.closure(P.walk(s, d), seeds, flag=False)[0].unionByName(seeds.withColumn("depth", F.lit(0)))


@query(f"""WITH RECURSIVE {_FORWARD}, c AS (SELECT e.*, b.depth, row_number() OVER (PARTITION BY target_path ORDER BY line, source_path) AS rn
FROM edges e JOIN depths a ON a.node = source_path JOIN depths b ON b.node = target_path AND b.depth = a.depth + 1)
SELECT target_path, source_path AS via, line, depth FROM c WHERE rn = 1""")
def transitive_edges_via(s, d):
    z = _forward_depths(s, d)
    a, b = z.select(F.col("node").alias("source_path"), F.col("depth").alias("up")), z.select(F.col("node").alias("target_path"), "depth")
    met = P.edges(s, d).join(a, "source_path").join(b, "target_path").where("depth = up + 1")
    rn = F.row_number().over(W.partitionBy("target_path").orderBy("line", "source_path"))
    return met.withColumn("rn", rn).where("rn = 1").select("target_path", F.col("source_path").alias("via"), "line", "depth")


@query(f"""WITH RECURSIVE {_FORWARD} SELECT source_path, target_key, line, depth + 1 AS depth FROM edges JOIN depths ON node = source_path WHERE target_path IS NULL AND NOT builtin""")
def uses_transitive_unresolved(s, d):
    z = _forward_depths(s, d).select(F.col("node").alias("source_path"), (F.col("depth") + 1).alias("depth"))
    return graph.unresolved(P.edges(s, d)).join(z, "source_path").select("source_path", "target_key", "line", "depth")


_RANKED = "ranked AS (SELECT source_path AS src, target_path AS dst, min(CASE WHEN line % 2 = 0 THEN 1 ELSE 2 END) AS r FROM edges WHERE target_path IS NOT NULL GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_FORWARD}, {_RANKED}, c AS (SELECT 'Order/10934' AS node, 0 AS depth, 2 AS r UNION
SELECT e.dst, c.depth + 1, least(c.r, e.r) FROM c JOIN ranked e ON e.src = c.node JOIN depths z ON z.node = e.dst AND z.depth = c.depth + 1)
SELECT node, depth, CASE min(r) WHEN 2 THEN 'proven' WHEN 1 THEN 'advisory' END AS label FROM c WHERE depth > 0 GROUP BY node, depth""")
def chain_confidence(s, d):
    ranked = P.edges(s, d).where("target_path IS NOT NULL").groupBy(F.col("source_path").alias("src"), F.col("target_path").alias("dst")).agg(F.min(F.when(F.col("line") % 2 == 0, 1).otherwise(2)).alias("r"))
    return graph.chain_confidence(ranked, _forward_depths(s, d))


@query(f"""WITH {GRAPH_SQL}, l AS (SELECT source_path, CASE WHEN builtin THEN 'proven' WHEN target_path IS NULL THEN NULL WHEN line > 5 THEN 'speculative' WHEN line % 2 = 0 THEN 'advisory' ELSE 'proven' END AS label FROM edges)
SELECT source_path, coalesce(CASE min(CASE label WHEN 'proven' THEN 2 WHEN 'advisory' THEN 1 END) WHEN 2 THEN 'proven' WHEN 1 THEN 'advisory' END, max(label) FILTER (WHERE label = 'speculative')) AS confidence FROM l GROUP BY source_path""")
def answer_confidence(s, d):
    own = F.when(F.col("line") > 5, "speculative").when(F.col("line") % 2 == 0, "advisory").otherwise("proven")
    lab = T.label(F.lit("event"), F.col("target_path").isNotNull(), F.col("builtin"), F.lit(True), own)
    return P.edges(s, d).select("source_path", lab.alias("label")).groupBy("source_path").agg(T.weakest(F.col("label")).alias("confidence"))


@query(f"""WITH {GRAPH_SQL} SELECT source_path, coalesce(CASE min(CASE WHEN line % 2 = 0 THEN 1 ELSE 2 END) WHEN 2 THEN 'proven' WHEN 1 THEN 'advisory' END) AS confidence FROM edges WHERE target_path LIKE 'Part/%' GROUP BY source_path""")
def kind_filter(s, d):
    lab = F.when(F.col("line") % 2 == 0, "advisory").otherwise("proven")
    return P.edges(s, d).where("target_path LIKE 'Part/%'").groupBy("source_path").agg(T.weakest(lab).alias("confidence"))


@query("""SELECT o_orderkey, list_filter([CASE WHEN true THEN 'dynamic-loading' END, CASE WHEN true THEN 'reflection' END, CASE WHEN o_orderstatus = 'O' THEN 'syntactic-assemblies-present' END,
CASE WHEN o_totalprice > 200000 THEN 'depth-truncated' END], lambda x: x IS NOT NULL) AS spots FROM orders""")
def blind_spots(s, d):
    spots = F.array(F.lit("dynamic-loading"), F.lit("reflection"), F.when(F.col("o_orderstatus") == "O", "syntactic-assemblies-present"), F.when(F.col("o_totalprice") > 200000, "depth-truncated"))
    return table(s, d, "orders").select("o_orderkey", F.filter(spots, lambda x: x.isNotNull()).alias("spots"))


# Reachability and liveness

_REACH = f"{GRAPH_SQL}, live AS (SELECT 'Order/' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0 UNION SELECT dst FROM live JOIN walk ON src = node)"


def _live(s, d, walk=None):
    seeds = table(s, d, "orders").where("o_orderstatus = 'F' AND o_orderkey % 7 = 0").select(F.concat(F.lit("Order/"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reachable(walk or P.walk(s, d), seeds)


@query(f"WITH RECURSIVE {_REACH} SELECT node FROM live")
def reachable_fixed_point(s, d):
    return _live(s, d)


@query(f"WITH RECURSIVE {_REACH} SELECT path, path IN (SELECT node FROM live) AS build_reachable FROM files")
def build_reachable_tag(s, d):
    return P.files(s, d).join(_live(s, d).select(F.col("node").alias("path"), F.lit(True).alias("hit")), "path", "left").select("path", F.col("hit").isNotNull().alias("build_reachable"))


_SCREENS = f"""{_REACH}, cand AS (SELECT path, kind FROM files WHERE kind NOT IN ('folder', 'settings')),
named AS (SELECT DISTINCT 'Part/' || l_partkey AS path FROM lineitem WHERE l_returnflag = 'R'),
screened AS (SELECT path, CASE WHEN path IN (SELECT path FROM named) THEN 'name-collision' WHEN path LIKE 'Customer/1%' THEN 'allowlist' END AS reason FROM cand WHERE path NOT IN (SELECT node FROM live))"""


def _screen(s, d, walk=None):
    cand = P.files(s, d).where("kind NOT IN ('folder', 'settings')").select("path")
    named = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("Part/"), F.col("l_partkey").cast("string")).alias("path")).distinct().withColumn("hit", F.lit(True))
    return cand.join(_live(s, d, walk).withColumnRenamed("node", "path"), "path", "left_anti").join(named, "path", "left").select("path", F.when(F.col("hit"), "name-collision").when(F.col("path").rlike(T.glob_regex("Customer/1*")), "allowlist").alias("reason"))


@query(f"WITH RECURSIVE {_SCREENS} SELECT path, reason FROM screened WHERE reason IS NOT NULL")
def screens_first_match(s, d):
    return _screen(s, d).where("reason IS NOT NULL")


@query(f"""WITH RECURSIVE {_SCREENS}, alive AS (SELECT node FROM live UNION SELECT path FROM screened WHERE reason IS NOT NULL UNION SELECT dst FROM alive JOIN walk ON src = node)
SELECT path, coalesce(reason, 'proven') AS verdict FROM screened WHERE reason IS NOT NULL OR path NOT IN (SELECT node FROM alive)""")
def dead_candidates(s, d):
    walk = incremental.cut(P.walk(s, d))
    screened = incremental.cut(_screen(s, d, walk))
    held = screened.where("reason IS NOT NULL")
    alive = graph.reachable(walk, held.select(F.col("path").alias("node")))
    proven = screened.where("reason IS NULL").join(alive.withColumnRenamed("node", "path"), "path", "left_anti")
    return held.select("path", F.col("reason").alias("verdict")).unionByName(proven.select("path", F.lit("proven").alias("verdict")))


# Names, ancestors, assemblies


@query("""WITH f AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)) AS name FROM pages),
r AS (SELECT DISTINCT lower(regexp_extract(regexp_replace(raw, '[?#].*$', ''), '([^/]*)$', 1)) AS name FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS raw FROM pages)),
j AS (SELECT r.name, count(*) AS n FROM r JOIN f USING (name) WHERE r.name <> '' GROUP BY r.name)
SELECT name, n, CASE WHEN n = 1 THEN 'proven' ELSE 'advisory' END AS label FROM j""")
def dll_name_join(s, d):
    f = table(s, d, "pages").select(F.lower(T.final_segment(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))).alias("name"))
    return _names(s, d).join(f, "name").groupBy("name").agg(F.count("*").alias("n")).withColumn("label", F.when(F.col("n") == 1, "proven").otherwise("advisory"))


def _names(s, d):
    raw = table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("raw"))
    return raw.select(F.lower(T.final_segment(F.regexp_replace("raw", "[?#].*$", ""))).alias("name")).where("name <> ''").distinct()


@query("""WITH f AS (SELECT lower(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)) AS name FROM pages),
r AS (SELECT DISTINCT lower(regexp_extract(regexp_replace(raw, '[?#].*$', ''), '([^/]*)$', 1)) AS name FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS raw FROM pages))
SELECT name FROM r WHERE name <> '' AND name NOT IN (SELECT name FROM f)""")
def dll_unresolved_anti(s, d):
    f = table(s, d, "pages").select(F.lower(T.final_segment(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))).alias("name"))
    return _names(s, d).join(f, "name", "left_anti")


@query("""WITH defs AS (SELECT * FROM (VALUES ('en', 'unit-en', 1), ('en/7', 'unit-en7', 1), ('', 'unit-root', 2), ('de', 'unit-de', 1), ('de', 'ref-de', 2)) AS t(dir, unit, pref)),
p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, unit, row_number() OVER (PARTITION BY page_id ORDER BY length(dir) DESC, pref) AS rn FROM p JOIN defs ON dir = '' OR path = dir OR starts_with(path, dir || '/'))
SELECT page_id, unit FROM c WHERE rn = 1""")
def nearest_ancestor_join(s, d):
    defs = s.createDataFrame([("en", "unit-en", 1), ("en/7", "unit-en7", 1), ("", "unit-root", 2), ("de", "unit-de", 1), ("de", "ref-de", 2)], "dir string, unit string, pref int")
    p = table(s, d, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1).alias("path"))
    return symbols.nearest_ancestor(p, defs, "page_id")


@query("""SELECT p_partkey, 'Assembly-CSharp' || CASE WHEN p_size % 2 = 0 THEN '-Editor' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '-firstpass' ELSE '' END AS assembly FROM part""")
def predefined_assembly_case(s, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("Assets/"), F.when(k % 3 == 0, "Plugins/").otherwise(""), F.when(F.col("p_size") % 2 == 0, "Editor/").otherwise("Run/"), k.cast("string"), F.lit(".cs"))
    return table(s, d, "part").select("p_partkey", T.assembly_of(path).alias("assembly"))


@query("""WITH RECURSIVE deps AS (SELECT 'Nation/' || n_nationkey AS src, 'Region/' || n_regionkey AS dst FROM nation UNION SELECT 'Region/' || r_regionkey, 'Root' FROM region),
nodes AS (SELECT src AS node FROM deps UNION SELECT dst FROM deps), r AS (SELECT node, 0 AS level FROM nodes UNION SELECT src, level + 1 FROM r JOIN deps ON dst = node)
SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node""")
def topo_levels(s, d):
    key = lambda f, c: F.concat(F.lit(f), F.col(c).cast("string"))
    deps = table(s, d, "nation").select(key("Nation/", "n_nationkey").alias("src"), key("Region/", "n_regionkey").alias("dst")).union(table(s, d, "region").select(key("Region/", "r_regionkey"), F.lit("Root"))).distinct()
    return graph.topo_levels(deps.select(F.col("src").alias("node")).union(deps.select("dst")), deps)


# Texts and symbols: one serialized text for each of the first orders


@query("""SELECT 'Order/' || l_orderkey AS source_path, md5('Part/' || l_partkey) AS guid FROM lineitem WHERE l_partkey % 5 <> 0""")
def guid_extract_lines(s, d):
    k = F.concat(F.lit("Part/"), F.col("l_partkey").cast("string"))
    line = F.concat(F.lit("  m_Ref: {fileID: 1, guid: "), F.when(F.col("l_partkey") % 5 == 0, F.lit(T.NULL_GUID)).otherwise(F.upper(F.md5(k.cast("binary")))), F.lit(", type: 3}"))
    text = table(s, d, "lineitem").select(F.concat(F.lit("Order/"), F.col("l_orderkey").cast("string")).alias("source_path"), F.concat_ws("\r\n", F.lit("%YAML 1.1"), line, F.lit("plain")).alias("text"))
    return parse.guid_lines(text).select("source_path", "guid")


_LINES = "lines AS (SELECT o_custkey AS f, o_orderkey AS line, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN o_orderkey END AS doc, CASE WHEN o_orderpriority[1] = '5' THEN o_orderkey END AS method FROM orders)"


@query(f"WITH {_LINES} SELECT f, line, last_value(doc IGNORE NULLS) OVER (PARTITION BY f ORDER BY line ROWS UNBOUNDED PRECEDING) AS doc FROM lines")
def doc_boundary_carry(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("line"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return o.select("f", "line", F.last(F.when(F.col("p").isin("1", "2"), F.col("line")), ignorenulls=True).over(W.partitionBy("f").orderBy("line").rowsBetween(W.unboundedPreceding, 0)).alias("doc"))


@query(f"WITH {_LINES} SELECT f, line, min(method) OVER (PARTITION BY f ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS method FROM lines")
def lookahead_bounded(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("line"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return o.select("f", "line", F.min(F.when(F.col("p") == "5", F.col("line"))).over(W.partitionBy("f").orderBy("line").rowsBetween(1, 8)).alias("method"))


@query()
def yaml_parse_udtf(s, d):
    return parse.yaml_refs(parse.order_texts(s, d))


_SYMS = """syms AS (SELECT 'M:' || p_brand || '.' || p_type || CASE WHEN p_size % 2 = 0 THEN '(int)' ELSE '' END AS doc_id, p_brand AS type, p_type AS name, min(p_partkey) AS file, bool_and(p_partkey % 3 <> 0) AS semantic FROM part GROUP BY ALL)"""
_CALLS = "calls AS (SELECT l_orderkey AS src, l_linenumber AS line, p_brand AS type, CASE WHEN l_quantity > 45 THEN 'Gone' ELSE p_type END AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {_SYMS}, {_CALLS}, m AS (SELECT c.*, doc_id, semantic, count(doc_id) OVER (PARTITION BY src, line, c.type, c.name) AS k FROM (SELECT DISTINCT * FROM calls) c LEFT JOIN syms USING (type, name))
SELECT src, line, type, name, doc_id, CASE WHEN k = 0 THEN 'unmatched' WHEN k = 1 THEN 'declared' ELSE 'overload' END AS match_kind, CASE WHEN k = 1 AND semantic THEN 'proven' ELSE 'advisory' END AS confidence FROM m""")
def event_cascade(s, d):
    return symbols.event_links(symbols.part_calls(s, d), symbols.part_symbols(s, d))


@query(f"""WITH {_SYMS}, {_CALLS} SELECT DISTINCT src, file FROM calls JOIN syms USING (type, name) WHERE file <> src""")
def symbol_refs_to_files(s, d):
    return symbols.part_calls(s, d).join(symbols.part_symbols(s, d), ["type", "name"]).where("file <> src").select("src", "file").distinct()


@query(f"""WITH {_SYMS} SELECT count(*) AS members, count(DISTINCT type) AS types, count(*) FILTER (WHERE semantic) AS semantic FROM syms""")
def symbol_stats(s, d):
    return symbols.part_symbols(s, d).agg(F.count("*").alias("members"), F.countDistinct("type").alias("types"), F.count_if("semantic").alias("semantic"))


@query(f"""WITH {_SYMS}, {_CALLS}, base AS (SELECT DISTINCT src, line FROM calls WHERE line <= 2),
spec AS (SELECT c.src, c.line, min(doc_id) AS doc_id FROM calls c JOIN syms s ON s.name = c.name AND s.type <> c.type GROUP BY ALL)
SELECT src, line, NULL::VARCHAR AS doc_id, 'proven' AS label FROM base UNION ALL SELECT src, line, doc_id, 'speculative' FROM spec WHERE (src, line) NOT IN (SELECT (src, line) FROM base)""")
def speculative_merge(s, d):
    calls, syms = symbols.part_calls(s, d), symbols.part_symbols(s, d)
    base = calls.where("line <= 2").select("src", "line").distinct().select("src", "line", F.lit(None).cast("string").alias("doc_id"), F.lit("proven").alias("label"))
    other = syms.select("name", F.col("type").alias("other"), "doc_id")
    spec = calls.join(other, "name").where("other <> type").groupBy("src", "line").agg(F.min("doc_id").alias("doc_id")).withColumn("label", F.lit("speculative"))
    return base.unionByName(spec.join(base.select("src", "line"), ["src", "line"], "left_anti"))


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS t, (n_nationkey + 1) AS base FROM nation WHERE n_nationkey < 24), has AS (SELECT n_nationkey AS t FROM nation WHERE n_nationkey % 6 = 5),
r AS (SELECT n_nationkey AS start, n_nationkey AS t, 0 AS depth FROM nation UNION SELECT start, base, depth + 1 FROM r JOIN up USING (t) WHERE depth < 30)
SELECT start, min(depth)::INTEGER AS depth FROM r JOIN has USING (t) WHERE depth > 0 GROUP BY start""")
def inherit_walk_first_level(s, d):
    n = F.col("n_nationkey")
    nation = table(s, d, "nation")
    return symbols.inherit_walk(nation.select(n.alias("start")), nation.where(n < 24).select(n.alias("t"), (n + 1).alias("base")), nation.where(n % 6 == 5).select(n.alias("t")))


# Snapshots and streams

_OLD = "old AS (SELECT 'Order/' || o_orderkey AS path, md5(o_orderstatus) AS guid, o_totalprice AS size FROM orders WHERE o_orderkey % 10 <> 0)"
_NEW = "new AS (SELECT 'Order/' || o_orderkey AS path, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END) AS guid, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 10 <> 1)"


@query(f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.guid <> n.guid THEN 'rebuilt' WHEN o.size <> n.size THEN 'changed' END AS change
FROM old o FULL JOIN new n ON lower(o.path) = lower(n.path)) SELECT path, change FROM j WHERE change IS NOT NULL""")
def snapshot_diff(s, d):
    return incremental.diff(*incremental.order_snapshots(s, d)).select("path", "change")


@query(f"WITH {_OLD}, {_NEW}, dirty AS (SELECT path FROM new WHERE size > 200000) SELECT path, size FROM old WHERE path NOT IN (SELECT path FROM dirty) UNION ALL SELECT path, size FROM new WHERE path IN (SELECT path FROM dirty)")
def upsert_replace_by_file(s, d):
    old, new = incremental.order_snapshots(s, d)
    return incremental.replace_rows(old.select("path", "size"), new.where("size > 200000").select("path", "size"), "path")


@query("""SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || l_linenumber, chr(10) ORDER BY l_partkey || ':' || l_linenumber)) AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def fingerprint_multiset(s, d):
    token = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    return incremental.fingerprint(table(s, d, "lineitem"), "l_orderkey", token)


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, a.s IS DISTINCT FROM b.s AS changed FROM b LEFT JOIN a USING (l_orderkey)""")
def declaration_shape_changed(s, d):
    shape = lambda t, c: t.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias(c))
    li = table(s, d, "lineitem")
    return shape(li, "b").join(shape(li.where("l_linenumber <= 3"), "a"), "l_orderkey", "left").select("l_orderkey", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM k GROUP BY user_id, batch""")
def stream_debounce(s, d):
    return watch.debounce(table(s, d, "events"), "user_id", "1 hour")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM l WHERE rn = 1 AND event_type <> 'refund'""")
def stream_incremental_apply(s, d):
    return watch.apply_changes(s, f"{d}/events.parquet")
