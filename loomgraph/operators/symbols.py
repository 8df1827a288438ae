"""Symbols: event bindings, inheritance, nearest definition files."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import cut
from loomgraph.tables import table


def part_symbols(spark, d: str) -> DataFrame:
    """Members of brands: (doc_id, type, name, file, semantic)."""
    doc_id = F.concat(F.lit("M:"), "p_brand", F.lit("."), "p_type", F.when(F.col("p_size") % 2 == 0, "(int)").otherwise(""))
    return table(spark, d, "part").groupBy(doc_id.alias("doc_id"), F.col("p_brand").alias("type"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("file"), F.every(F.col("p_partkey") % 3 != 0).alias("semantic"))


def part_calls(spark, d: str) -> DataFrame:
    """Calls by every order: (src, line, type, name)."""
    calls = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return calls.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("line"), F.col("p_brand").alias("type"), F.when(F.col("l_quantity") > 45, "Gone").otherwise(F.col("p_type")).alias("name"))


def event_links(calls: DataFrame, members: DataFrame, inherit: DataFrame | None = None) -> DataFrame:
    """Each distinct call with its declared member, every overload, the inherited ones, or a row without one.

    With ``inherit`` (t, base), a call whose own type lacks the member takes those of the nearest
    level of base types that has it, as 'inherited'.

    Proven only for a single member of a semantic assembly; everything else is advisory. Members
    are counted per (type, name) before the join, so no window gathers a call's matches.
    """
    counted = members.groupBy("type", "name").agg(F.count("*").alias("k"))
    found = calls.distinct().join(counted, ["type", "name"], "left").join(members.select("type", "name", "doc_id", "semantic"), ["type", "name"], "left")
    k = F.coalesce("k", F.lit(0))
    links = found.select(
        "src", "line", "type", "name", "doc_id", F.when(k == 0, "unmatched").when(k == 1, "declared").otherwise("overload").alias("match_kind"),
        F.when((k == 1) & F.col("semantic"), "proven").otherwise("advisory").alias("confidence"),
    )
    if inherit is None:
        return links
    wanted = links.where("match_kind = 'unmatched'").select("type", "name").distinct()
    # A node is a type with the member looked for, so that all members walk together.
    node = lambda t: F.struct(F.col(t).alias("type"), "name")
    steps = _above(wanted, inherit)
    depth = inherit_walk(wanted.select(node("type").alias("start")), steps.select(node("t").alias("t"), node("base").alias("base")), members.select(node("type").alias("t")).distinct())
    near = _bases(depth, steps).join(members.select(F.col("type").alias("base"), "name", F.col("doc_id").alias("up")), ["base", "name"]).select("type", "name", "up").distinct()
    more = links.join(near, ["type", "name"], "left")
    up = F.col("match_kind").eqNullSafe("unmatched") & F.col("up").isNotNull()
    return more.select("src", "line", "type", "name", F.when(up, F.col("up")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(up, "inherited").otherwise(F.col("match_kind")).alias("match_kind"), "confidence")


def _above(wanted: DataFrame, inherit: DataFrame) -> DataFrame:
    """(name, t, base): inheritance for every name looked for."""
    return cut(inherit.select("t", "base").distinct().crossJoin(wanted.select("name").distinct()))


def _bases(depth: DataFrame, steps: DataFrame) -> DataFrame:
    """(type, name, base): base types at the depth found for each start."""
    level = depth.select(F.col("start.type").alias("type"), F.col("start.name").alias("name"), "depth", F.col("start.type").alias("t"))
    out, most = None, depth.agg(F.max("depth")).first()[0] or 0
    for k in range(1, most + 1):
        level = cut(level.join(steps, ["name", "t"]).select("type", "name", "depth", F.col("base").alias("t")).distinct())
        hit = level.where(F.col("depth") == k).select("type", "name", F.col("t").alias("base"))
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else level.select("type", "name", F.col("t").alias("base")).limit(0)


def inherit_walk(starts: DataFrame, inherit: DataFrame, having: DataFrame) -> DataFrame:
    """(start, depth): first level of base types at which one has the member; all starts walk together.

    A start never visits a type twice, so that cycles end; depth has no bound.
    """
    level = cut(starts.select("start", F.col("start").alias("t")))
    seen, found = level, None
    for depth in count(1):
        level = cut(level.join(inherit, "t").select("start", F.col("base").alias("t")).distinct().join(seen, ["start", "t"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level) if depth % 8 else cut(seen.unionByName(level))  # keeps plans short on long chains
        hit = cut(level.join(having, "t", "left_semi").select("start").distinct().withColumn("depth", F.lit(depth)))
        found = hit if found is None else found.unionByName(hit)
        found = found if depth % 8 else cut(found)
        level = level.join(hit, "start", "left_anti")
    return found if found is not None else starts.select("start", F.lit(0).alias("depth")).limit(0)


def unresolved_symbol_refs(refs: DataFrame, members: DataFrame) -> DataFrame:
    """References (target_doc_id) to symbols that no assembly declares."""
    return refs.join(members.select(F.col("doc_id").alias("target_doc_id")).distinct(), "target_doc_id", "left_anti")


def entry_points(members: DataFrame, assemblies: DataFrame) -> DataFrame:
    """(file): files with a member that something outside calls, by attribute or as main, in assemblies analysed semantically."""
    sure = assemblies.where("mode = 'semantic'").select("assembly")
    return members.where("entry_reason IN ('attribute', 'main')").join(sure, "assembly", "left_semi").select("file").distinct()


def cs_file_edges(refs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, line): earliest reference between two files through symbols; a file's own symbols don't count."""
    met = refs.join(members.select(F.col("doc_id").alias("target_doc_id"), F.col("file").alias("dst")), "target_doc_id").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.min("line").alias("line"))


def paths_to_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Files (with their columns) of the paths asked for, in any case; paths without a file have no row."""
    return files.join(paths.select(F.lower("path").alias("_k")).distinct(), F.lower(files["path"]) == F.col("_k"), "left_semi")


def nearest_ancestor(paths: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """(key, unit): definition of the longest directory above each path; of two in one, the smaller ``pref``.

    Each path's own ancestors are exploded, so the join is on equality, not on prefixes.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = paths.select(key, F.explode(dirs).alias("dir")).join(defs, "dir")
    return near.groupBy(key).agg(F.min(F.struct(-F.length("dir"), "pref", "unit")).getField("unit").alias("unit"))
