"""Late-resolved edges, lookups, closures by level sets and reachability by semi-naive steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.scratch import cut

DEPTH_CAP = 12


def resolve_guids(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (source_path, target_guid, line) with target_path; unresolved ones stay, claimants fan out."""
    return refs.join(files.select(F.col("guid").alias("target_guid"), F.col("path").alias("target_path")), "target_guid", "left").select(
        "source_path", "target_path", F.col("target_guid").alias("target_key"), "line", F.lit("guid").alias("kind"),
        F.col("target_guid").isin(list(T.BUILTIN_GUIDS)).alias("builtin"),
    )


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (source_path, norm, line) with target_path by case-insensitive path."""
    return refs.join(files.select(F.lower("path").alias("k"), F.col("path").alias("target_path")), F.lower("norm") == F.col("k"), "left").select(
        "source_path", "target_path", F.col("norm").alias("target_key"), "line", F.lit("path").alias("kind"), F.lit(False).alias("builtin")
    )


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where("target_path IS NULL AND NOT builtin")


def walk_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of resolved edges."""
    return edges.where("target_path IS NOT NULL").select(F.col("source_path").alias("src"), F.col("target_path").alias("dst")).distinct()


def _steps(walk: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, next), from edges that are written once, however often they are joined."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return cut(walk).select(F.col(here).alias("node"), F.col(there).alias("next"))


def _onward(step: DataFrame, level: DataFrame) -> DataFrame:
    return step.join(level, "node").select(F.col("next").alias("node")).distinct()


def level_sets(walk: DataFrame, seeds: DataFrame, cap: int = DEPTH_CAP, reverse: bool = False) -> DataFrame:
    """(node, depth) with least depths up to ``cap``, seeds at 0: one join a level, from new nodes only."""
    step = _steps(walk, reverse)
    level = seen = cut(seeds.select("node").distinct())
    every = level.withColumn("depth", F.lit(0))
    for depth in range(1, cap + 1):
        level = cut(_onward(step, level).join(seen, "node", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        every = every.unionByName(level.withColumn("depth", F.lit(depth)))
    return every


def is_truncated(walk: DataFrame, seeds: DataFrame, levels: DataFrame, cap: int = DEPTH_CAP, reverse: bool = False) -> bool:
    """Whether some walk from the seeds, through a cycle too, has ``cap`` steps.

    Only edges among the nodes found take part; without a cycle the levels run out after the longest path.
    """
    if not levels.where(F.col("depth") == cap).isEmpty():
        return True
    step = cut(_steps(walk, reverse).join(levels.select("node"), "node", "left_semi"))
    level = cut(seeds.select("node").distinct())
    for _ in range(cap):
        level = cut(_onward(step, level))
        if level.isEmpty():
            return False
    return True


def closure(walk: DataFrame, seeds: DataFrame, cap: int = DEPTH_CAP, reverse: bool = False, flag: bool = True):
    """((node, depth) with least depth over 0, truncated); a seed is in it only through others, never itself.

    Without ``flag`` truncated is None and costs nothing.
    """
    walk = cut(walk)
    levels = level_sets(walk, seeds, cap, reverse)
    return levels.where("depth > 0"), is_truncated(walk, seeds, levels, cap, reverse) if flag else None


def reachable(walk: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes reachable from seeds, seeds included: only the newest nodes step on."""
    step = _steps(walk)
    frontier = seen = cut(seeds.select("node").distinct())
    for depth in count(1):
        frontier = cut(_onward(step, frontier).join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier) if depth % 8 else cut(seen.unionByName(frontier))  # keeps plans short on long paths


def chain_confidence(edges: DataFrame, depths: DataFrame, cap: int = DEPTH_CAP) -> DataFrame:
    """(node, depth, label): weakest label along least-depth paths, the worst over alternatives.

    ``edges`` (src, dst, r) with a label's rank; ``depths`` (node, depth) with the seeds at 0.
    """
    depths = cut(depths)
    done = depths.where("depth = 0").select("node", "depth", F.lit(2).alias("r"))
    last = done
    for d in range(1, cap + 1):
        here = depths.where(F.col("depth") == d)
        last = cut(
            last.select(F.col("node").alias("src"), F.col("r").alias("up")).join(edges, "src").join(here, F.col("dst") == F.col("node"))
            .groupBy("node", "depth").agg(F.min(F.least("up", "r")).alias("r"))
        )
        if last.isEmpty():
            break
        done = done.unionByName(last)
    return done.where("depth > 0").select("node", "depth", T.unrank(F.col("r")).alias("label"))


def topo_levels(nodes: DataFrame, deps: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level): longest path to a node without dependencies; raises on a cycle.

    A path is no longer than there are nodes: levels that still rise then tell a cycle (``most``: sooner).
    """
    out = cut(nodes.select("node").distinct().withColumn("level", F.lit(0)))
    deps = cut(deps.select(F.col("src").alias("node"), "dst").distinct())
    most = most or out.count() + 1
    for _ in range(most):
        up = deps.join(out.select(F.col("node").alias("dst"), "level"), "dst").groupBy("node").agg((F.max("level") + 1).alias("n"))
        new = cut(out.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("n", F.lit(0))).alias("level")))
        if new.join(out, ["node", "level"], "left_anti").isEmpty():
            return new
        out = new
    raise ValueError("a cycle among dependencies")


def build_order(nodes: DataFrame, deps: DataFrame, place: str) -> tuple[DataFrame, bool]:
    """(nodes with ``level``, cyclic): by topological level, or on a cycle all at level 0 in their own order of ``place``, to be warned of."""
    try:
        levels = topo_levels(nodes, deps)
    except ValueError:
        return nodes.withColumn("level", F.lit(0)).orderBy(place), True
    return nodes.join(levels, "node").orderBy("level", place), False


def dependents(deps: DataFrame, dirty: DataFrame) -> DataFrame:
    """Nodes that depend on any dirty node, however far, and the dirty ones themselves."""
    return reachable(deps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), dirty)
