"""The questions that users ask of the graph, for any targets: resolve, who uses, uses, and their answers' states.

Targets come as a list that a user gives, so they are part of the plan. Files are (path, guid, kind),
references (source_path, target_guid, line); targets become guids first, and references are joined
on guids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as T

FUZZY = 20
GUID = "^[0-9a-f]{32}$"


def query_input(raw: str, root: str | None = None) -> str:
    """Slashes forward; a path inside the project's root becomes relative to it."""
    q, base = raw.strip().replace("\\", "/"), (root or "").replace("\\", "/").rstrip("/")
    return q[len(base) + 1 :] if base and q.lower().startswith(base.lower() + "/") else q


def batch_targets(lines: DataFrame) -> DataFrame:
    """(input): targets of a text file read by ``spark.read.text``, one a line; blank lines and ``#`` comments are left out."""
    x = F.trim(F.col("value"))
    return lines.select(x.alias("input")).where("input <> '' AND NOT startswith(input, '#')")


def _asked(files: DataFrame, asked: list[str], root: str | None) -> DataFrame:
    rows = [(a, query_input(a, root).lower()) for a in dict.fromkeys(asked)]
    return files.sparkSession.createDataFrame(rows, "input string, q string")


def _matches(files: DataFrame, asked: list[str], root: str | None, how) -> DataFrame:
    """(input, path, guid, kind) of files for which ``how`` (path, text) holds; the targets are an array in the plan."""
    each = [F.struct(F.lit(a).alias("input"), F.lit(query_input(a, root).lower()).alias("q")) for a in dict.fromkeys(asked)]
    hits = F.filter(F.array(*each), lambda x: how(F.lower("path"), x["q"]))
    return files.select("path", "guid", "kind", F.explode(hits).alias("x")).select("x.input", "path", "guid", "kind")


def resolve(files: DataFrame, asked: list[str], root: str | None = None, limit: int = FUZZY) -> DataFrame:
    """(input, how, path, guid, kind): the exact path, else all claimants of an exact guid, else paths with that text in them.

    At most ``limit`` of the last for each input, by path. A guid that no file has is an answer of
    its own (how guid, path null); an input that nothing matches has no row. Null paths match nothing.
    """
    q = _asked(files, asked, root)
    exact = files.join(F.broadcast(q), F.lower("path") == F.col("q")).select("input", F.lit("path").alias("how"), "path", "guid", "kind")
    left = q.join(exact.select("input").distinct(), "input", "left_anti")
    claimed = F.broadcast(left.where(F.col("q").rlike(GUID)))
    known = files.join(claimed, F.col("guid") == F.col("q")).select("input", F.lit("guid").alias("how"), "path", "guid", "kind")
    none = F.lit(None).cast("string")
    unknown = claimed.join(known.select("input").distinct(), "input", "left_anti").select("input", F.lit("guid").alias("how"), none.alias("path"), F.col("q").alias("guid"), none.alias("kind"))
    some = _matches(files, asked, root, lambda p, x: F.contains(p, x)).join(F.broadcast(left.where(~F.col("q").rlike(GUID)).select("input")), "input")
    if limit:
        some = _least(some, limit)
    return exact.unionByName(known).unionByName(unknown).unionByName(some.select("input", F.lit("fuzzy").alias("how"), "path", "guid", "kind"))


def _least(some: DataFrame, limit: int) -> DataFrame:
    # Catalyst keeps ``limit`` rows a group before the exchange.
    return some.withColumn("rn", F.row_number().over(W.partitionBy("input").orderBy("path", "guid"))).where(F.col("rn") <= limit).drop("rn")


def targets(files: DataFrame, asked: list[str], root: str | None = None) -> DataFrame:
    """(input, how, path, guid, candidates): one row for each input.

    A guid is always a target (its first path where several claim it, none where unknown); so is an
    exact path, and a text in just one path. Otherwise how is ambiguous, with the number of
    candidates, or missing.
    """
    q = _asked(files, asked, root)
    exact = files.join(F.broadcast(q), F.lower("path") == F.col("q")).groupBy("input").agg(F.min(F.struct("path", "guid")).alias("e"))
    claimed = files.join(F.broadcast(q.where(F.col("q").rlike(GUID))), F.col("guid") == F.col("q")).groupBy("input").agg(F.min("path").alias("claimant"))
    some = _matches(files, asked, root, lambda p, x: F.contains(p, x)).groupBy("input").agg(F.count("*").alias("n"), F.min(F.struct("path", "guid")).alias("f"))
    all_ = q.join(exact, "input", "left").join(claimed, "input", "left").join(some, "input", "left")
    guid, n = F.col("q").rlike(GUID), F.coalesce("n", F.lit(0))
    how = F.when(F.col("e").isNotNull(), "path").when(guid, "guid").when(n == 1, "fuzzy").when(n > 1, "ambiguous").otherwise("missing")
    pick = lambda a, b, c: F.when(F.col("how") == "path", a).when(F.col("how") == "guid", b).when(F.col("how") == "fuzzy", c)
    return all_.withColumn("how", how).select(
        "input", "how", pick(F.col("e.path"), F.col("claimant"), F.col("f.path")).alias("path"), pick(F.col("e.guid"), F.col("q"), F.col("f.guid")).alias("guid"),
        F.when(F.col("how").isin("fuzzy", "ambiguous"), n).otherwise(0).cast("bigint").alias("candidates"),
    )


def _kept(edges: DataFrame, column: str, prefix: str | None) -> DataFrame:
    return edges if prefix is None else edges.where(T.under(F.col(column), prefix))


def who_uses(files: DataFrame, refs: DataFrame, asked: list[str], root: str | None = None, prefix: str | None = None) -> DataFrame:
    """(input, source_path, target_path, target_key, line, builtin): direct references to each target.

    With ``prefix`` only of sources under it. A guid without a file is asked for all the same.
    Ambiguous and missing inputs have no rows; ``targets`` tells which they are.
    """
    found = targets(files, asked, root).where("guid IS NOT NULL").select("input", F.col("path").alias("target_path"), F.col("guid").alias("target_guid"))
    met = refs.join(F.broadcast(found), "target_guid")  # a row for each input at most
    return _kept(met, "source_path", prefix).select("input", "source_path", "target_path", F.col("target_guid").alias("target_key"), "line", builtin(F.col("target_guid")).alias("builtin"))


def uses(files: DataFrame, refs: DataFrame, asked: list[str], root: str | None = None, prefix: str | None = None, missing_only: bool = False) -> DataFrame:
    """(input, source_path, target_path, target_key, line, builtin): what each target refers to, unresolved references too.

    With ``prefix`` only targets under it; with ``missing_only`` only unresolved ones, built-ins not counted.
    """
    found = targets(files, asked, root).where("path IS NOT NULL").select("input", F.col("path").alias("source_path"))
    met = refs.join(F.broadcast(found), "source_path")
    own = files.join(met.select(F.col("target_guid").alias("guid")).distinct(), "guid", "left_semi").select(F.col("guid").alias("target_guid"), F.col("path").alias("target_path"))
    out = met.join(own, "target_guid", "left").select("input", "source_path", "target_path", F.col("target_guid").alias("target_key"), "line", builtin(F.col("target_guid")).alias("builtin"))
    return _kept(out.where("target_path IS NULL AND NOT builtin") if missing_only else out, "target_path", prefix)


def builtin(guid: Column) -> Column:
    return guid.isin(list(T.BUILTIN_GUIDS))


def reachable_only(answers: DataFrame, live: DataFrame, column: str = "source_path") -> DataFrame:
    """Answers whose file is in ``live`` (node)."""
    return answers.join(live.select(F.col("node").alias(column)).distinct(), column, "left_semi")
