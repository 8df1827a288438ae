"""Snapshot diff, replacement of derived rows, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import cut  # noqa: F401
from loomgraph.tables import table


def order_snapshots(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Two inventories (path, guid, size) of the orders."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("Order/"), k.cast("string")).alias("path")
    old = o.where(k % 10 != 0).select(path, F.md5(F.col("o_orderstatus").cast("binary")).alias("guid"), F.col("o_totalprice").alias("size"))
    state = F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = o.where(k % 10 != 1).select(path, F.md5(state.cast("binary")).alias("guid"), F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("size"))
    return old, new


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, ...): added, removed, rebuilt (other guid) or changed rows; equal rows are left out."""
    o = old.select(F.lower("path").alias("k"), F.struct("path", "guid", "size").alias("o"))
    n = new.select(F.lower("path").alias("k"), F.struct("path", "guid", "size").alias("n"))
    same = lambda f: F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same("guid"), "rebuilt").when(~same("size"), "changed")
    return o.join(n, "k", "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), change.alias("change"), "o", "n").where("change IS NOT NULL")


def replace_rows(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of keys that ``new`` doesn't touch, and all of ``new``."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fingerprint(rows: DataFrame, key: str, token) -> DataFrame:
    """Order-insensitive, duplicate-sensitive SHA-256 of a key's tokens."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(token)), "\n"), 256).alias("fingerprint"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted, with ``side`` (left or right)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replace_declarations(symbols: DataFrame, new: DataFrame, key: str = "assembly") -> DataFrame:
    """Symbols after assemblies were analysed anew: theirs are replaced; of one doc_id in an assembly the first line declares."""
    first = new.groupBy(key, "doc_id").agg(F.min(F.struct("file", "line")).alias("at")).select(key, "doc_id", "at.*")
    return symbols.join(new.select(key).distinct(), key, "left_anti").select(key, "doc_id", "file", "line").unionByName(first)


def replace_roots(roots: DataFrame) -> DataFrame:
    """(real_path, prefix): one row for each root, whatever its case; the first of ``place`` wins."""
    return roots.groupBy(F.lower("real_path").alias("k")).agg(F.min_by(F.struct("real_path", "prefix"), "place").alias("r")).select("r.*")
