"""The star schema as a dependency graph: files, references, symbols and texts, with the same in SQL.

Parts, suppliers and customers whose key divides by 50 are left out, so that references to them
stay unresolved; urgent and high-priority orders refer to the two built-in guids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import BUILTIN_GUIDS
from loomgraph.operators import graph
from loomgraph.tables import table

#: (table, key, folder, kind, leave out every 50th)
NODES = (
    ("region", "r_regionkey", "Region", "settings", False), ("nation", "n_nationkey", "Nation", "folder", False),
    ("customer", "c_custkey", "Customer", "asset", True), ("supplier", "s_suppkey", "Supplier", "asset", True),
    ("part", "p_partkey", "Part", "script", True), ("orders", "o_orderkey", "Order", "asset", False),
)
#: (table, source folder, source key, target folder, target key, line)
REFS = (
    ("nation", "Nation", "n_nationkey", "Region", "n_regionkey", "1"), ("customer", "Customer", "c_custkey", "Nation", "c_nationkey", "1"),
    ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", "1"), ("orders", "Order", "o_orderkey", "Customer", "o_custkey", "1"),
    ("lineitem", "Order", "l_orderkey", "Part", "l_partkey", "l_linenumber"), ("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", "l_linenumber"),
)


def _path(folder: str, key: str):
    return F.concat(F.lit(f"{folder}/"), F.col(key).cast("string"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, guid, kind)"""
    parts = []
    for name, key, folder, kind, some in NODES:
        t = table(spark, d, name)
        t = t.where(F.col(key) % 50 != 0) if some else t
        parts.append(t.select(_path(folder, key).alias("path"), F.lit(kind).alias("kind")))
    return reduce(DataFrame.unionByName, parts).select("path", F.md5(F.col("path").cast("binary")).alias("guid"), "kind")


def refs(spark: SparkSession, d: str) -> DataFrame:
    """(source_path, target_guid, line), repeated rows kept; built-in guids at line 0."""
    parts = [
        table(spark, d, t).select(_path(sf, sk).alias("source_path"), F.md5(_path(tf, tk).cast("binary")).alias("target_guid"), F.expr(line).cast("int").alias("line"))
        for t, sf, sk, tf, tk, line in REFS
    ]
    first = F.substring("o_orderpriority", 1, 1)
    parts.append(table(spark, d, "orders").where(first.isin("1", "2")).select(_path("Order", "o_orderkey").alias("source_path"), F.when(first == "1", BUILTIN_GUIDS[0]).otherwise(BUILTIN_GUIDS[1]).alias("target_guid"), F.lit(0).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_guids(refs(spark, d), files(spark, d))


def walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk_edges(edges(spark, d))


FILES_SQL = " UNION ALL ".join(f"SELECT '{f}/' || {k} AS path, '{kind}' AS kind FROM {t}" + (f" WHERE {k} % 50 <> 0" if some else "") for t, k, f, kind, some in NODES)
REFS_SQL = " UNION ALL ".join(f"SELECT '{sf}/' || {sk} AS source_path, md5('{tf}/' || {tk}) AS target_guid, ({line})::INTEGER AS line FROM {t}" for t, sf, sk, tf, tk, line in REFS)
REFS_SQL += f" UNION ALL SELECT 'Order/' || o_orderkey, CASE WHEN o_orderpriority[1] = '1' THEN '{BUILTIN_GUIDS[0]}' ELSE '{BUILTIN_GUIDS[1]}' END, 0 FROM orders WHERE o_orderpriority[1] IN ('1', '2')"
BUILTIN_SQL = ", ".join(f"'{g}'" for g in BUILTIN_GUIDS)
GRAPH_SQL = f"""files AS (SELECT path, md5(path) AS guid, kind FROM ({FILES_SQL})), refs AS ({REFS_SQL}),
edges AS (SELECT source_path, path AS target_path, target_guid AS target_key, line, 'guid' AS kind, target_guid IN ({BUILTIN_SQL}) AS builtin FROM refs LEFT JOIN files ON guid = target_guid),
walk AS (SELECT DISTINCT source_path AS src, target_path AS dst FROM edges WHERE target_path IS NOT NULL)"""
