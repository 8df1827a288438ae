import duckdb
import pytest

from loomgraph.functions import text as T
from loomgraph.operators import graph, incremental, parse, symbols
from loomgraph.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    norm = lambda v: str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else "null" if v is None else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(columns, want.fetchall())


def test_two_cycle_is_truncated_and_leaves_the_seed_out(spark):
    walk = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    found, truncated = graph.closure(walk, spark.createDataFrame([("a",)], "node string"), cap=10)
    assert truncated and {tuple(r) for r in found.collect()} == {("b", 1)}


def test_closure_depths_and_no_truncation(spark):
    walk = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    found, truncated = graph.closure(walk, spark.createDataFrame([("c",)], "node string"), reverse=True)
    assert not truncated and {tuple(r) for r in found.collect()} == {("b", 1), ("a", 1)}


def test_topo_cycle_raises(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.topo_levels(deps.select(F.col("src").alias("node")), deps, most=5)


@pytest.mark.parametrize(
    "line, n",
    [
        ('\\"guid\\":\\"' + "a" * 32 + '\\"', 1), ('"m_ObjectId": "' + "b" * 32 + '"', 0), ("url?guid=" + "c" * 32 + "&x", 1),
        ('"GUID:' + "d" * 32 + '"', 1), ("{guid: " + "e" * 32 + "}, {guid: " + "f" * 32 + "}", 2), ("guid: 01234567-89ab-cdef-0123-456789abcdef", 0), ("guid: " + "a" * 33, 0),
    ],
)
def test_guid_forms(spark, line, n):
    assert len(spark.createDataFrame([(line,)], "l string").select(T.guids(F.col("l"))).first()[0]) == n


def test_paths(spark):
    df = spark.createDataFrame([("../b/./c.png?x#y",), ("/a//b",), ("Assets/x/../y",), ("../../../up",)], "p string")
    got = [r[0] for r in df.select(T.normal_path(F.col("p"), F.lit("Assets/d"))).collect()]
    assert got == ["Assets/b/c.png", "a/b", "Assets/y", "up"]


def test_under_and_globs(spark):
    df = spark.createDataFrame([("Assets/A/x",), ("assets/ab",), (None,)], "p string")
    assert [r[0] for r in df.select(T.under(F.col("p"), "ASSETS\\A")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        T.under(F.col("p"), "/")
    import re

    assert re.match(T.glob_regex("Assets/**/k?.cs"), "assets/a/b/k1.cs") and not re.match(T.glob_regex("a/*"), "a/b/c")


def test_yaml_documents_lookahead_and_paths():
    g = "a" * 32
    text = f"%YAML 1.1\n--- !u!114 &-7 stripped\nMonoBehaviour:\n  m_Parts:\n  - part: {{guid: {g}}}\n  - part: {{guid: {g.upper()}}}\n  m_GUID: {g}\n  m_Call:\n    m_Target: {{fileID: 3}}\n    m_TargetAssemblyTypeName: Foo, Game\n    m_MethodName: Go"
    rows = parse.parse_yaml("p", text)
    assert [r[1:5] for r in rows] == [(g, 5, 114, "-7"), (g, 6, 114, "-7"), (None, 9, 114, "-7")]
    assert rows[2][5:7] == ("Go", "Foo") and rows[0][7] == "m_Parts[0].part" and rows[1][7] == "m_Parts[1].part"


def test_diff_of_equal_snapshots_is_empty(spark):
    old, _ = incremental.order_snapshots(spark, SF)
    assert incremental.diff(old, old).count() == 0


def test_overloads_are_advisory(spark):
    calls = spark.createDataFrame([(1, 1, "T", "Go"), (1, 2, "T", "Jump"), (1, 3, "T", "Gone")], "src int, line int, type string, name string")
    members = spark.createDataFrame([("M:T.Go", "T", "Go", True), ("M:T.Go(int)", "T", "Go", True), ("M:T.Jump", "T", "Jump", True)], "doc_id string, type string, name string, semantic boolean")
    got = {(r.name, r.match_kind, r.confidence) for r in symbols.event_links(calls, members).collect()}
    assert got == {("Go", "overload", "advisory"), ("Jump", "declared", "proven"), ("Gone", "unmatched", "advisory")}


def test_calls_and_references_of_all_orders_and_lines(spark, tmp_path):
    parts = [(1, "B1", "bolt", 3), (2, "B1", "bolt", 4), (3, "B2", "bolt", 5), (5, "B2", "nut", 7)]
    items = [(k, n, (k + n) % 4 + 1 if (k + n) % 4 < 3 else 5, 46.0 if n == 6 else 1.0) for k in (7, 10, 23) for n in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    by = {p[0]: p for p in parts}
    syms = [(f"M:{b}.{t}" + ("(int)" if size % 2 == 0 else ""), b, t, k) for k, b, t, size in parts]
    calls = [(k, n, by[p][1], "Gone" if q > 45 else by[p][2]) for k, n, p, q in items]
    assert {tuple(r)[:4] for r in catalog.QUERIES["event_cascade"](spark, str(tmp_path)).select("src", "line", "type", "name").collect()} == set(calls)
    assert run("symbol_refs_to_files") == sorted({(c[0], s[3]) for c in calls for s in syms if s[1:3] == c[2:] and s[3] != c[0]})
    spec = {(c[0], c[1]): min(s[0] for s in syms if s[2] == c[3] and s[1] != c[2]) for c in calls if c[1] > 2 and any(s[2] == c[3] and s[1] != c[2] for s in syms)}
    want = [(c[0], c[1], None, "proven") for c in calls if c[1] <= 2] + [(*k, v, "speculative") for k, v in spec.items()]
    assert sorted(map(str, run_unsorted(spark, "speculative_merge", tmp_path))) == sorted(map(str, want))
    import hashlib

    assert run("guid_extract_lines") == sorted((f"Order/{k}", hashlib.md5(f"Part/{p}".encode()).hexdigest()) for k, n, p, q in items if p % 5)


def run_unsorted(spark, name, path):
    return [tuple(r) for r in catalog.QUERIES[name](spark, str(path)).collect()]


def test_calls_of_inherited_members(spark):
    calls = spark.createDataFrame([(1, 1, "Pawn", "Poke"), (1, 2, "Pawn", "Go"), (1, 3, "Pawn", "Gone"), (1, 4, "BasePawn", "Poke")], "src int, line int, type string, name string")
    members = spark.createDataFrame([("M:Root.Poke", "Root", "Poke", True), ("M:BasePawn.Poke", "BasePawn", "Poke", True), ("M:Pawn.Go", "Pawn", "Go", True)], "doc_id string, type string, name string, semantic boolean")
    inherit = spark.createDataFrame([("Pawn", "BasePawn"), ("BasePawn", "Root"), ("Root", "Pawn")], "t string, base string")
    got = {(r.line, r.doc_id, r.match_kind, r.confidence) for r in symbols.event_links(calls, members, inherit).collect()}
    assert got == {(1, "M:BasePawn.Poke", "inherited", "advisory"), (2, "M:Pawn.Go", "declared", "proven"), (3, None, "unmatched", "advisory"), (4, "M:BasePawn.Poke", "declared", "proven")}
