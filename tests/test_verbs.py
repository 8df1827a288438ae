import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, incremental, symbols, verbs
from loomgraph.streaming import watch

G = {c: c * 32 for c in "abcdef"}
FILES = [("Assets/A.prefab", G["a"], "asset"), ("Assets/B.mat", G["b"], "asset"), ("Assets/Copy/B.mat", G["b"], "asset"), ("Assets/Plain.cs", None, "script")]
REFS = [("Assets/A.prefab", G["b"], 3), ("Assets/A.prefab", G["c"], 4), ("Assets/A.prefab", T.BUILTIN_GUIDS[0], 5), ("Assets/Copy/B.mat", G["a"], 1), ("Assets/B.mat", G["c"], 2)]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(FILES, "path string, guid string, kind string"), spark.createDataFrame(REFS, "source_path string, target_guid string, line int")


def test_targets_of_every_kind(store):
    asked = ["assets\\\\a.prefab".replace("\\\\", "\\"), "/proj/Assets/B.mat", G["B".lower()].upper(), G["f"], "plain", "assets", "gone"]
    got = {r.input: (r.how, r.path, r.guid, r.candidates) for r in verbs.targets(store[0], asked, "/proj").collect()}
    assert got == {
        asked[0]: ("path", "Assets/A.prefab", G["a"], 0), asked[1]: ("path", "Assets/B.mat", G["b"], 0), asked[2]: ("guid", "Assets/B.mat", G["b"], 0),
        G["f"]: ("guid", None, G["f"], 0), "plain": ("fuzzy", "Assets/Plain.cs", None, 1), "assets": ("ambiguous", None, None, 4), "gone": ("missing", None, None, 0),
    }


def test_resolve_gives_claimants_and_a_bounded_list(store):
    got = [(r.input, r.how, r.path) for r in verbs.resolve(store[0], [G["b"], "assets", G["e"], "Assets/A.prefab", "gone"], limit=2).collect()]
    assert sorted(got, key=str) == sorted([
        (G["b"], "guid", "Assets/B.mat"), (G["b"], "guid", "Assets/Copy/B.mat"), ("assets", "fuzzy", "Assets/A.prefab"), ("assets", "fuzzy", "Assets/B.mat"), (G["e"], "guid", None), ("Assets/A.prefab", "path", "Assets/A.prefab"),
    ], key=str)


def test_who_uses_and_uses(store):
    who = {(r.input, r.source_path, r.target_path, r.line) for r in verbs.who_uses(*store, [G["c"], "Assets/B.mat", "gone"]).collect()}
    assert who == {(G["c"], "Assets/A.prefab", None, 4), (G["c"], "Assets/B.mat", None, 2), ("Assets/B.mat", "Assets/A.prefab", "Assets/B.mat", 3)}
    assert verbs.who_uses(*store, [G["c"]], prefix="assets/copy").count() == 0
    uses = {(r.target_path, r.line, r.builtin) for r in verbs.uses(*store, ["Assets/A.prefab"]).collect()}
    assert uses == {("Assets/B.mat", 3, False), ("Assets/Copy/B.mat", 3, False), (None, 4, False), (None, 5, True)}
    assert [r.line for r in verbs.uses(*store, ["Assets/A.prefab"], missing_only=True).collect()] == [4]
    live = store[0].sparkSession.createDataFrame([("Assets/B.mat",)], "node string")
    assert [r.line for r in verbs.reachable_only(verbs.who_uses(*store, [G["c"]]), live).collect()] == [2]


def test_batch_file(spark):
    lines = spark.createDataFrame([("# a list",), ("  Assets/A.prefab ",), ("",)], "value string")
    assert [r.input for r in verbs.batch_targets(lines).collect()] == ["Assets/A.prefab"]


def test_predicates_and_names(spark):
    rows = [("Assets/x.CS", ["SerializableAttribute", "Serializable", "Attribute"], 1001, "m_Modification.m_Modifications[0].x"), ("Packages/y.png", ["MenuItem"], 114, "a.m_Script"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "p string, a array<string>, c int, q string")
    got = [tuple(r) for r in df.select(
        T.is_cs_relevant(F.col("p")), T.is_package_sourced(F.col("p")), T.attribute_names(F.col("a")), T.has_live_attribute(F.col("a")), T.is_prefab_override(F.col("c"), F.col("q")), T.is_script_property(F.col("q")),
    ).collect()]
    assert got == [(True, False, "Serializable Attribute", True, True, False), (False, True, "MenuItem", True, False, True), (False, False, None, False, False, False)]
    one = spark.range(1).select(T.context(F.lit("  " + "x" * 200)).alias("c"), *T.figures(F.lit(1234567), F.lit(2.345), F.lit(5 << 20)), T.collision_warning(F.lit("g"), F.array(F.lit("b"), F.lit("a"))), T.collision_warning(F.lit("g"), F.array(*map(F.lit, "abcd")))).first()
    assert (len(one[0]), *one[1:]) == (160, "1,234,567", "2.3 s", "5 MB", "guid g is claimed by a, b", "guid g is claimed by 4 files")
    spots = F.array(F.lit("reflection"), F.lit("syntactic"))
    pick = lambda k: spark.range(1).select(T.without_cs_caveats(spots, F.array(F.lit(k)), ("syntactic",))).first()[0]
    assert pick("guid") == ["reflection"] and pick("event") == ["reflection", "syntactic"]
    assert [r.p for r in df.where(T.of_kind(F.col("p"), "cs")).collect()] == ["Assets/x.CS"]
    with pytest.raises(ValueError):
        T.of_kind(F.col("p"), "other")


def test_long_chains_have_no_cap(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(104)], "t int, base int")
    got = symbols.inherit_walk(spark.createDataFrame([(0,)], "start int"), chain, spark.createDataFrame([(104,)], "t int")).collect()
    assert [(r.start, r.depth) for r in got] == [(0, 104)]


def test_build_order_and_dependents(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "node string, place int")
    deps = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    order, cyclic = graph.build_order(nodes, deps, "place")
    assert not cyclic and [r.node for r in order.collect()] == ["b", "a", "c"]
    ring = deps.unionByName(spark.createDataFrame([("b", "c")], "src string, dst string"))
    order, cyclic = graph.build_order(nodes, ring, "place")
    assert cyclic and [r.node for r in order.collect()] == ["b", "a", "c"]
    assert {r.node for r in graph.dependents(deps, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "c"}


def test_symbol_joins(spark):
    members = spark.createDataFrame([("M:x", "s", "F1", "main"), ("M:y", "s", "F2", "lifecycle"), ("M:z", "t", "F3", "attribute")], "doc_id string, assembly string, file string, entry_reason string")
    refs = spark.createDataFrame([("F2", "M:x", 9), ("F2", "M:x", 4), ("F1", "M:x", 1), ("F1", "M:gone", 2)], "src string, target_doc_id string, line int")
    assert [r.line for r in symbols.unresolved_symbol_refs(refs, members).collect()] == [2]
    modes = spark.createDataFrame([("s", "semantic"), ("t", "syntactic")], "assembly string, mode string")
    assert [r.file for r in symbols.entry_points(members, modes).collect()] == ["F1"]
    assert [tuple(r) for r in symbols.cs_file_edges(refs, members).select("src", "dst", "line").collect()] == [("F2", "F1", 4)]
    files = spark.createDataFrame([("Assets/A", 1)], "path string, n int")
    assert [r.n for r in symbols.paths_to_files(spark.createDataFrame([("ASSETS/a",), ("no",)], "path string"), files).collect()] == [1]


def test_replacements(spark):
    old = spark.createDataFrame([("a", "M:x", "f", 1), ("b", "M:y", "f", 2)], "assembly string, doc_id string, file string, line int")
    new = spark.createDataFrame([("a", "M:z", "g", 5), ("a", "M:z", "f", 7)], "assembly string, doc_id string, file string, line int")
    assert {tuple(r) for r in incremental.replace_declarations(old, new).collect()} == {("a", "M:z", "f", 7), ("b", "M:y", "f", 2)}
    roots = spark.createDataFrame([("/R", "p", 1), ("/r", "q", 0)], "real_path string, prefix string, place int")
    assert [tuple(r) for r in incremental.replace_roots(roots).collect()] == [("/r", "q")]
    assert {(r.line, r.side) for r in incremental.symmetric_difference(old, new).collect()} == {(1, "left"), (2, "left"), (5, "right"), (7, "right")}


def test_a_repeated_batch_and_a_restart_keep_the_table(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "user_id int, ts int, event string")
    state = watch.LatestState(spark, "user_id", ["ts"])
    state.apply(batch((1, 1, "a"), (2, 1, "b")), 0)
    for s in (state, state, watch.LatestState(spark, "user_id", ["ts"], state.root)):
        s.apply(batch((2, 2, "c"), (3, 1, "d")), 1)
        assert sorted(tuple(r) for r in s.read().select("user_id", "event").collect()) == [(1, "a"), (2, "c"), (3, "d")]
