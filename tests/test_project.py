import json
import os

import pytest

from loomgraph.sources import outputs, project

G = "0123456789abcdef0123456789abcde"


@pytest.fixture
def tree(tmp_path):
    files = {
        "ProjectSettings/ProjectVersion.txt": "m_EditorVersion: 2022.3.1f1\n",
        "ProjectSettings/EditorSettings.asset": "EditorSettings:\n  m_SerializationMode: 2\n",
        "Assets/_Game/a.prefab": "x", "Assets/_Game/a.prefab.meta": f"guid: {G}1\n",
        "Assets/_Game.meta": f"guid: {G}2\n",
        "Assets/b.txt": "no sidecar", "Assets/c.png": "x", "Assets/c.png.meta": "none\n",
        "Assets/lost.mat.meta": f"guid: {G}3\n",
        "Assets/Old~/d.mat": "x", "Assets/Old~.meta": f"guid: {G}4\n", "Assets/.e/f.mat": "x", "Assets/g.tmp": "x",
        "Assets/Lib/lib.asmdef": '{"name": "My.Lib",\n "precompiledReferences": [\n  "a/X.dll", "Y.dll"\n ]}', "Assets/Lib/lib.asmdef.meta": f"guid: {G}5\n",
        "Assets/Lib/In/s.cs": "", "Assets/Other/o.asmref": json.dumps({"reference": f"GUID:{G}5"}), "Assets/Other/t.cs": "",
        "Assets/Editor/u.cs": "", "Assets/Temp/v.cs": "",
        "Library/PackageCache/p/w.cs": "", "Library/PackageCache/p/w.cs.meta": f"guid: {G}6\n", "Library/PackageCache/p/n.cs": "",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(tmp_path / "gone", tmp_path / "Assets/dangling")
    os.symlink(tmp_path / "Assets/_Game", tmp_path / "Assets/again")
    return tmp_path


def test_discovery_and_gate(tree, tmp_path):
    assert project.find_root(str(tree / "Assets/_Game")) == str(tree)
    assert project.editor_version(str(tree)) == "2022.3.1f1"
    project.require_force_text(str(tree))
    (tree / project.SETTINGS_FILE).write_text("  m_SerializationMode: 1\n")
    with pytest.raises(project.NotForceText):
        project.require_force_text(str(tree))


def test_config_defaults_and_warnings():
    assert project.load_config(None) == (project.Config(), [])
    got, warnings = project.load_config('{"roots": ["A", 1], "excludeDirs": 3, "liveness": {"allowlist": ["x/**"]}, "watch": {"autoStart": false}, "new": 1}')
    assert (got.roots, got.exclude_dirs, got.allowlist, got.auto_start) == (("A",), project.EXCLUDED_DIRS, ("x/**",), False)
    assert len(warnings) == 1 and "new" in warnings[0]
    assert project.load_config("[")[0] == project.load_config("[]")[0] == project.Config()


def test_scan_inventory_and_warnings(spark, tree):
    rows, warnings = project.listing(spark, str(tree))
    assert warnings == ["dangling link 'Assets/dangling'"]
    files, warned = project.scan(rows, str(tree))
    got = {r.path: (r.kind, r.guid and r.guid[-1], r.identity_only) for r in files.collect()}
    assert got == {
        "ProjectSettings/EditorSettings.asset": ("settings", None, False),
        "Assets/_Game": ("folder", "2", False), "Assets/_Game/a.prefab": ("asset", "1", False), "Assets/c.png": ("asset", None, False),
        "Assets/Lib/lib.asmdef": ("asset", "5", False), "Assets/Lib/In/s.cs": ("script", None, False),
        "Assets/Other/o.asmref": ("asset", None, False), "Assets/Other/t.cs": ("script", None, False), "Assets/Editor/u.cs": ("script", None, False),
        "Library/PackageCache/p/w.cs": ("asset", "6", True),
    }
    assert {(r.path, r.warning) for r in warned.collect()} == {("Assets/lost.mat.meta", "sidecar without owner"), ("Assets/c.png", "sidecar without guid")}
    # Sidecars with a known time aren't read again.
    files = spark.createDataFrame(files.collect(), files.schema)
    (tree / "Assets/_Game/a.prefab.meta").unlink()
    again, _ = project.scan(rows, str(tree), files)
    assert {(r.path, r.guid) for r in again.collect()} == {(r.path, r.guid) for r in files.collect()}


def test_paths_that_differ_in_case(spark, tmp_path):
    rows = spark.createDataFrame([("Assets/A.mat", False, 1, 1, 0, False), ("Assets/a.mat", False, 2, 1, 1, False)], project.LISTING)
    files, warned = project.scan(rows, str(tmp_path))
    assert [r.path for r in files.collect()] == ["Assets/A.mat"] and warned.count() == 1
    files, warned = project.scan(rows.limit(0), str(tmp_path))
    assert files.count() == warned.count() == 0


def test_assemblies(spark, tree):
    rows, _ = project.listing(spark, str(tree))
    files, _ = project.scan(rows, str(tree))
    texts = project.read_texts(files.where("path LIKE '%.asm%'"), str(tree))
    got = {(r.path, r.assembly) for r in project.assembly_units(files, texts).collect()}
    assert got == {("Assets/Lib/In/s.cs", "My.Lib"), ("Assets/Other/t.cs", "My.Lib"), ("Assets/Editor/u.cs", "Assembly-CSharp-Editor")}
    assert {(r.name, r.line_no) for r in project.assembly_refs(texts).collect()} == {("x.dll", 3), ("y.dll", 3)}
    (tree / "My.Lib.csproj").write_text('<Project xmlns="u"><P><DefineConstants>A;B, A</DefineConstants></P></Project>')
    (tree / "Bad.csproj").write_text("<")
    names = spark.createDataFrame([("My.Lib",), ("Bad",), ("None",)], "assembly string")
    modes = {r.assembly: (r["mode"], r.defines) for r in project.assembly_modes(names, str(tree)).collect()}
    assert modes == {"My.Lib": ("semantic", ["A", "B"]), "Bad": ("syntactic", []), "None": ("syntactic", [])}


def test_ui_paths(spark):
    texts = spark.createDataFrame([("a.uss", "@import \"x.uss\";\nb { c: url('y.png') }"), ("b.uxml", '<Style src="/z.uss"/>'), ("n", None)], "source_path string, text string")
    assert {tuple(r) for r in project.ui_path_refs(texts).collect()} == {("a.uss", "x.uss", 1), ("a.uss", "y.png", 2), ("b.uxml", "/z.uss", 1)}


def test_an_import_wins_its_line_and_guids_are_no_paths(spark):
    lines = ['@import "x.uss"; url(y.png)', "@import url('z.uss'); @import \"w.uss\";", "a: url(p.png) url(q.png)", '<I src="r.uxml?GUID=1&x"/> <J src="s.uxml"/>', '@import ""; url(t.png)']
    texts = spark.createDataFrame([("a", "\n".join(lines))], "source_path string, text string")
    got = sorted((r.line_no, r.raw) for r in project.ui_path_refs(texts).collect())
    assert got == [(1, "x.uss"), (2, "z.uss"), (3, "p.png"), (3, "q.png"), (4, "s.uxml")]


@pytest.mark.parametrize(
    "wanted, locked, data, status",
    [
        (None, None, False, ("not_detected", None)),
        (None, None, True, ("unconfirmed", None)),
        ("1.21.9", None, False, ("confirmed", "1.21.9")),
        ("1.21.9", "2.4.0", False, ("unconfirmed", "2.4.0")),
        ("file:../x", None, False, ("unconfirmed", "file:../x")),
    ],
)
def test_addressables(wanted, locked, data, status):
    manifest = wanted and json.dumps({"dependencies": {project.ADDRESSABLES: wanted}})
    lock = locked and json.dumps({"dependencies": {project.ADDRESSABLES: {"version": locked}}})
    assert project.addressables(manifest, lock, data) == status


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", None), ("a", "y", 2), ("b", "z", 3)], "target string, src string, line int")
    got = {r.target: json.loads(r.value) for r in outputs.answer_lines(rows, "target").collect()}
    assert got == {"a": [{"src": "x", "line": None}, {"src": "y", "line": 2}], "b": [{"src": "z", "line": 3}]}
    for n in range(3):
        outputs.append_history(spark, str(tmp_path / "h"), {"n": n})
    assert [json.loads(r.run)["n"] for r in outputs.read_history(spark, str(tmp_path / "h"), 2).collect()] == [2, 1]
    beat = str(tmp_path / "beat")
    assert not outputs.fresh(beat)
    outputs.beat(beat, "idle", 100)
    assert outputs.fresh(beat, 110) and not outputs.fresh(beat, 116)
