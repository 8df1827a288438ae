"""A project on disk as DataFrames: discovery, configuration, inventory with sidecars, packages, assemblies.

The listing is made on the driver, as links have to be followed and told apart by their real path,
and Spark's own file index leaves out names that begin with an underscore. It holds names, times
and sizes alone; contents are read by the executors, from the folder that all of them share.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T

# Fixed values
VERSION_FILE = "ProjectSettings/ProjectVersion.txt"
SETTINGS_FILE = "ProjectSettings/EditorSettings.asset"
ROOTS = ("Assets", "Packages", "LocalPackages", "ProjectSettings")
PACKAGE_CACHE = "Library/PackageCache"
EXCLUDED_DIRS = ("Library", "Temp", "Obj", "obj", "Logs", ".git", ".plastic", ".svn", ".vs", ".idea", ".collab", ".loomgraph")
YAML_EXTENSIONS = (
    "prefab unity asset mat anim controller overridecontroller physicmaterial physicsmaterial2d mixer flare fontsettings guiskin "
    "rendertexture spriteatlas terrainlayer brush playable mask preset shadervariants lighting giparams cubemap"
).split()
JSON_EXTENSIONS = "shadergraph vfx shadersubgraph asmdef asmref".split()
UI_EXTENSIONS = "uxml uss tss".split()
CONFIG_KEYS = ("roots", "excludeDirs", "dbPath", "liveness", "watch")
ADDRESSABLES = "com.unity.addressables"
ADDRESSABLES_DATA = "Assets/AddressableAssetsData"
CONFIRMED = ("1.21", "2.3", "2.8")

LISTING = "path string, is_dir boolean, mtime bigint, size bigint, place bigint, identity_only boolean"


class NotForceText(ValueError):
    """The project isn't serialized as text, or that can't be told."""


@dataclass(frozen=True)
class Config:
    roots: tuple[str, ...] = ROOTS
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    db_path: str | None = None
    allowlist: tuple[str, ...] = ()
    auto_start: bool | None = None


def find_root(start: str) -> str | None:
    """The nearest folder at or above ``start`` that holds a version file."""
    at = os.path.abspath(start)
    while not os.path.isfile(os.path.join(at, VERSION_FILE)):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return at


def _content(root: str, name: str) -> str | None:
    try:
        with open(os.path.join(root, name), encoding="utf-8-sig", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def editor_version(root: str) -> str | None:
    found = re.search(r"(?m)^m_EditorVersion:\s*(\S+)\s*$", _content(root, VERSION_FILE) or "")
    return found and found[1]


def require_force_text(root: str) -> None:
    """Raises unless the settings say that assets are serialized as text."""
    content = _content(root, SETTINGS_FILE)
    if content is None:
        raise NotForceText(f"{SETTINGS_FILE} is missing or unreadable")
    if not re.search(r"(?m)^\s*m_SerializationMode:\s*2\s*$", content):
        raise NotForceText("assets are not serialized as text")


def load_config(text: str | None) -> tuple[Config, list[str]]:
    """Configuration from JSON text, and warnings. Values of a wrong type keep their default."""
    if text is None:
        return Config(), []
    try:
        raw = json.loads(text)
    except ValueError as e:
        return Config(), [f"not valid JSON ({e}); using defaults"]
    if not isinstance(raw, dict):
        return Config(), ["not an object; using defaults"]
    known = {k.lower() for k in CONFIG_KEYS}
    warnings = [f"unknown key '{k}' (ignored)" for k in raw if k.lower() not in known]
    take = {}
    for key, name in (("roots", "roots"), ("excludeDirs", "exclude_dirs")):
        if isinstance(raw.get(key), list):
            take[name] = tuple(x for x in raw[key] if isinstance(x, str))
    if isinstance(raw.get("dbPath"), str):
        take["db_path"] = raw["dbPath"]
    inner = lambda k: raw[k] if isinstance(raw.get(k), dict) else {}
    if isinstance(inner("liveness").get("allowlist"), list):
        take["allowlist"] = tuple(x for x in raw["liveness"]["allowlist"] if isinstance(x, str))
    if isinstance(inner("watch").get("autoStart"), bool):
        take["auto_start"] = raw["watch"]["autoStart"]
    return Config(**take), warnings


def listing(spark: SparkSession, root: str, config: Config = Config()) -> tuple[DataFrame, list[str]]:
    """Files and folders below the roots and the package cache, links followed, each real folder once."""
    rows, warnings, seen = [], [], set()
    skip = {d.lower() for d in config.exclude_dirs}
    stack = [(r, identity) for r, identity in [(PACKAGE_CACHE, True), *((r, False) for r in reversed(config.roots))]]
    while stack:
        rel, identity = stack.pop()
        real = os.path.realpath(os.path.join(root, rel))
        if real in seen or not os.path.isdir(real):
            continue
        seen.add(real)
        below = []
        for entry in sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name):
            path = f"{rel}/{entry.name}"
            if not os.path.exists(entry.path):
                warnings.append(f"dangling link '{path}'")
                continue
            is_dir, stat = entry.is_dir(), entry.stat()
            if is_dir and entry.name.lower() in skip:
                continue
            rows.append((path, is_dir, stat.st_mtime_ns, 0 if is_dir else stat.st_size, len(rows), identity))
            if is_dir:
                below.append((path, identity))
        stack += reversed(below)
    return spark.createDataFrame(rows, LISTING), warnings


def read_texts(paths: DataFrame, root: str) -> DataFrame:
    """(source_path, text) of each ``path``, read by the executors; a file that can't be read has a null text."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for path in pdf["path"]:  # a file at a time: only its own text is held
                yield pd.DataFrame({"source_path": [path], "text": pd.Series([_content(root, path)], dtype="object")})

    return paths.select("path").mapInPandas(run, "source_path string, text string")


def kind_of(path: Column, has_meta: Column) -> Column:
    """script, settings or asset; null for files that aren't part of the graph."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    settings = (ext == "asset") & F.startswith(F.lower(path), F.lit("projectsettings/"))
    known = ext.isin(YAML_EXTENSIONS + JSON_EXTENSIONS + UI_EXTENSIONS)
    return F.when(ext == "cs", "script").when(settings, "settings").when(known | has_meta, "asset")


def _visible(rows: DataFrame) -> DataFrame:
    """Without hidden rows; a sidecar is hidden with its owner, be that a file or a folder."""
    owner = F.regexp_replace("path", "(?i)\\.meta$", "")
    as_file, as_folder = T.is_hidden(owner), T.is_hidden(F.concat("path", F.lit("/x")))
    either = as_file | F.endswith(owner, F.lit("~"))
    return rows.where(~F.when(F.col("is_dir"), as_folder).when(owner != F.col("path"), either).otherwise(as_file))


def scan(rows: DataFrame, root: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The inventory of a listing, and its warnings as (path, warning).

    Inventory: path, kind, guid, mtime, size, meta_mtime, identity_only. Of paths that differ in case
    alone the first of the listing stays. ``known`` (path, meta_mtime, guid) is an earlier inventory:
    a sidecar whose time is the same there isn't read again. Cached packages give identities only.
    A listing narrowed to some paths (and their sidecars) gives the same rows for these.
    """
    folded = F.lower("path").alias("folded")
    grouped = _visible(rows).groupBy(folded).agg(F.min_by(F.struct(*rows.columns), "place").alias("r"), F.count("*").alias("n"))
    one = grouped.select("folded", "n", "r.*")
    is_meta = F.endswith("folded", F.lit(".meta")) & ~F.col("is_dir")
    owners = one.where(~is_meta)
    metas = one.where(is_meta).select(F.regexp_replace("folded", "\\.meta$", "").alias("folded"), F.col("path").alias("meta_path"), F.col("mtime").alias("meta_mtime"))
    pairs = owners.join(metas, "folded", "left")
    if known is None:
        pairs = pairs.withColumns({"same": F.lit(False), "known_guid": F.lit(None).cast("string")})
    else:
        old = known.select(F.lower("path").alias("folded"), F.col("meta_mtime").alias("known_mtime"), F.col("guid").alias("known_guid"))
        pairs = pairs.join(old, "folded", "left").withColumn("same", F.coalesce(F.col("known_mtime") == F.col("meta_mtime"), F.lit(False)))
    fresh = read_texts(pairs.where("meta_path IS NOT NULL AND NOT same").select(F.col("meta_path").alias("path")), root)
    found = F.lower(F.regexp_extract("text", r"(?m)^guid:\s*([0-9a-fA-F]{32})\s*$", 1))
    fresh = fresh.select(F.col("source_path").alias("meta_path"), F.when(found != "", found).alias("read_guid"))
    full = pairs.join(fresh, "meta_path", "left").withColumn("guid", F.when(F.col("same"), F.col("known_guid")).otherwise(F.col("read_guid")))
    has_meta = F.col("meta_path").isNotNull()
    kind = F.when(F.col("is_dir"), F.when(has_meta, "folder")).when(F.col("identity_only"), F.when(has_meta, "asset")).otherwise(kind_of(F.col("path"), has_meta))
    files = full.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "kind", "guid", "mtime", "size", "meta_mtime", "identity_only")
    warned = lambda df, message: df.select("path", F.lit(message).alias("warning"))
    warnings = (
        warned(one.where("n > 1"), "differs from another path in case alone")
        .unionByName(warned(metas.join(owners, "folded", "left_anti").select(F.col("meta_path").alias("path")), "sidecar without owner"))
        .unionByName(warned(full.where("meta_path IS NOT NULL AND guid IS NULL AND NOT same"), "sidecar without guid"))
    )
    return files, warnings


# Fixed values of the file formats: paths in style sheets and layouts
STYLE_IMPORT = r"""@import\s+(?:"([^"]*)"|url\(\s*['"]?([^'")]+)['"]?\s*\))"""
STYLE_URL = r"""url\(\s*['"]?([^'")]+)['"]?\s*\)"""
LAYOUT_SRC = r'\bsrc="([^"]*)"'


def ui_path_refs(texts: DataFrame) -> DataFrame:
    """(source_path, raw, line_no) of the path references in style sheets and layouts, each once a line.

    The first import of a line is all that the line gives. Paths with ``guid=`` are references by guid, not by path.
    """
    from loomgraph.operators.parse import lines

    imported = F.concat(*[F.regexp_extract("line", STYLE_IMPORT, k) for k in (1, 2)])  # the group that is not met is empty
    others = F.concat(*[F.regexp_extract_all("line", F.lit(f), 1) for f in (STYLE_URL, LAYOUT_SRC)])
    every = F.when(F.col("line").rlike(STYLE_IMPORT), F.array(imported)).otherwise(F.array_distinct(others))
    found = lines(texts).select("source_path", F.explode(every).alias("raw"), "line_no")
    return found.where((F.trim("raw") != "") & ~F.lower("raw").contains("guid="))


def precompiled_names(text: str) -> list[tuple[str, int]]:
    """(name, line) of the strings in ``precompiledReferences`` arrays; line endings may be of any kind."""
    text = re.sub(r"\r\n?", "\n", text)
    out, at = [], 0
    while key := re.compile(r'"precompiledReferences"', re.I).search(text, at):
        stop = text.find("\n", key.end())
        stop = len(text) if stop < 0 else stop
        bracket = text.find("[", key.end(), stop)
        start = bracket + 1 if bracket >= 0 else stop
        close = text.find("]", start)
        end = len(text) if close < 0 else close
        for name in re.finditer(r'"([^"\n]*)"', text[start:end]):
            if name[1].strip():
                out.append((name[1].strip(), text.count("\n", 0, start + name.start()) + 1))
        at = max(end, key.end())
    return out


def assembly_refs(texts: DataFrame) -> DataFrame:
    """(source_path, raw, name, line_no) of library references in assembly definitions; ``name`` is a lower-case file name."""

    def run(batches):
        for pdf in batches:
            rows = [(p, raw, raw.replace("\\", "/").rsplit("/", 1)[-1].lower(), line) for p, t in zip(pdf["source_path"], pdf["text"]) if isinstance(t, str) for raw, line in precompiled_names(t)]
            yield pd.DataFrame(rows, columns=["source_path", "raw", "name", "line_no"])

    return texts.select("source_path", "text").mapInPandas(run, "source_path string, raw string, name string, line_no int")


def assembly_units(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, assembly) of every script: its nearest definition or reference file, else the predefined assembly.

    A definition's name is its ``name``, else its file's stem; invalid JSON defines nothing. A reference
    names its target, or its guid after ``GUID:``; in one folder the definition wins.
    """
    own = files.where("NOT identity_only")
    told = texts.select(F.col("source_path").alias("path"), F.from_json("text", "name string, reference string").alias("j"), F.get_json_object("text", "$").isNotNull().alias("valid"))
    joined = own.join(told.where("valid"), "path").withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    name = F.when(F.trim(F.col("j.name")) != "", F.col("j.name")).otherwise(T.stem(F.col("path")))
    defs = joined.where("ext = 'asmdef'").select(T.source_dir(F.col("path")).alias("dir"), name.alias("assembly"), "guid", F.lit(0).alias("rank"))
    token = F.col("j.reference")
    refs = joined.where("ext = 'asmref'").where(F.length(token) > 0).select(T.source_dir(F.col("path")).alias("dir"), token.alias("token"))
    wanted = F.when(F.startswith(F.upper("token"), F.lit("GUID:")), F.lower(F.substring("token", 6, 1000)))
    by_guid = defs.where("guid IS NOT NULL").select(F.lower("guid").alias("wanted"), F.col("assembly").alias("named")).dropDuplicates(["wanted"])
    refs = refs.withColumn("wanted", wanted).join(by_guid, "wanted", "left").select("dir", F.coalesce("named", "token").alias("assembly"), F.lit(1).alias("rank"))
    places = defs.drop("guid").unionByName(refs).groupBy(F.lower("dir").alias("folder")).agg(F.min_by("assembly", F.struct("rank", "assembly")).alias("assembly"))
    scripts = own.where("kind = 'script'").select("path")
    # Every folder above a script, nearest first: one row a level, joined by equality.
    parts = F.split(F.lower(T.source_dir(F.col("path"))), "/")
    above = scripts.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "folder"))
    nearest = above.join(places, "folder").groupBy("path").agg(F.max_by("assembly", "depth").alias("assembly"))
    return scripts.join(nearest, "path", "left").select("path", F.coalesce("assembly", T.assembly_of(F.col("path"))).alias("assembly"))


def project_mode(text: str | None, exists) -> tuple[str, list[str], list[str], str | None]:
    """(mode, defines, references, reason) of a project file's text; ``exists`` tells whether a hint path does."""
    if text is None:
        return "syntactic", [], [], "no project file"
    try:
        tree = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return "syntactic", [], [], "project file can't be parsed"
    space = tree.tag[: tree.tag.index("}") + 1] if tree.tag.startswith("{") else ""
    defines = dict.fromkeys(d.strip() for e in tree.iter(f"{space}DefineConstants") for d in re.split("[;,]", e.text or "") if d.strip())
    hints = [(r.findtext(f"{space}HintPath") or "").replace("\\", "/") for r in tree.iter(f"{space}Reference")]
    references = [h for h in hints if h.strip() and exists(h)]
    if not defines and not references:
        return "syntactic", [], [], "project file has neither defines nor references"
    return "semantic", list(defines), references, None


def assembly_modes(names: DataFrame, root: str) -> DataFrame:
    """(assembly, mode, defines, refs, reason) by each assembly's project file below ``root``."""

    def run(batches):
        for pdf in batches:
            rows = [(n, *project_mode(_content(root, f"{n}.csproj"), lambda h: os.path.isfile(os.path.join(root, h)))) for n in pdf["assembly"]]
            yield pd.DataFrame(rows, columns=["assembly", "mode", "defines", "refs", "reason"])

    return names.select("assembly").distinct().mapInPandas(run, "assembly string, mode string, defines array<string>, refs array<string>, reason string")


def addressables(manifest: str | None, lock: str | None, data_present: bool) -> tuple[str, str | None]:
    """(not_detected, confirmed or unconfirmed; version): the lock's version goes before the manifest's."""

    def dependencies(text):
        try:
            found = json.loads(text or "")["dependencies"]
        except (ValueError, KeyError, TypeError):
            return {}
        return found if isinstance(found, dict) else {}

    wanted, locked = dependencies(manifest), dependencies(lock).get(ADDRESSABLES)
    if ADDRESSABLES not in wanted and not data_present:
        return "not_detected", None
    version = locked.get("version") if isinstance(locked, dict) else None
    version = version if isinstance(version, str) else wanted.get(ADDRESSABLES)
    version = version if isinstance(version, str) else None
    leading = re.match(r"(\d+)\.(\d+)", version or "")
    confirmed = leading is not None and f"{int(leading[1])}.{int(leading[2])}" in CONFIRMED
    return ("confirmed" if confirmed else "unconfirmed"), version


def project_addressables(files: DataFrame, root: str) -> tuple[str, str | None]:
    """Addressables of a project: its package files, and whether anything lies in the data folder."""
    present = bool(files.where(T.under(F.col("path"), ADDRESSABLES_DATA)).take(1))
    return addressables(_content(root, "Packages/manifest.json"), _content(root, "Packages/packages-lock.json"), present)


def is_convention(path: Column) -> Column:
    """Files that tools find by name, so that no reference to them is to be expected."""
    low = F.lower(path)
    name = F.regexp_extract(low, "([^/]*)$", 1)
    return name.rlike(r"\.asm(def|ref)$") | name.isin("link.xml", "csc.rsp", "package.json") | (low == "packages/manifest.json")


def root_reason(path: Column) -> Column:
    """Why a file is a root of liveness by its place; null if it isn't."""
    low = F.lower(path)
    return (
        F.when(F.startswith(low, F.lit("projectsettings/")), "settings")
        .when(F.contains(low, F.lit("/resources/")) | F.startswith(low, F.lit("resources/")), "resources")
        .when(F.startswith(low, F.lit("assets/streamingassets/")), "streaming assets")
    )
