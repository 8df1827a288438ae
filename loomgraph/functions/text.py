"""Scalar functions over paths, serialized lines and symbol ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
NULL_GUID = "0" * 32
BUILTIN_GUIDS = ("0000000000000000e000000000000000", "0000000000000000f000000000000000")
HIDDEN_FILE_SUFFIX, HIDDEN_DIR_SUFFIX, HIDDEN_NAME = ".tmp", "~", "cvs"
INERT_ATTRIBUTES = ("Serializable", "Obsolete", "SerializeField", "Header", "Tooltip", "Range")
LABELS = ("speculative", "advisory", "proven")

#: Fixed values of the file format: references by guid, and the line that opens a document.
GUID_PATTERN = r"(?i)(?:guid\\?\"?\s*[:=]\s*\\?\"?|GUID:)([0-9a-f]{32})(?!\w)"
BOUNDARY_PATTERN = r"^--- !u!(\d+) &(-?\d+)( stripped)?"


def guids(line: Column) -> Column:
    """All guids that a serialized line refers to, lower-cased."""
    return F.transform(F.regexp_extract_all(line, F.lit(GUID_PATTERN), 1), F.lower)


def final_segment(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def source_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(final_segment(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(final_segment(path), r"(\.[^.]+)$", 1))


def fold_dots(path: Column) -> Column:
    """Drops empty and ``.`` segments; ``..`` takes the last kept one and never goes above the root."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
    )
    return F.array_join(folded, "/")


def normal_path(raw: Column, base_dir: Column) -> Column:
    """Project-relative path of a raw reference: cut at ``?`` or ``#``, rooted or relative, dots folded."""
    p = F.replace(F.regexp_replace(F.regexp_replace(raw, "[?#].*$", ""), "^project://database/", "/"), F.lit("\\"), F.lit("/"))
    rooted = p.rlike("^(/|Assets/|Packages/)")
    return fold_dots(F.when(rooted, p).otherwise(F.concat_ws("/", base_dir, p)))


def is_hidden(path: Column) -> Column:
    """Some segment is hidden: dot prefix, ``cvs``, folder ending ``~`` or file ending ``.tmp``."""
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    last = F.element_at(parts, -1)
    name = lambda s: F.startswith(s, F.lit(".")) | (s == HIDDEN_NAME)
    return F.exists(dirs, lambda s: name(s) | F.endswith(s, F.lit(HIDDEN_DIR_SUFFIX))) | name(last) | F.endswith(last, F.lit(HIDDEN_FILE_SUFFIX))


def under(path: Column, prefix: str) -> Column:
    """Whole-segment, case-insensitive prefix test; an empty prefix is an error, null is not under anything."""
    p = prefix.replace("\\", "/").strip("/").lower()
    if not p:
        raise ValueError("an empty prefix")
    return F.coalesce((F.lower(path) == p) | F.startswith(F.lower(path), F.lit(p + "/")), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored, case-insensitive regex: ``**`` any text, ``*`` and ``?`` within a segment."""
    import re

    out = ""
    for part in re.split(r"(\*\*|\*|\?)", pattern.replace("\\", "/")):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"(?i)^{out}$"


def assembly_of(path: Column) -> Column:
    """Predefined assembly of a script outside any definition file."""
    first = F.startswith(path, F.lit("Assets/Plugins/")) | F.startswith(path, F.lit("Assets/Standard Assets/"))
    editor = F.array_contains(F.split(source_dir(path), "/"), "Editor")
    return F.concat(F.lit("Assembly-CSharp"), F.when(editor, "-Editor").otherwise(""), F.when(first, "-firstpass").otherwise(""))


def trailing_identifier(doc_id: Column) -> Column:
    """Last identifier of a symbol id, without prefix and parameters."""
    bare = F.regexp_replace(F.regexp_replace(doc_id, "^[A-Z]:", ""), r"\(.*$", "")
    return F.regexp_extract(bare, r"([^.]*)$", 1)


def label(kind: Column, resolved: Column, builtin: Column, semantic: Column, own: Column) -> Column:
    """Confidence label of an edge; null where unresolved."""
    return (
        F.when(builtin, "proven").when(~resolved, None).when(kind.isin("guid", "path"), "proven")
        .when(kind == "cs", F.when(semantic, "proven").otherwise("advisory"))
        .when(kind.isin("event", "dll"), own).otherwise("advisory")
    )


def rank(lab: Column) -> Column:
    return F.when(lab == "proven", 2).when(lab == "advisory", 1).when(lab == "speculative", 0)


def unrank(r: Column) -> Column:
    return F.when(r == 2, "proven").when(r == 1, "advisory").when(r == 0, "speculative")


def weakest(lab: Column) -> Column:
    """Aggregate: weakest of proven and advisory labels; speculative only where it stands alone."""
    return F.coalesce(unrank(F.min(F.when(lab.isin("proven", "advisory"), rank(lab)))), F.max(F.when(lab == "speculative", lab)))


def context(line: Column, most: int = 160) -> Column:
    """A line as shown with a reference: trimmed, then cut."""
    return F.substring(F.trim(line), 1, most)


def is_cs_relevant(path: Column) -> Column:
    """Scripts and assembly definitions, by extension in any case."""
    return F.coalesce(path.rlike(r"(?i)\.(cs|asmdef|asmref)$"), F.lit(False))


def is_package_sourced(path: Column) -> Column:
    return F.coalesce(F.startswith(path, F.lit("Packages/")) | F.startswith(path, F.lit("LocalPackages/")), F.lit(False))


def of_kind(path: Column, kind: str) -> Column:
    """Filter of dead candidates: ``cs`` for scripts, ``assets`` for the rest, ``all``."""
    if kind not in ("assets", "cs", "all"):
        raise ValueError(f"no such kind: {kind}")
    script = F.endswith(F.lower(path), F.lit(".cs"))
    return F.lit(True) if kind == "all" else script if kind == "cs" else ~script


def without_cs_caveats(spots: Column, kinds: Column, caveats: tuple[str, ...]) -> Column:
    """Blind spots of an answer; those about scripts only if some edge of it is a script's or an event's."""
    return F.when(F.exists(kinds, lambda k: k.isin("cs", "event")), spots).otherwise(F.filter(spots, lambda s: ~s.isin(*caveats)))


def has_live_attribute(attrs: Column) -> Column:
    """Some attribute is not inert; no attributes (or null) have none."""
    return F.coalesce(F.exists(attrs, lambda a: ~a.isin(*INERT_ATTRIBUTES)), F.lit(False))


def attribute_names(attrs: Column) -> Column:
    """Names without the suffix Attribute, each once, joined by spaces; a bare suffix is a name."""
    return F.array_join(F.array_distinct(F.transform(attrs, lambda a: F.regexp_replace(a, "(?<=.)Attribute$", ""))), " ")


def is_prefab_override(classid: Column, property_path: Column) -> Column:
    return F.coalesce((classid == 1001) & F.startswith(property_path, F.lit("m_Modification.m_Modifications[")), F.lit(False))


def is_script_property(property_path: Column) -> Column:
    return F.coalesce((property_path == "m_Script") | F.endswith(property_path, F.lit(".m_Script")), F.lit(False))


def collision_warning(guid: Column, paths: Column, inline: int = 3) -> Column:
    """One line for a guid that several files claim: their paths, or beyond ``inline`` their number."""
    shown = F.array_join(F.array_sort(paths), ", ")
    return F.when(F.size(paths) <= inline, F.concat(F.lit("guid "), guid, F.lit(" is claimed by "), shown)).otherwise(F.concat(F.lit("guid "), guid, F.lit(" is claimed by "), F.size(paths).cast("string"), F.lit(" files")))


def name_order(name: str) -> list[Column]:
    """Sort keys: by lower case first, then as it is."""
    return [F.lower(name), F.col(name)]


def figures(count: Column, seconds: Column, size: Column) -> list[Column]:
    """A count with separators, seconds with one decimal, bytes as whole MB."""
    return [F.format_number(count, 0), F.concat(F.format_number(seconds, 1), F.lit(" s")), F.concat(F.format_number(size / (1 << 20), 0), F.lit(" MB"))]
