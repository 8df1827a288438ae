"""Parsing of serialized texts into reference rows: line by line in SQL, or in order within a file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.tables import table

LOOKAHEAD = 8
REFS = "source_path string, target_guid string, line int, class_id int, file_id string, method_name string, target_type string, property_path string"


def lines(texts: DataFrame) -> DataFrame:
    """(source_path, line_no, line) of texts, with any line ending."""
    return texts.select("source_path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line")).select("source_path", (F.col("at") + 1).alias("line_no"), "line")


def guid_lines(texts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(source_path, guid, line_no) of every guid reference; null guids and references to itself are dropped."""
    found = lines(texts).select("source_path", "line_no", F.explode(T.guids(F.col("line"))).alias("guid")).where(F.col("guid") != T.NULL_GUID)
    if own is not None:
        found = found.join(own.select(F.col("path").alias("source_path"), "guid"), ["source_path", "guid"], "left_anti")
    return found


class PropertyPath:
    """Dotted path of the current line from indentation; sequence items are ``[i]``, a document's root key is left out."""

    def __init__(self):
        self.stack: list[list] = []  # [indent, name, items seen]

    def reset(self):
        self.stack = []

    def feed(self, line: str) -> str | None:
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if not body or body[0] in "#%":
            return None
        item = body.startswith("- ") or body == "-"
        while self.stack and (self.stack[-1][0] > indent or self.stack[-1][0] == indent and not (item and self.stack[-1][2] >= -1 and not self.stack[-1][1].startswith("["))):
            if item and self.stack[-1][0] == indent and self.stack[-1][1].startswith("["):
                self.stack.pop()
                break
            self.stack.pop()
        if item:
            if self.stack:
                self.stack[-1][2] += 1
                self.stack.append([indent, f"[{self.stack[-1][2]}]", -1])
            body, indent = body[2:], indent + 2
        m = re.match(r"([^:{\[\"']+):(\s|$)", body)
        if m:
            self.stack.append([indent, m[1].strip(), -1])
        names = [n for _, n, _ in self.stack[1:]]
        path = ""
        for n in names:
            path += n if n.startswith("[") or not path else f".{n}"
        return path[:200] or None


_GUID = re.compile(T.GUID_PATTERN)
_HEAD = re.compile(T.BOUNDARY_PATTERN)
_METHOD, _TYPE = re.compile(r"^\s*m_MethodName:\s*(\S+)"), re.compile(r"^\s*m_TargetAssemblyTypeName:\s*([^,]+?)\s*(?:,|$)")


def parse_yaml(path: str, text: str) -> list[tuple]:
    """Reference rows of one text, in order: documents, property paths and the bounded lookahead after ``m_Target``."""
    rows, doc, tracker = [], (None, None), PropertyPath()
    all_lines = re.split("\r\n|\r|\n", text or "")
    for i, line in enumerate(all_lines):
        if m := _HEAD.match(line):
            doc = (int(m[1]), m[2])
            tracker.reset()
            continue
        where = tracker.feed(line)
        if re.match(r"^\s*m_GUID:", line):
            continue
        found = [g.lower() for g in _GUID.findall(line) if g != T.NULL_GUID]
        method = kind = None
        if "m_Target:" in line:
            for ahead in all_lines[i + 1 : i + 1 + LOOKAHEAD]:
                if "m_Target:" in ahead or _HEAD.match(ahead):
                    break
                method = method or ((m := _METHOD.match(ahead)) and m[1]) or None
                kind = kind or ((m := _TYPE.match(ahead)) and m[1]) or None
        rows += [(path, g, i + 1, *doc, method, kind, where) for g in found]
        if not found and method:  # a binding to an object of the same file
            rows.append((path, None, i + 1, *doc, method, kind, where))
    return rows


def yaml_refs(texts: DataFrame) -> DataFrame:
    """Reference rows of (source_path, text); one file is one row, so files parse independently."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["source_path"], pdf["text"]) for r in parse_yaml(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFS.split(", ")])

    return texts.select("source_path", "text").mapInPandas(run, REFS)


def order_texts(spark, d: str) -> DataFrame:
    """A serialized text for every order: a document, a list of parts by line, one event binding."""
    k = F.concat(F.lit("Part/"), F.col("l_partkey").cast("string"))
    item = F.concat(F.lit("  - part: {fileID: 11, guid: "), F.md5(k.cast("binary")), F.lit(", type: 3}"))
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("t")))).alias("x"))
    body = F.concat(
        F.array(F.concat(F.lit("--- !u!114 &"), F.col("l_orderkey").cast("string")), F.lit("MonoBehaviour:"), F.lit("  m_Parts:")),
        F.transform("x", lambda r: r["t"]),
        F.array(F.lit("  m_Calls:"), F.lit("  - m_Target: {fileID: 5}"), F.lit("    m_TargetAssemblyTypeName: Game.Door, Game"), F.lit("    m_MethodName: Open")),
    )
    return parts.select(F.concat(F.lit("Order/"), F.col("l_orderkey").cast("string")).alias("source_path"), F.array_join(body, "\n").alias("text"))
