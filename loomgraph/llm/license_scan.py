"""License scans: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from loomgraph.llm.common import map_columns

#: Notices and grants of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    """ASCII letters and digits, lower-cased; every other byte parts words."""
    return raw.translate(_LOWER).split()


def bigrams(ws: list[bytes]) -> set:
    return set(zip(ws, ws[1:]))


class Scanner:
    """Templates by size. A unit of n bigrams can reach Dice t only with sizes from t/(2-t)*n to (2-t)/t*n."""

    def __init__(self, templates=None, threshold=THRESHOLD):
        self.t = threshold
        rows = sorted(((bigrams(normal_words(x.encode())), k) for k, x in (templates or TEMPLATES).items()), key=lambda r: (len(r[0]), r[1]))
        self.rows = [r for r in rows if r[0]]
        self.sizes = [len(r[0]) for r in self.rows]
        of = {k: normal_words(x.encode()) for k, x in (templates or TEMPLATES).items()}
        self.width = {k: len(of[k]) - 1 for _, k in self.rows}  # bigrams of a window
        self.known: dict[tuple, list[str]] = {}
        for b, k in self.rows:
            for x in b:
                self.known.setdefault(x, []).append(k)
        self.low = self.sizes[0] * threshold / (2 - threshold) if self.rows else float("inf")

    def best(self, raw: bytes):
        """(Dice, template) of the best template at or above the threshold, ties to the smaller name."""
        ws = normal_words(raw)
        if len(ws) - 1 < self.low:
            return None
        own = bigrams(ws)
        n, r = len(own), self.t / (2 - self.t)
        out = None
        for i in range(bisect_left(self.sizes, n * r - 1e-9), bisect_right(self.sizes, n / r + 1e-9)):
            ref, name = self.rows[i]
            dice = 2.0 * len(own & ref) / (n + self.sizes[i])
            if dice >= self.t and (out is None or (-dice, name) < (-out[0], out[1])):
                out = (dice, name)
        return out

    def windows(self, ws: list[bytes]):
        """(common, Dice, licence, first word, end) of windows of a template's length that reach the threshold.

        Windows start at a bigram of the template (or end with the text): one that starts before
        holds no more of them. Those with too few of its bigrams are never built.
        """
        known, places = self.known, {}
        for i, x in enumerate(zip(ws, ws[1:])):
            if x in known:
                for k in known[x]:
                    places.setdefault(k, []).append(i)
        out = []
        for ref, name in self.rows:
            at, need = places.get(name, ()), len(ref) * self.t / (2 - self.t) - 1e-9
            if len(at) < need:
                continue
            width = self.width[name]
            starts = sorted({max(0, min(i, len(ws) - 1 - width)) for i in at})
            for i in starts:
                if bisect_left(at, i + width) - bisect_left(at, i) < need:
                    continue
                own = bigrams(ws[i : i + width + 1])
                common = len(own & ref)
                dice = 2.0 * common / (len(own) + len(ref))
                if dice >= self.t:
                    out.append((common, dice, name, i, min(len(ws), i + width + 1)))
        return out

    def scan(self, text: str | None):
        """Hits as (kind, index, licence, Dice): every line, paragraph of two lines or more, the whole text if it has several paragraphs.

        Then windows, by their first word, that touch none of these hits or of the windows taken
        before: those with more of their template first, then the higher Dice.
        """
        raw = (text or "").encode("utf-8", "replace")
        hits, taken = [], []
        paragraphs = re.split(rb"\n[ \t\r]*\n", raw)
        units = [("line", i, x) for i, x in enumerate(raw.split(b"\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(paragraphs) if b"\n" in x]
        if len(paragraphs) > 1:
            units.append(("text", 0, raw))
        for kind, i, x in units:
            if (b := self.best(x)) is not None:
                hits.append((kind, i, b[1], b[0]))
        found = self.windows(normal_words(raw))
        if found and hits:
            where = {"line": _ranges(raw.split(b"\n")), "paragraph": _ranges(paragraphs), "text": _ranges([raw])}
            taken = [where[kind][i] for kind, i, _, _ in hits]
        for common, dice, name, lo, hi in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if all(hi <= a or b <= lo for a, b in taken):
                taken.append((lo, hi))
                hits.append(("window", lo, name, dice))
        return hits


def _ranges(parts: list[bytes]) -> list[tuple[int, int]]:
    """Places of each part's words among all words."""
    ends = list(accumulate(len(normal_words(x)) for x in parts))
    return list(zip([0, *ends], ends))


def scan(docs: DataFrame, templates=None, threshold=THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_hits, license and dice of its best hit (null: none), hits.

    Whole texts, unit by unit, then windows of each template's length slid over the text; null and empty texts have no hits, very long texts go as a whole like all others. Equal scores go to the smaller
    licence name. Repeated rows give repeated results; other columns are ignored.
    """
    scanner = Scanner(templates, threshold)

    def run(texts):
        found = [scanner.scan(x) for x in texts.to_pylist()]
        best = [min(((-h[3], h[2]) for h in hs), default=(None, None)) for hs in found]
        return (
            [len(h) for h in found], [b[1] for b in best], [None if b[0] is None else -b[0] for b in best],
            [[{"unit": k, "at": i, "license": n, "dice": d} for k, i, n, d in h] for h in found],
        )

    return map_columns(docs, ["doc_id"], ["text"], run, "n_hits int, license string, dice double, hits array<struct<unit:string,at:int,license:string,dice:double>>")


def op7(spark, sf_dir):
    from loomgraph.llm.common import table

    return scan(table(spark, sf_dir, "documents")).drop("hits")


def _values() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return f"(VALUES {rows}) AS t(license, body)"


def _bigram_sql(text: str) -> str:
    clean = f"list_filter(string_split(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {clean} AS w))"


SQL = f"""
WITH tpl AS (SELECT license, {_bigram_sql('body')} AS b FROM {_values()}),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents
  UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS p FROM documents) WHERE contains(p, chr(10))
  UNION ALL SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')),
sized AS (SELECT doc_id, row_number() OVER () AS k, {_bigram_sql('u')} AS b FROM units),
scored AS (SELECT s.doc_id, s.k, t.license, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sized s JOIN tpl t ON len(s.b) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(t.b) - 1e-9 AND {(2 - THRESHOLD) / THRESHOLD} * len(t.b) + 1e-9),
hits AS (SELECT doc_id, k, min((-dice, license)) AS b FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, k),
best AS (SELECT doc_id, count(*)::INTEGER AS n_hits, min(b) AS b FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_hits, 0)::INTEGER AS n_hits, b[2] AS license, -b[1] AS dice
FROM documents d LEFT JOIN best USING (doc_id)
"""
