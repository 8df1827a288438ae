"""Removal of byte strings of 50 or more that repeat across documents, by families of suffix arrays.

Suffixes are indexed at content-defined anchors: of the 20-byte strings in each 50-byte window the
one of least hash, so equal windows have equal anchors wherever they lie. An anchor's context holds
every window that it stands for. Anchors are dealt to shards by their hash:

1. contexts that recur whole, by 64 bits of the anchor's and 64 of the context's hash, are covered
   but for the smallest doc_id's (within a task before anything moves, then within a shard);
2. for anchors that occur in several contexts, the first of each is fetched as bytes. A shard takes
   them in batches by doc_id; each batch gets a suffix array of its windows, is merge-scanned
   against the levels of the index, and becomes a level itself; levels of one size merge. Windows of
   an anchor with more than ``HOT`` contexts don't meet in one shard but one by one, by their bytes;
3. covered spans are merged per document and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_columns, materialize, row_key, table

SPAN, KMER = 50, 20
WINDOW = SPAN - KMER + 1
#: Bytes of text for one shard, bytes that a task gathers before it emits, bytes looked at together, windows of a batch.
SHARD_BYTES, FLUSH_BYTES, PIECE, BATCH = 1 << 20, 12 << 20, 1 << 20, 1 << 16
#: Contexts of one anchor that one shard takes.
HOT = 1 << 14
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(raw: bytes):
    """Positions and hashes of the anchors of all 50-byte windows."""
    n = len(raw)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - KMER + 1
    v = np.ndarray((n - 7,), "<u8", buffer=raw, strides=(1,)).astype(np.uint64)
    h = _mix(v[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(v[8 : 8 + m]) * np.uint64(0x165667B19E3779F9) + v[12 : 12 + m] * np.uint64(0xA0761D6478BD642F))
    low = _slide(h, WINDOW, np.minimum)
    zero = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([zero, low, zero]), WINDOW, np.maximum) == h)
    return at, h[at]


def contexts(raw: bytes, at: np.ndarray):
    """(lo, hi, hash) of each anchor's context: the bytes of the windows that it can stand for."""
    n = len(raw)
    lo, hi = np.maximum(at - WINDOW + 1, 0), np.minimum(at + SPAN, n)
    up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * up[:n])])
        own = (total[hi] - total[lo]) * down[lo]
        return lo, hi, _mix(own + (at - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (hi - at).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def postings(raw: bytes, piece: int = PIECE):
    """(at, hash of the anchor, lo, hi, hash of the context) of all anchors, a piece of the text at a time."""
    out = []
    for a in range(0, max(1, len(raw) - SPAN + 1), piece):
        # Anchors depend on no more than the bytes of two windows around them.
        start = max(0, a - 2 * SPAN)
        part = raw[start : a + piece + 2 * SPAN]
        at, h = anchors(part)
        own = (at + start >= a) & (at + start < a + piece)
        at, h = at[own], h[own]
        lo, hi, ctx = contexts(part, at)
        out.append((at + start, h, lo + start, hi + start, ctx))
    return tuple(np.concatenate(x) for x in zip(*out))


_ROW = np.dtype([("kmer", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("lo", "<i4"), ("hi", "<i4")])


def pack(rows: np.ndarray) -> bytes:
    """Rows by column, in document order, each column as differences: half the size of rows once compressed."""
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]  # a shard's part of a task's rows
    back, ahead = (rows["at"] - rows["lo"]).astype(np.uint8), (rows["hi"] - rows["at"]).astype(np.uint8)
    doc, at = np.diff(rows["doc"], prepend=0), np.diff(rows["at"], prepend=0).astype("<i4")
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(rows), -1).T.tobytes() for x in (doc.astype("<i8"), at)]
    return b"".join([rows["kmer"].tobytes(), rows["ctx"].tobytes(), *planes, back.tobytes(), ahead.tobytes()])


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 30
    rows = np.empty(n, _ROW)
    part = lambda k, w: np.frombuffer(blob, np.uint8, n * w, n * k)
    rows["kmer"], rows["ctx"] = part(0, 8).view("<u8"), part(8, 8).view("<u8")
    rows["doc"] = np.cumsum(np.ascontiguousarray(part(16, 8).reshape(8, n).T).view("<i8").ravel())
    rows["at"] = np.cumsum(np.ascontiguousarray(part(24, 4).reshape(4, n).T).view("<i4").ravel())
    rows["lo"], rows["hi"] = rows["at"] - part(28, 1), rows["at"] + part(29, 1)
    return rows


def _firsts(rows: np.ndarray):
    """Of rows sorted by (kmer, ctx, doc): which belong to their context's smallest document."""
    order = np.lexsort((rows["at"], rows["doc"], rows["ctx"], rows["kmer"]))
    rows = rows[order]
    head = np.r_[True, (rows["kmer"][1:] != rows["kmer"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1])]
    least = rows["doc"][np.flatnonzero(head)][np.cumsum(head) - 1]
    return rows, rows["doc"] == least, head


class Family:
    """Index of all strings of earlier batches: sorted levels, at most one of each size, merged in pairs."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def scan(self, sorted_keys: np.ndarray) -> np.ndarray:
        """Which of the sorted keys some level holds; both sides are sorted, so it goes through either once."""
        found = np.zeros(len(sorted_keys), bool)
        for level in self.levels:
            i = np.minimum(np.searchsorted(level, sorted_keys), len(level) - 1)
            found |= level[i] == sorted_keys
        return found

    def add(self, sorted_keys: np.ndarray) -> None:
        level = sorted_keys
        while self.levels and len(self.levels[-1]) < 2 * len(level):
            both = np.concatenate([self.levels.pop(), level])
            both.sort(kind="stable")  # merges: that sort finds the two runs
            level = both[np.r_[True, both[1:] != both[:-1]]]
        self.levels.append(level)


def windows(raw: list, lo: np.ndarray, at: np.ndarray):
    """(context, start, key) of the 50-byte windows of contexts that hold their anchor; a last byte keeps trailing zeros."""
    size = np.array([len(r) for r in raw])
    n = np.minimum(size - SPAN, at - lo) + 1
    wide = np.zeros((len(raw), SPAN + WINDOW), np.uint8)
    wide[np.arange(wide.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    which, k = np.nonzero(np.arange(WINDOW) < n[:, None])
    grid = np.ones((len(which), SPAN + 1), np.uint8)
    grid[:, :SPAN] = np.lib.stride_tricks.sliding_window_view(wide, SPAN, axis=1)[which, k]
    return which, lo[which] + k, grid.view(f"S{SPAN + 1}").ravel()


def covered(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, raw: list, batch: int = BATCH):
    """(doc, start) of windows that also start in a smaller document, of contexts given by document."""
    family, out = Family(), []
    order = np.argsort(doc, kind="stable")
    doc, at, lo = doc[order], at[order], lo[order]
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    k = 0
    while k < len(doc):
        # About a batch of windows; a document is never split.
        stop = np.searchsorted(new, k + max(1, batch // WINDOW))
        stop = int(new[stop]) if stop < len(new) else len(doc)
        which, start, key = windows([raw[i] for i in order[k:stop]], lo[k:stop], at[k:stop])
        own, k = doc[k:stop][which], stop
        if not len(own):
            continue
        suffixes = np.argsort(key, kind="stable")  # within a key by document, as the contexts are
        start, key, own = start[suffixes], key[suffixes], own[suffixes]
        head = np.r_[True, key[1:] != key[:-1]]
        least = own[np.flatnonzero(head)][np.cumsum(head) - 1]
        old = family.scan(key[head])
        hit = (own > least) | old[np.cumsum(head) - 1]
        out.append((own[hit], start[hit]))
        family.add(key[head])
    return out


def spans(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi) of covered bytes, unmerged."""
    docs = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    total = docs.agg(F.sum(F.length("raw"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)

    def post(batches):
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            held.clear()
            rows, own, _ = _firsts(rows)
            gone = rows[["doc", "lo", "hi"]][~own].astype(_SPAN_ROW)
            rows = rows[own]
            shard = (rows["kmer"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else shard
            pieces = [pack(rows[p]) for p in np.split(order, cut[1:])] if len(rows) else []
            # Spans known already ride along, a share with each piece.
            share = np.array_split(gone, max(1, len(pieces)))
            return pd.DataFrame({"shard": shard[cut], "rows": pieces, "gone": [g.tobytes() for g in share][: len(pieces)]})

        for pdf in batches:
            for d, raw in zip(pdf["doc"], pdf["raw"]):
                at, h, lo, hi, ctx = postings(bytes(raw))
                if not len(at):
                    continue
                r = np.empty(len(at), _ROW)
                r["kmer"], r["ctx"], r["doc"], r["at"], r["lo"], r["hi"] = h, ctx, d, at, lo, hi
                held.append(r)
                size += len(raw)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, own, head = _firsts(np.concatenate([unpack(bytes(r)) for r in pdf["rows"]]))
        gone = np.frombuffer(b"".join(pdf["gone"]), _SPAN_ROW)
        out = [(gone["doc"], gone["lo"], gone["hi"], np.full(len(gone), -1), np.zeros(len(gone), np.int64))]
        c = rows[~own]
        out.append((c["doc"], c["lo"], c["hi"], np.full(len(c), -1), np.zeros(len(c), np.int64)))
        new = np.r_[True, rows["kmer"][1:] != rows["kmer"][:-1]]
        kinds = np.bincount(np.cumsum(new) - 1, weights=head)[np.cumsum(new) - 1]
        # Of a context's first document one occurrence will do, if it's not there twice; the others have the same fate.
        ask = rows[own & (kinds > 1)]
        out.append((ask["doc"], ask["lo"], ask["hi"], ask["at"], ask["kmer"].view(np.int64)))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pd.DataFrame(dict(zip(("doc", "lo", "hi", "at", "kmer"), cols)))

    settled = materialize(docs.mapInPandas(post, "shard long, rows binary, gone binary").groupBy("shard").applyInPandas(settle, "doc long, lo int, hi int, at int, kmer long"), "suffix-settled")
    ask = settled.where("at >= 0")
    often = materialize(ask.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("kmer"), "suffix-often")
    some = not often.isEmpty()
    # Arrays of plain numbers reach Python as numpy arrays; arrays of structs would be objects each.
    asked = (ask.join(often, "kmer", "left_anti") if some else ask).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi", "kmer"))).alias("ask"))
    asked = asked.select("doc", "ask.at", "ask.lo", "ask.hi", "ask.kmer")

    def fetch(batches):
        for pdf in (whole.iloc[k : k + 500] for whole in batches for k in range(0, len(whole), 500)):
            out = {"shard": [], "doc": [], "at": [], "lo": [], "kmer": [], "raw": []}
            for d, raw, *ask in zip(*(pdf[c] for c in ("doc", "raw", "at", "lo", "hi", "kmer"))):
                raw = bytes(raw)
                for at, lo, hi, kmer in zip(*(x.tolist() for x in ask)):
                    for k, v in zip(out, (kmer % shards, d, at, lo, kmer, raw[lo:hi])):
                        out[k].append(v)
            yield pd.DataFrame(out)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        found = covered(pdf["doc"].to_numpy(), pdf["at"].to_numpy(), pdf["lo"].to_numpy(), [bytes(r) for r in pdf["raw"]])
        if not any(len(f[0]) for f in found):
            return pd.DataFrame({"doc": [], "lo": [], "hi": []}).astype("int64")
        doc, start = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + SPAN)])
        return pd.DataFrame({"doc": doc[head], "lo": start[head], "hi": start[np.r_[head[1:] - 1, len(start) - 1]] + SPAN})

    once = docs.dropDuplicates(["doc"])
    fetched = once.join(asked, "doc").mapInPandas(fetch, "shard long, doc long, at int, lo int, kmer long, raw binary")
    matched = fetched.groupBy("shard").applyInPandas(match, "doc long, lo int, hi int")
    found = settled.where(f"at < 0 AND hi - lo >= {SPAN}").select("doc", "lo", "hi").unionByName(matched)
    if some:
        far = ask.join(often, "kmer").select("doc", F.explode(F.sequence("lo", F.least("at", F.col("hi") - SPAN))).alias("lo")).distinct()
        far = materialize(once.join(far, "doc").select("doc", "lo", F.expr(f"substring(raw, lo + 1, {SPAN})").alias("window")), "suffix-far")
        least = far.groupBy("window").agg(F.min("doc").alias("least"))
        found = found.unionByName(far.join(least, "window").where("doc > least").select("doc", "lo", (F.col("lo") + SPAN).alias("hi")))
    return found


_SPAN_ROW = np.dtype([("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def cut(raw: bytes, lo: np.ndarray, hi: np.ndarray):
    """(bytes removed, maximal runs, what is left)."""
    step = np.zeros(len(raw) + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    gone = np.cumsum(step)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay, of every document.

    Null texts count as empty. Rows that repeat a doc_id must repeat its text: they never match
    each other and get one result. Rows without an id come after all ids under 2 ** 62, in an order by
    their texts' hashes; those of one text are repeats of one document.
    What stays need not be valid UTF-8, so it is binary. Other columns are ignored.
    """
    found = spans(docs).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    found = found.select("doc", "gone.lo", "gone.hi")
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))

    def run(raws, los, his):
        out = []
        for raw, lo, hi in zip(raws, los, his):
            raw = raw.as_py()
            out.append((len(raw), *(cut(raw, lo.values.to_numpy(), hi.values.to_numpy()) if lo.is_valid and len(lo.values) else (0, 0, raw))))
        return zip(*out)

    return map_columns(own.join(found, "doc", "left"), ["doc_id"], ["raw", "lo", "hi"], run, "n_bytes long, n_removed long, n_spans long, kept binary", 500)


def op4(spark, sf_dir):
    out = dedup_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, bytes]]) -> dict:
    """(n_bytes, n_removed, n_spans, sha256) by document from a table of all 50-byte strings."""
    first: dict[bytes, int] = {}
    for d, raw in sorted(docs):
        for i in range(len(raw) - SPAN + 1):
            first.setdefault(raw[i : i + SPAN], d)
    out = {}
    for d, raw in docs:
        lo = np.array([i for i in range(len(raw) - SPAN + 1) if first[raw[i : i + SPAN]] < d], np.int64)
        n, runs, kept = cut(raw, lo, lo + SPAN)
        out[d] = (len(raw), n, runs, hashlib.sha256(kept).hexdigest())
    return out
