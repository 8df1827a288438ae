"""MinHash near-dedup: an inverted join over signature coordinates, then exact confirmation.

Texts of one shingle set are one class. A class is posted under its rarest coordinate-value pairs:
as two texts that match need ``matches`` equal coordinates of ``COORDS``, they share one of the
``COORDS - matches + 1`` rarest of either. A semi-join on postings finds classes with any possible
partner, without making pairs. Those go to tiles of bounded size, similar ones next to each other;
each pair of tiles that share a coordinate value is one task, which counts collisions of whole
signatures, skips pairs already joined, confirms the rest on full shingle sets and returns a
spanning forest. Missing a link takes a pair at the threshold that falls under ``matches``, 5.6
standard deviations below its mean, or over ``bits_off``, 5.5 above.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER_BYTES, map_columns, materialize, table, trim

WORDS, COORDS = 5, 128
#: Similarity of near duplicates as a fraction, where none is given: op9's.
SIMILAR = (85, 100)
TILE, BUCKETS = 512, 1 << 16
_ODD = np.random.default_rng(1).integers(0, 2**32, (2, COORDS), np.uint32) | np.array([[1], [0]], np.uint32)
_POW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles; of the whole if it has fewer words."""
    ws = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, ws)), np.uint64)
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        total += h[k : k + n] * _POW[k]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's hash over a set that isn't empty."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        out = np.minimum(out, (low[k : k + 2048, None] * _ODD[0] + _ODD[1]).min(axis=0))
    return out


class Limits:
    """Bounds that follow from a similarity num / den.

    Equal coordinates are binomial in it; one-bit signatures differ in half of the unequal ones.
    """

    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.num, self.den = similar
        t = self.num / self.den
        off = (1 - t) / 2
        self.matches = max(1, int(COORDS * t - 5.6 * (COORDS * t * (1 - t)) ** 0.5))
        self.bits_off = math.ceil(COORDS * off + 5.5 * (COORDS * off * (1 - off)) ** 0.5)


def similar(a: np.ndarray, b: np.ndarray, limits: Limits) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if limits.den * len(a) < limits.num * len(b):
        return False
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    both = int((b[i] == a).sum())
    return limits.den * both >= limits.num * (len(a) + len(b) - both)


def forest(ids, sigs: np.ndarray, sets: list, split: int, limits: Limits):
    """Edges to the least id of each component among all pairs, or across ``split`` if it is over 0."""
    n = len(ids)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n if not split else split):
        j = np.arange(max(i + 1, split), n)
        if not len(j):
            continue
        near = j[(sigs[j] == sigs[i]).sum(axis=1) >= limits.matches]
        for k in near:
            a, b = root(i), root(int(k))
            if a != b and similar(sets[i], sets[k], limits):
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                parent[b] = a
    return [(ids[i], ids[root(i)]) for i in range(n) if root(i) != i]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key of the set, signature; key and signature are null for empty sets."""

    def run(texts):
        out = []
        for x in texts.to_pylist():
            s = shingles(x)
            out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()) if len(s) else (0, None, None))
        return zip(*out)

    return map_columns(docs, ["doc_id"], ["text"], run, "n_shingles long, key binary, sig binary")


def _tokens(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each coordinate-value pair."""
    return _mix(sigs.astype(np.uint64) + (np.arange(COORDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _postings(reps: DataFrame, limits: Limits) -> DataFrame:
    """(tok, id, n, b0, b1): each class under its rarest coordinate values, with its one-bit signature."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            if len(pdf):
                t = _tokens(np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS))
                total += np.bincount((t & np.uint64(BUCKETS - 1)).astype(np.int64).ravel(), minlength=BUCKETS)
        b = np.flatnonzero(total)
        yield pd.DataFrame({"b": b, "c": total[b]})

    counted = reps.select("sig").mapInPandas(count, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toPandas()  # BUCKETS rows at most
    freq = np.zeros(BUCKETS, np.int64)
    freq[counted["b"]] = counted["c"]
    shared = reps.sparkSession.sparkContext.broadcast(freq)
    length = COORDS - limits.matches + 1

    def post(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS)
            t = _tokens(sigs)
            order = np.lexsort((t, shared.value[(t & np.uint64(BUCKETS - 1)).astype(np.int64)]), axis=1)[:, :length]
            bits = np.packbits((sigs >> np.uint32(16)) & np.uint32(1), axis=1).view(np.int64)
            rep = lambda c: np.repeat(c, length)
            yield pd.DataFrame({"tok": np.take_along_axis(t, order, axis=1).ravel().view(np.int64), "id": rep(pdf["id"].to_numpy()), "n": rep(pdf["n"].to_numpy()), "b0": rep(bits[:, 0]), "b1": rep(bits[:, 1])})

    return reps.select("id", "n", "sig").mapInPandas(post, "tok long, id long, n long, b0 long, b1 long")


def _tiles(suspects: DataFrame) -> DataFrame:
    """(id, tile): classes near each other, in parts of about TILE by a hash of the id.

    A class takes its most common coordinate value, then the most common one that is taken by any
    class it shares a value with, so that one large group has one label.
    """
    size = suspects.groupBy("tok").agg(F.count("*").alias("c"))
    lead = suspects.join(size, "tok").groupBy("id").agg(F.max(F.struct("c", "tok")).alias("k"))
    near = suspects.join(lead, "id").groupBy("tok").agg(F.max("k").alias("k"))
    label = materialize(suspects.join(near, "tok").groupBy("id").agg(F.max("k").getField("tok").alias("label")), "minhash-labels")
    count = label.groupBy("label").agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / TILE).cast("bigint"))
    return materialize(label.join(count, "label").select("id", F.xxhash64("label", part).alias("tile")), "minhash-tiles")


def links(docs: DataFrame, reps: DataFrame, limits: Limits) -> DataFrame:
    """(a, b) edges that connect exactly the classes that links connect; ids are doc_ids of class firsts."""
    post = _postings(reps, limits)
    x, y = post.alias("x"), post.alias("y")
    possible = F.expr(
        f"x.tok = y.tok AND x.id <> y.id AND {limits.den} * x.n >= {limits.num} * y.n AND {limits.den} * y.n >= {limits.num} * x.n "
        f"AND bit_count(x.b0 ^ y.b0) + bit_count(x.b1 ^ y.b1) <= {limits.bits_off}"
    )
    suspects = materialize(x.join(y, possible, "left_semi").select("x.tok", "x.id"), "minhash-suspects")
    tiles = _tiles(suspects)
    met = suspects.join(tiles, "id").select("tok", "tile").distinct()
    pairs = met.join(met.withColumnRenamed("tile", "other"), "tok").where("tile <= other").select("tile", "other").distinct()
    pairs = materialize(pairs, "minhash-pairs")
    both = pairs.select("tile", F.struct("tile", "other").alias("p"), F.lit(0).alias("side")).unionByName(pairs.where("tile <> other").select(F.col("other").alias("tile"), F.struct("tile", "other").alias("p"), F.lit(1).alias("side")))

    def sets(batches):
        for pdf in batches:
            found = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "tile": pdf["tile"], "set": [s.tobytes() for s in found], "sig": [signature(s).tobytes() for s in found]})
        pdf = found = None
        trim()

    whole = docs.select(F.col("doc_id").cast("long").alias("id"), "text").dropDuplicates(["id"]).join(tiles, "id").select("id", "tile", "text").mapInPandas(sets, "id long, tile long, set binary, sig binary")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"])
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS)
        edges = forest(pdf["id"].tolist(), sigs, [np.frombuffer(s, np.uint64) for s in pdf["set"]], int((pdf["side"] == 0).sum()) if (pdf["side"] == 1).any() else 0, limits)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return materialize(whole.join(both, "tile").groupBy("p").applyInPandas(kernel, "a long, b long").distinct(), "minhash-edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node with an edge, by alternating stars until nothing changes."""
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        last = state


def near_duplicates(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, linked from Jaccard ``similar`` up.

    Null and empty texts have no shingles and are linked with nothing. A row without an id is a
    component of its own (component_id null) and kept. Rows that repeat a doc_id must repeat its
    text and all get that document's result. Columns other than doc_id and text are ignored.
    """
    found = materialize(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "minhash-features")
    sets = found.where("doc_id IS NOT NULL AND key IS NOT NULL")
    first = sets.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    member = materialize(sets.select("doc_id", "key").join(first, "key").select("doc_id", "first").distinct(), "minhash-classes")
    reps = sets.join(member.where("doc_id = first").select("doc_id"), "doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    comp = components(links(docs, reps, Limits(similar)))
    of = member.join(comp, member["first"] == comp["id"], "left").select("doc_id", F.coalesce("component_id", "first").alias("component_id"))
    return found.select("doc_id", "n_shingles").join(of, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def dedup(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows, with all their columns, of the first document of each component."""
    gone = near_duplicates(docs, similar).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), (85, 100))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, r.c FROM r JOIN both_ways ON a = id)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN s USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
