"""Exact top-k inner-product search: a ball tree per shard, branch and bound, shared kth scores.

Rows are dealt to shards of bounded size by a hash of the id, queries to blocks of bounded size.
A block first searches one pilot shard; the kth score it finds there is a lower bound that prunes
the block's searches of all other shards. Every (block, shard) pair is a task of bounded memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16384, 4096, 128
LONG = 2**63


class BallTree:
    """Balls over the rows of ``x``; a node's halves part at the median along its widest direction."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.span, self.child = [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = x[self.order[lo:hi]]
            c = own.mean(axis=0)
            k = len(self.centre)
            self.centre.append(c)
            self.radius.append(np.sqrt(((own - c) ** 2).sum(axis=1).max()))
            self.span.append((lo, hi))
            self.child.append([-1, -1])
            if parent >= 0:
                self.child[parent][side] = k
            if hi - lo > leaf and self.radius[k] > 0:
                a = own[((own - c) ** 2).sum(axis=1).argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                mid = (hi - lo) // 2
                part = np.argpartition(own @ (b - a), mid)
                self.order[lo:hi] = self.order[lo:hi][part]
                stack += [(lo, lo + mid, k, 0), (lo + mid, hi, k, 1)]
        self.centre, self.radius, self.child = np.array(self.centre), np.array(self.radius), np.array(self.child)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, theta: np.ndarray, k: int):
    """Exact best k rows for each query as (query, row, score) arrays, those under ``theta`` pruned.

    Nodes are bounded by ``q.c + |q| r``; a query visits leaves by falling bound and stops at the
    first below its current kth score. Score and id make one integer key, so ties are exact.
    """
    n, m = len(q), len(ids)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(m, np.int64)
    rank[by_id] = np.arange(m)
    norm = np.sqrt((q**2).sum(axis=1))
    slack = 1e-6 * (1 + norm)
    theta = theta.astype(np.float64)
    low = np.where(np.isfinite(theta), np.maximum(theta, -(2.0**62) / m), -(2.0**62) / m)
    best = np.full((n, k), np.iinfo(np.int64).min)
    pairs_q, pairs_n, pairs_b = [], [], []
    qi, node = np.arange(n), np.zeros(n, np.int64)
    while len(qi):
        bound = np.einsum("ij,ij->i", q[qi], tree.centre[node]) + norm[qi] * tree.radius[node] * (1 + 1e-9) + slack[qi] * (1 + tree.radius[node])
        keep = bound >= low[qi]
        qi, node, bound = qi[keep], node[keep], bound[keep]
        leaf = tree.child[node, 0] < 0
        pairs_q.append(qi[leaf])
        pairs_n.append(node[leaf])
        pairs_b.append(bound[leaf])
        qi, node = np.repeat(qi[~leaf], 2), tree.child[node[~leaf]].ravel()
    pq, pn, pb = map(np.concatenate, (pairs_q, pairs_n, pairs_b))
    order = np.lexsort((-pb, pq))
    pq, pn, pb = pq[order], pn[order], pb[order]
    start = np.searchsorted(pq, np.arange(n))
    end = np.searchsorted(pq, np.arange(n), side="right")
    at, active = start.copy(), np.flatnonzero(start < end)
    while len(active):
        active = active[pb[at[active]] >= low[active]]
        nodes = pn[at[active]]
        group = np.argsort(nodes, kind="stable")
        for run in np.split(group, np.flatnonzero(np.diff(nodes[group])) + 1):
            if not len(run):
                continue
            who, (lo, hi) = active[run], tree.span[nodes[run[0]]]
            rows = tree.order[lo:hi]
            score = (q[who] @ tree.x[rows].T).astype(np.int64)
            key = score * m + (m - 1 - rank[rows])
            key[ids[rows][None, :] == qids[who][:, None]] = np.iinfo(np.int64).min
            both = np.concatenate([best[who], key], axis=1)
            best[who] = -np.partition(-both, k - 1, axis=1)[:, :k] if both.min() > np.iinfo(np.int64).min else np.sort(both, axis=1)[:, -k:]
            kth = best[who].min(axis=1)
            full = kth > np.iinfo(np.int64).min
            low[who[full]] = np.maximum(low[who[full]], (kth[full] // m).astype(np.float64))
        at[active] += 1
        active = active[at[active] < end[active]]
    who, col = np.nonzero(best > np.iinfo(np.int64).min)
    key = best[who, col]
    score = key // m
    keep = score >= theta[who]
    return who[keep], by_id[m - 1 - (key[keep] - score[keep] * m)], score[keep]


def brute(x: list, ids: np.ndarray, q: list, qids: np.ndarray, theta: np.ndarray, k: int):
    """The same by whole-number arithmetic of any size, for components too large for the keys above."""
    out, theta = [], theta.tolist()  # plain floats compare with whole numbers of any size
    for i, row in enumerate(q):
        all_ = [(-sum(a * b for a, b in zip(row, y)), ids[j], j) for j, y in enumerate(x) if ids[j] != qids[i]]
        out += [(i, j, max(-LONG, min(LONG - 1, -s))) for s, _, j in sorted(all_)[:k] if -s >= theta[i]]
    return tuple(np.array(v, dtype=np.int64) for v in zip(*out)) if out else (np.array([], np.int64),) * 3


def quantise(vecs: list, scale: int):
    """floor(scale * component) as a float matrix, or as lists of ints where doubles would not be exact."""
    x = np.array(vecs, dtype=np.float64)
    with np.errstate(over="ignore"):
        m = np.floor(scale * x)
    if not len(m) or np.abs(m).max() < 2**24:
        return m
    # A component whose product passes the doubles is a whole number itself.
    return [[int(v) if np.isfinite(v) else int(own) * scale for v, own in zip(r, row)] for r, row in zip(m, x)]


def _search_group(rows: pd.DataFrame, queries: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """One shard against one block; vectors of different lengths never meet."""
    out = []
    queries = queries.rename(columns={"qid": "id", "qvec": "vec"})
    for dim, own in rows.groupby(rows["vec"].map(len)):
        ask = queries[queries["vec"].map(len) == dim]
        if not len(ask):
            continue
        ids, qids = own["id"].to_numpy(np.int64), ask["id"].to_numpy(np.int64)
        theta = ask["theta"].astype("float64").fillna(-np.inf).to_numpy()
        x, q = quantise(own["vec"].tolist(), scale), quantise(ask["vec"].tolist(), scale)
        small = isinstance(x, np.ndarray) and isinstance(q, np.ndarray) and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1) * len(ids) < 2**52
        if small and dim:
            who, row, score = search(BallTree(x), ids, q, qids, theta, k)
        else:
            who, row, score = brute([list(map(int, r)) for r in x], ids, [list(map(int, r)) for r in q], qids, theta, k)
        out.append(pd.DataFrame({"query_id": qids[who], "vec_id": ids[row], "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product of floor(scale * x).

    Ties go to the smaller id; fewer rows than k give all. Null ids or vectors and vectors with a
    null or non-finite component take no part. A row never meets rows of its own id; of several
    rows with one query id the smallest vector asks. Vectors of different lengths are not compared.
    Scores beyond 64 bits are cut to the nearest long. An empty table gives no rows.
    """
    # Lists in double precision are compared as they are; bad ones leave before anything moves.
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    asks = good.where(is_query(F.col("id"))).groupBy(F.col("id").alias("qid")).agg(F.min("vec").alias("qvec"))
    n, n_asks = good.count(), asks.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_asks // BLOCK_QUERIES))
    good = good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(blocks)).cast("int"))
    schema = "query_id long, vec_id long, score long"
    task = (F.col("shard") * blocks + F.col("block")).alias("task")

    def run(rows, queries):
        return (
            rows.groupBy("task")
            .cogroup(queries.toDF("qtask", "qid", "qvec", "theta").groupBy("qtask"))
            .applyInPandas(lambda a, b: _search_group(a, b, k, scale), schema)
        )

    pilot = lambda block: block % shards
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    first_rows = good.withColumn("block", F.explode(F.filter(every, lambda b: pilot(b) == F.col("shard")))).select(task, "id", "vec")
    first_asks = asks.withColumn("shard", pilot(F.col("block"))).select(task, "qid", "qvec", F.lit(None).cast("long").alias("theta"))
    first = run(first_rows, first_asks)
    found = first
    if shards > 1:
        from loomgraph.llm.common import materialize

        first = materialize(first, "topk-pilot")
        kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("theta"))
        rest_rows = good.withColumn("block", F.explode(F.filter(every, lambda b: pilot(b) != F.col("shard")))).select(task, "id", "vec")
        rest_asks = (
            asks.join(kth.withColumnRenamed("query_id", "qid"), "qid", "left")
            .withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: pilot(F.col("block")) != s)))
            .select(task, "qid", "qvec", "theta")
        )
        found = first.unionByName(run(rest_rows, rest_asks))
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("r", "t")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op8(spark, sf_dir):
    from loomgraph.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
