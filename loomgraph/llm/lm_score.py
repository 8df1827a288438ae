"""Language-model scores: causal self-attention in numpy over public subword ids.

The model predicts subwords of the lower-cased words, each with a space before it, and one end per
text. Over a bigram prior counted in all training documents, one causal attention layer tilts the
classes of the next subword:

    p(x | context) = prior(x | previous) * exp(g[class x]) / sum over classes of prior(class | previous) * exp(g[class])

Counts, vocabulary, prior and attention parameters come from every training token: each training
text is cut into consecutive windows, so that every subword is a target once. About a shard of
windows from all over starts the parameters on the driver, then all shards continue from there in
the cluster, where their windows lie, and are averaged, level by level. Texts are scored in
overlapping windows under a causal mask; every token counts once, in the first window that holds it.
"""

from __future__ import annotations

import base64
import copy
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.llm.common import LOWER_BYTES, held_out, materialize, release, table, trim

RAW_IDS, END, PAD = 50257, 50256, 65535
VOCAB, DIM, CLASSES = 4096, 16, 32
WINDOW, STRIDE = 32, 28
SHARD_WINDOWS, HEAD_WORDS, PART_WORDS = 4096, 8192, 4_000_000
END_WORD = xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
#: Words that a worker's cache may hold, and bytes gathered before a task emits.
CACHE_WORDS, FLUSH_BYTES = 400_000, 24 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Words:
    """Subword ids and hash of every word seen, so that a word is split once in a task."""

    def __init__(self, blob: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        self.bytes = np.zeros(RAW_IDS, np.int64)
        self.bytes[list(ranks.values())] = [len(k) for k in ranks]
        self.split = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.hash, self.flat, self.off = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def encode(self, words: list[bytes]):
        """(ids, number of ids of each word). One call for all: words part at spaces, which is checked."""
        texts = [" " + w.decode("utf-8", "replace") for w in words]
        ids = np.array(self.split("".join(texts)), np.int64)
        ends, stops = np.cumsum(self.bytes[ids]), np.cumsum([len(t.encode()) for t in texts])
        i = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
        if (ends[i] == stops).all():
            return ids, np.diff(i + 1, prepend=0)
        each = [self.split(t) for t in texts]  # some word's end lies within a piece
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each])

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Places of each text's words in the cache; the caller clears a full one."""
        flat = list(chain.from_iterable(texts))
        found = list(map(self.index.get, flat))
        if None in found:
            miss = [i for i, k in enumerate(found) if k is None]
            new = list(dict.fromkeys(flat[i] for i in miss))
            ids, sizes = self.encode(new)
            base = len(self.index)
            self.index.update((w, base + i) for i, w in enumerate(new))
            self.hash = np.concatenate([self.hash, np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
            for i in miss:
                found[i] = self.index[flat[i]]
        return np.split(np.array(found, np.int64), np.cumsum([len(t) for t in texts])[:-1])

    def subwords(self, at: np.ndarray) -> np.ndarray:
        """The end, which starts a text too, then the words' subwords, then the end."""
        n = self.off[at + 1] - self.off[at]
        place = np.repeat(self.off[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(at) else np.zeros(0, np.int64)
        return np.concatenate([[END], self.flat[place], [END]]).astype(np.uint16)


def split_words(text) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()


_WORKER: dict = {}


def _words(blob: bytes) -> Words:
    if "words" not in _WORKER:
        _WORKER["words"] = Words(blob)
    return _WORKER["words"]


def _row_sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product, which is faster for short rows."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(a.shape[:-1])


class Model:
    """Vocabulary, prior tables and attention parameters; its size is bounded by VOCAB and DIM alone."""

    def __init__(self, ids: np.ndarray, bigrams: tuple[np.ndarray, np.ndarray, np.ndarray], unknown: int, counts: np.ndarray | None = None):
        """``counts`` by raw id tell how other ids share their mass; without them it is shared evenly among ``unknown``."""
        v = len(ids) + 1  # the last stands for all other ids
        self.map = np.full(65536, v - 1, np.int64)
        self.map[ids] = np.arange(len(ids))
        prev, cur, n = bigrams
        c = np.zeros((v, v), np.float32)
        np.add.at(c, (self.map[prev], self.map[cur]), n)
        uni = c.sum(axis=0) + 0.5
        uni /= uni.sum()
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True) + 1.0
        self.prior = ((c + kinds * uni) / (total + kinds)).astype(np.float32)
        self.share = np.zeros(65536, np.float32)  # log share of an id in the mass of all other ids
        if counts is not None:
            other = np.flatnonzero(self.map[: len(counts)] == v - 1)
            self.share[other] = np.log((counts[other] + 0.5) / max(0.5, (counts[other] + 0.5).sum()))
        self.cls = self._classes(c, uni)
        self.prior_class = np.zeros((v, CLASSES), np.float32)
        np.add.at(self.prior_class.T, self.cls, self.prior.T)
        # Only pairs that occur have an entry of their own; a bit table and its ranks find it.
        met = c > 0
        self.row, self.col = np.log(kinds / (total + kinds))[:, 0].astype(np.float32), np.log(uni).astype(np.float32)
        self.bits = np.packbits(np.append(met.ravel(), np.zeros(-v * v % 64, bool)), bitorder="little").view("<u8")
        n = np.bitwise_count(self.bits)
        self.rank = (np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        self.own = np.append(np.log(self.prior[met]), np.float32(0))
        if counts is None:
            even = np.float32(np.log(max(1, unknown)))
            self.col[v - 1] -= even
            self.own[:-1][np.nonzero(met)[1] == v - 1] -= even
        del self.prior
        rng = np.random.default_rng(3)
        small = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
        self.p = {"E": small(v, DIM), "P": small(WINDOW, DIM), "Q": small(DIM, DIM), "K": small(DIM, DIM), "V": small(DIM, DIM), "C": np.zeros((DIM, CLASSES), np.float32), "b": np.zeros(CLASSES, np.float32)}

    @staticmethod
    def _classes(c: np.ndarray, uni: np.ndarray) -> np.ndarray:
        """Frequent subwords alone, the rest by 2-step k-means over neighbours."""
        rng = np.random.default_rng(2)
        v = len(uni)
        x = np.concatenate([(c / (c.sum(axis=1, keepdims=True) + 1)) @ rng.standard_normal((v, 24)).astype(np.float32), (c.T / (c.T.sum(axis=1, keepdims=True) + 1)) @ rng.standard_normal((v, 24)).astype(np.float32)], axis=1)
        order = np.argsort(-uni, kind="stable")
        alone = min(8, v)
        cls = np.zeros(v, np.int64)
        cls[order[:alone]] = np.arange(alone)
        rest, k = order[alone:], CLASSES - alone
        if len(rest):
            centre = x[rest[:k]]
            for _ in range(8):
                own = (((x[rest, None, :] - centre[None]) ** 2).sum(axis=2)).argmin(axis=1)
                w = uni[rest]
                centre = np.stack([np.average(x[rest[own == j]], axis=0, weights=w[own == j]) if (own == j).any() else centre[j] for j in range(len(centre))])
            cls[rest] = alone + own
        return cls

    def log_prior(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the bigram prior of y after x."""
        at = x * len(self.row) + y
        word, low = self.bits[at >> 6], (at & 63).astype(np.uint64)
        one = np.uint64(1)
        there = (word >> low & one).astype(bool)
        i = self.rank[at >> 6] + np.bitwise_count(word & ((one << low) - one))
        return np.where(there, self.own[np.where(there, i, 0)], self.row[x] + self.col[y])

    def for_training(self) -> "Model":
        """The same without the prior of single pairs, which a training step doesn't read."""
        out = copy.copy(self)
        del out.row, out.col, out.bits, out.rank, out.own, out.share
        return out

    def projections(self) -> np.ndarray:
        """Q, scaled, K and V side by side, so that one product serves all three."""
        p = self.p
        return np.concatenate([p["Q"] / np.float32(np.sqrt(DIM)), p["K"], p["V"]], axis=1)

    def forward(self, x: np.ndarray):
        """(inputs, their q, k and v, weights and one over their sums, h, g) of windows, whose mask lets a place see itself and earlier ones."""
        p = self.p
        n = x.shape[1]
        e = p["E"].take(x, axis=0)
        e += p["P"][:n]
        qkv = e @ self.projections()
        q, k, v = (qkv[..., i : i + DIM] for i in (0, DIM, 2 * DIM))
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= np.tri(n, dtype=np.float32)
        one = 1 / _row_sums(a)[..., None]
        h = a @ v
        h *= one
        h += e
        g = h @ p["C"]
        g += p["b"]
        return e, (q, k, v), a, one, h, g

    def log_prob(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target."""
        g = self.forward(x)[-1]
        np.minimum(g, 20, out=g)
        own = g.reshape(-1, CLASSES)[np.arange(y.size), self.cls[y].ravel()].reshape(y.shape)
        np.exp(g, out=g)
        return self.log_prior(x, y) + own - np.log(np.vecdot(g, self.prior_class.take(x, axis=0)))

    def train(self, w: np.ndarray, epochs: int, rate: float, seed: int = 0, batch: int = 128) -> None:
        """Adam over windows of WINDOW + 1 ids; places past a text's end are -1 and carry no loss."""
        p, rng = self.p, np.random.default_rng(seed)
        m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(w))
            for i in range(0, len(w), batch):
                part = w[order[i : i + batch]]
                live = (part[:, 1:] >= 0).astype(np.float32)
                x, y = np.maximum(part[:, :-1], 0), np.maximum(part[:, 1:], 0)
                e, (q, k, v), a, one, h, d = self.forward(x)
                np.minimum(d, 20, out=d)
                np.exp(d, out=d)
                d *= self.prior_class.take(x, axis=0)
                live /= max(1.0, live.sum())
                d *= (live / _row_sums(d))[..., None]
                rows = d.reshape(-1, CLASSES)
                rows[np.arange(len(rows)), self.cls[y].ravel()] -= live.ravel()
                dh = d @ p["C"].T
                a *= one
                ds = dh @ v.transpose(0, 2, 1)
                ds -= np.vecdot(dh, h - e)[..., None]  # ds times a, summed: h - e is a @ v
                ds *= a
                dp = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh], axis=2)
                de = dp @ self.projections().T
                de += dh
                flat = lambda u: u.reshape(-1, u.shape[-1])
                # Products a window at a time, then summed: far faster than one long thin product.
                by = lambda u, w: (u.transpose(0, 2, 1) @ w).sum(axis=0)
                dw = by(e, dp)
                grad = {"C": by(h, d), "b": np.ones(len(rows), np.float32) @ flat(d), "Q": dw[:, :DIM] / np.float32(np.sqrt(DIM)), "K": dw[:, DIM : 2 * DIM], "V": dw[:, 2 * DIM :], "P": de.sum(axis=0)}
                place = x[..., None] * DIM + np.arange(DIM)
                grad["E"] = np.bincount(place.ravel(), weights=de.ravel(), minlength=p["E"].size).astype(np.float32).reshape(p["E"].shape)
                t += 1
                # m and s are ten and a hundred times the usual means.
                up, down = np.float32(0.1 * rate / (1 - 0.9**t)), np.float32(0.1 / np.sqrt(1 - 0.99**t))
                for name, u in grad.items():
                    m[name] *= np.float32(0.9)
                    m[name] += u
                    s[name] *= np.float32(0.99)
                    u *= u
                    s[name] += u
                    np.sqrt(s[name], out=u)
                    u *= down
                    u += np.float32(1e-8)
                    np.divide(m[name], u, out=u)
                    u *= up
                    p[name] -= u

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype("<f4").tobytes()

    def unpack(self, blob) -> None:
        at, flat = 0, np.frombuffer(bytes(blob), "<f4")
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def score(self, texts: list[np.ndarray], chunk: int = 128) -> np.ndarray:
        """log10 probability of each sequence of raw ids after its first."""
        n = np.array([len(t) - 1 for t in texts])
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        raw = np.concatenate(texts)
        flat = np.concatenate([self.map[raw], np.zeros(WINDOW + 1, np.int64)])
        start = (np.cumsum(n + 1) - (n + 1))[owner] + nth * STRIDE
        stop = np.minimum(n[owner] - nth * STRIDE, WINDOW)  # targets in the window
        fresh = np.where(nth > 0, WINDOW - STRIDE, 0)  # those before were scored by the last window
        # Shares of rare ids, of all ids but each text's first.
        own = self.share[raw]
        own[np.cumsum(n + 1) - (n + 1)] = 0
        out = np.bincount(np.repeat(np.arange(len(texts)), n + 1), weights=own, minlength=len(texts))
        place = np.arange(WINDOW)
        for i in range(0, len(owner), chunk):
            s = slice(i, i + chunk)
            at = start[s, None] + place
            lp = self.log_prob(flat[at], flat[at + 1])
            lp[(place < fresh[s, None]) | (place >= stop[s, None])] = 0
            out += np.bincount(owner[s], weights=lp.sum(axis=1, dtype=np.float64), minlength=len(texts))
        return out / np.log(10)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.int64)


def _grouped(key: np.ndarray, *cols: np.ndarray):
    """(key, slices of cols) for every distinct key, cols sorted within by their order."""
    order = np.argsort(key, kind="stable")  # a radix sort where keys have 16 bits or fewer
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return [(int(key[c]), *xs) for c, *xs in zip(cuts, *(np.split(x[order], cuts[1:]) for x in cols))] if len(key) else []


def cut_windows(ids: np.ndarray) -> np.ndarray:
    """Consecutive windows of WINDOW + 1 raw ids, PAD after the end: every id after the first is a target once."""
    n = -(-(len(ids) - 1) // WINDOW)
    flat = np.full(n * WINDOW + 1, PAD, "<u2")
    flat[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 1)[::WINDOW].copy()


_COUNTS = "kind string, part long, a binary, b binary"


def _runs(key: np.ndarray):
    """(distinct keys, their first places, how often each occurs) of a sorted array."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], first, np.diff(first, append=len(key))


def _pair_counts(words: Words, n: np.ndarray, cross: np.ndarray):
    """Distinct pairs of subwords, sorted, and how often they occur, when the cached words occur ``n`` times.

    Pairs within words follow from the words' counts; those across words are given, and are sorted in place.
    """
    cross.sort()
    key, _, count = _runs(cross)
    inner = np.ones(len(words.flat), bool)
    inner[words.off[:-1][words.off[:-1] < len(inner)]] = False  # a word's first subword ends no pair of its own
    times = np.repeat(n, np.diff(words.off))
    at = np.flatnonzero(inner & (times > 0))
    flat = words.flat.astype(np.uint32)
    within, times = flat[at - 1] << np.uint32(16) | flat[at], times[at]
    del inner, at, flat
    key, count = np.append(key, within), np.append(count, times)
    del within, times
    order = np.argsort(key)
    key, first, _ = _runs(key[order])
    return key, np.add.reduceat(count[order], first) if len(first) else count


def count(docs: DataFrame, blob, parts: int) -> DataFrame:
    """Counts of the training rows: kind w (word hash, n), b (bigram, n), t (all windows of the documents)."""
    arrow = to_arrow_schema(StructType.fromDDL(_COUNTS))

    def run(batches):
        words = _words(blob.value)
        seen, cross, wins, texts, size = [], [], [], 0, 0

        def flush():
            n = np.zeros(len(words.index), np.int64)
            for k in range(0, len(seen), 256):
                n += np.bincount(np.concatenate(seen[k : k + 256]), minlength=len(n))
            used = np.flatnonzero(n)
            h, c = np.append(words.hash[used], np.uint64(END_WORD)), np.append(n[used], texts)
            rows = [("w", k, a.tobytes(), b.astype(np.int64).tobytes()) for k, a, b in _grouped(_part(h, parts), h, c)]
            rows.append(("t", int(h[0] >> np.uint64(1)), np.concatenate(wins).tobytes(), b""))
            k, c = _pair_counts(words, n, np.concatenate(cross))
            seen.clear(), wins.clear(), cross.clear()
            rows += [("b", p, a.tobytes(), b.tobytes()) for p, a, b in _grouped((k >> np.uint32(16)).astype(np.uint8) % np.uint8(64), k, c)]
            if len(words.index) > CACHE_WORDS:
                words.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                for at in words.look_up([split_words(x) for x in whole.column(0).slice(start, 256).to_pylist()]):
                    seen.append(at.astype(np.uint32))
                    first, last = words.flat[words.off[at]].astype(np.uint32), words.flat[words.off[at + 1] - 1].astype(np.uint32)
                    cross.append(np.append(np.uint32(END), last) << np.uint32(16) | np.append(first, np.uint32(END)))
                    wins.append(cut_windows(words.subwords(at)))
                    texts += 1
                    size += 12 * len(at) + 2 * wins[-1].size + 300
                if size > FLUSH_BYTES or len(words.index) > CACHE_WORDS:
                    yield flush()
                    trim()
                    texts = size = 0
        if texts:
            yield flush()
        trim()

    return docs.select("text").mapInArrow(run, _COUNTS)


def _sum_counts(dtype: str):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        k, inv = np.unique(np.frombuffer(b"".join(pdf["a"]), dtype), return_inverse=True)
        n = np.bincount(inv, weights=np.frombuffer(b"".join(pdf["b"]), np.int64), minlength=len(k)).astype(np.int64)
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "part": [pdf["part"].iloc[0]], "a": [k.tobytes()], "b": [n.tobytes()]})

    return add


def _average(parts: DataFrame) -> bytes | None:
    """Mean of parameter rows (k, n, p), 16 at a time until one is left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack([np.frombuffer(bytes(x), "<f4") for x in pdf["p"]])
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0]) // 16], "n": [int(pdf["n"].sum())], "p": [np.average(p, axis=0, weights=pdf["n"]).astype("<f4").tobytes()]})

    parts = materialize(parts, "lm-parameters")
    while parts.count() > 1:
        last, parts = parts, materialize(parts.groupBy(F.floor(F.col("k") / 16)).applyInPandas(mean, "k long, n long, p binary"), "lm-parameters")
        release(last)
    row = parts.first()
    release(parts)
    return row and row["p"]


def fit(docs: DataFrame, blob, parts: int):
    """(model, word counts by part, N, V) from the training rows."""
    counted = materialize(count(docs, blob, parts), "lm-counts")
    words = materialize(counted.where("kind = 'w'").groupBy("part").applyInPandas(_sum_counts("<u8"), _COUNTS), "lm-words")
    pairs = materialize(counted.where("kind = 'b'").groupBy("part").applyInPandas(_sum_counts("<u4"), _COUNTS).select("a", "b"), "lm-pairs")

    def ids_of(blob):
        k = np.frombuffer(bytes(blob), "<u4")
        return (k >> 16).astype(np.int64), (k & 0xFFFF).astype(np.int64)

    def totals(batches):
        total = np.zeros(RAW_IDS)
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                total += np.bincount(ids_of(a)[1], weights=np.frombuffer(bytes(b), np.int64), minlength=RAW_IDS)
        yield pd.DataFrame({"i": np.flatnonzero(total), "n": total[total > 0]})

    counts = pairs.mapInPandas(totals, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # RAW_IDS rows at most
    uni = np.zeros(RAW_IDS)
    uni[counts["i"]] = counts["n"]
    ids = np.argsort(-uni, kind="stable")[: VOCAB - 1]
    ids = np.sort(ids[uni[ids] > 0])
    place = np.full(65536, len(ids), np.int64)
    place[ids] = np.arange(len(ids))

    def folded(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                prev, cur = ids_of(a)
                k, inv = np.unique(place[prev] * VOCAB + place[cur], return_inverse=True)
                yield pd.DataFrame({"a": [k.astype("<u4").tobytes()], "b": [np.bincount(inv, weights=np.frombuffer(bytes(b), np.int64)).astype("<f4").tobytes()]})

    met = pairs.mapInPandas(folded, "a binary, b binary").toPandas()  # 8 bytes for each of VOCAB * VOCAB pairs at most, but for the last row of the table
    k, n = np.frombuffer(b"".join(map(bytes, met["a"])), "<u4").astype(np.int64), np.frombuffer(b"".join(map(bytes, met["b"])), "<f4")
    whole = np.append(ids, PAD)  # PAD is no vocabulary id and so stands for the rest
    model = Model(ids, (whole[k // VOCAB], whole[k % VOCAB], n), RAW_IDS - len(ids), uni)
    del met, k, n
    release(pairs)

    # Windows of all documents; a task's are dealt to shards of bounded size and trained where they lie.
    wins = counted.where("kind = 't'").select("part", "a")
    total = (wins.agg(F.sum(F.length("a"))).first()[0] or 0) // (2 * (WINDOW + 1))
    step = about = max(1, -(-total // SHARD_WINDOWS))
    vocab = model.map

    def unpack(blob, start: int, by: int) -> np.ndarray:
        """Every ``by``-th window from ``start`` on, in vocabulary ids; only these are ever widened."""
        w = np.frombuffer(blob, "<u2").reshape(-1, WINDOW + 1)[start::by]
        return np.where(w != PAD, vocab[w], -1).astype("<i4")

    def every(batches):
        for pdf in batches:
            for k, a in zip(pdf["part"], pdf["a"]):
                yield pd.DataFrame({"part": [k], "w": [unpack(a, int(k) % step, step).tobytes()]})

    pilot = wins.mapInPandas(every, "part long, w binary").orderBy("part").toPandas()["w"]  # about SHARD_WINDOWS windows
    pilot = np.frombuffer(b"".join(map(bytes, pilot)), "<i4").reshape(-1, WINDOW + 1).astype(np.int64)
    if total:
        model.train(pilot, epochs=4, rate=0.01)
        shared = docs.sparkSession.sparkContext.broadcast(model.for_training())

        def go_on(batches):
            for pdf in batches:
                for k, a in zip(pdf["part"], pdf["a"]):
                    shards = -(-(len(a) // (2 * (WINDOW + 1))) // SHARD_WINDOWS)
                    for i in range(shards):
                        w = unpack(a, i, shards).astype(np.int64)
                        own = copy.copy(shared.value)  # the tables are shared
                        own.p = {name: x.copy() for name, x in own.p.items()}
                        own.train(w, epochs=1, rate=0.002, seed=(int(k) + i) % 2**32)
                        yield pd.DataFrame({"k": [(int(k) + i) % about], "n": [len(w)], "p": [own.pack()]})
            trim()

        model.unpack(_average(wins.mapInPandas(go_on, "k long, n long, p binary")))
        shared.unpersist()
    release(counted)  # the windows and counts, before the texts are scored
    return model, words


def score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null texts are empty and are one end. Rows of one id, null or not, are scored one by one, and
    counted so in training; a null id counts as the empty text when rows are held out. Words of
    equal counts are alike, so ties decide nothing. Ids may be of any type and are returned as they
    are. Without training rows the prior is even over ids. Other columns are ignored.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), 1).alias("held_out"))
    about = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, about // (6 * PART_WORDS))
    model, words = fit(docs.where("NOT held_out"), blob, parts)

    def top(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                h, n = np.frombuffer(bytes(a), "<u8"), np.frombuffer(bytes(b), np.int64)
                best = np.argsort(-n, kind="stable")[:HEAD_WORDS]
                yield pd.DataFrame({"h": h[best].view(np.int64), "n": n[best], "total": n.sum(), "kinds": len(n)})

    tops = materialize(words.select("a", "b").mapInPandas(top, "h long, n long, total long, kinds long"), "lm-top")
    sizes = words.select("a", "b").mapInPandas(lambda it: (pd.DataFrame({"t": [int(np.frombuffer(bytes(b), np.int64).sum()) for b in p["b"]], "v": [len(a) // 8 for a in p["a"]]}) for p in it), "t long, v long").agg(F.sum("t"), F.sum("v")).first()
    train_tokens, distinct = int(sizes[0] or 0), int(sizes[1] or 0)
    head = tops.orderBy(F.desc("n"), "h").limit(HEAD_WORDS).toPandas()
    release(tops)
    order = np.argsort(head["h"].to_numpy(np.int64).view(np.uint64))
    heads = (head["h"].to_numpy(np.int64).view(np.uint64)[order], head["n"].to_numpy(np.int64)[order])
    shared = docs.sparkSession.sparkContext.broadcast((model, heads))

    added = StructType.fromDDL("uid long, n_tokens long, log double, known long, score double, part long, h binary, u binary")
    schema = StructType([docs.schema["doc_id"], docs.schema["held_out"], *added.fields])
    arrow = to_arrow_schema(schema)

    def rows(n: int, **columns):
        """A batch of ``n`` rows, null in the columns that aren't given."""
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns and isinstance(columns[f.name], pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)

    def run(batches):
        from pyspark import TaskContext

        words, (own, (hh, hn)) = _words(blob.value), shared.value
        uid = np.int64(TaskContext.get().partitionId()) << 40
        held, done, base = [], 0, uid  # base: the first uid of what is held
        hit = np.zeros(0, np.int64)  # place of each cached word among the heads, -1 for none
        head_log = np.log10(hn + 0.5)
        end_at = int(np.searchsorted(hh, np.uint64(END_WORD)))
        end_log = float(np.log10(hn[end_at] + 0.5)) if end_at < len(hh) and hh[end_at] == np.uint64(END_WORD) else None

        def flush():
            sizes = [len(x) for x in held]
            h = np.concatenate(held)
            held.clear()
            found = _grouped(_part(h, parts), h, np.repeat(np.arange(len(sizes), dtype="<u4"), sizes))
            return rows(len(found), part=[x[0] for x in found], uid=[int(base)] * len(found), h=[x[1].tobytes() for x in found], u=[x[2].tobytes() for x in found])

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                places = words.look_up([split_words(x) for x in batch.column(1).to_pylist()])
                scores = own.score([words.subwords(at) for at in places])
                if len(hit) < len(words.hash):
                    new = words.hash[len(hit) :]
                    i = np.minimum(np.searchsorted(hh, new), max(0, len(hh) - 1))
                    hit = np.concatenate([hit, np.where(hh[i] == new, i, -1) if len(hh) else np.full(len(new), -1)])
                logs, known = [], []
                for at in places:
                    i = hit[at]
                    tail = words.hash[at[i < 0]]
                    i = i[i >= 0]
                    if end_log is None:
                        tail = np.append(tail, np.uint64(END_WORD))
                    logs.append(float(head_log[i].sum()) + (end_log or 0.0))
                    known.append(len(i) + (end_log is not None))
                    held.append(tail)  # of every text, also where it is empty
                    done += 12 * len(tail) + 100
                if len(words.index) > CACHE_WORDS:
                    words.clear()
                    hit = hit[:0]
                n = batch.num_rows
                yield rows(n, doc_id=batch.column(0), held_out=batch.column(2), uid=uid + np.arange(n), n_tokens=[len(p) + 1 for p in places], log=logs, known=known, score=scores)
                uid += n
                if done > FLUSH_BYTES:
                    yield flush()
                    trim()
                    done, base = 0, uid
        if held:
            yield flush()
        trim()

    scored = materialize(docs.mapInArrow(run, schema), "lm-scores")

    def rate(tails: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(map(bytes, tails["h"])), "<u8")
        c = np.zeros(len(h))
        if len(counts):
            k, n = np.frombuffer(bytes(counts["a"].iloc[0]), "<u8"), np.frombuffer(bytes(counts["b"].iloc[0]), np.int64)
            i = np.minimum(np.searchsorted(k, h), len(k) - 1)
            c = np.where(k[i] == h, n[i], 0)
        # One row for each piece of a task's texts, so that rows don't multiply with the parts.
        out, k, logs = [], 0, np.log10(c + 0.5)
        for base, x in zip(tails["uid"], tails["u"]):
            u = np.frombuffer(bytes(x), "<u4")
            s = slice(k, k + len(u))
            k += len(u)
            ids, inv = np.unique(u, return_inverse=True)
            out.append((base, ids.tobytes(), np.bincount(inv, weights=logs[s]).tobytes(), np.bincount(inv, weights=c[s] > 0).tobytes()))
        return pd.DataFrame(out, columns=["base", "u", "log", "known"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda col, t: np.frombuffer(b"".join(map(bytes, pdf[col])), t)
        ids, inv = np.unique(join("u", "<u4"), return_inverse=True)
        total = [np.bincount(inv, weights=join(c, np.float64)) for c in ("log", "known")]
        return pd.DataFrame({"uid": ids.astype(np.int64) + int(pdf["base"].iloc[0]), "tail_log": total[0], "tail_known": total[1].astype(np.int64)})

    tails = scored.where("part IS NOT NULL").select(F.col("part").alias("k"), "uid", "h", "u").groupBy("k").cogroup(words.select(F.col("part").alias("k2"), "a", "b").groupBy("k2")).applyInPandas(rate, "base long, u binary, log binary, known binary")
    rare = tails.groupBy("base").applyInPandas(add, "uid long, tail_log double, tail_known long")
    per_token = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return scored.where("part IS NULL").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )


def op1(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
