"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding.

A text's piece lattice parts into independent units: a run of U+2581 (the mark that stands for a
space) with the characters up to the next mark, as no piece holds a mark after another character, or
up to the next character that no piece has beside those before (letters and punctuation, mostly).
Forward filtering runs once for each distinct unit of a task, over all new units of a batch at a
time; backward sampling runs over all occurrences at a time. Each draw is a hash of the row's key
and the draw's place, so a row has one segmentation wherever and however often it is processed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

from loomgraph.llm.common import map_columns, table, trim

MARK = "▁"
_MARK = MARK.encode()
#: What stands for a text's own mark in a lattice: a code point of no text.
OWN_MARK = 0x110000
#: Kinds of characters: those of the pieces' largest linked set, others, spaces, and the mark.
LINKED, OTHER, SPACE, ALONE = range(4)
#: Edges that a worker's unit cache may hold before it starts anew.
CACHE_EDGES = 5_000_000
#: Bytes of text that go through the lattice at a time, if one text has no more.
CHUNK_BYTES = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model file: surface bytes, log weights, and a trie over code points.

    A merge model's scores are ranks, not probabilities; a piece of rank r weighs 1 / (r + 2) to
    the power ``alpha``, and a byte piece ``byte_rank`` more ranks than the last piece.
    """

    def __init__(self, blob: bytes, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = sp.get_piece_size()
        self.surface, self.logw = [b""] * n, np.full(n, -np.inf)
        self.byte_id = np.zeros(256, np.int32)
        step: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        states = 1
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b], self.surface[i], self.logw[i] = i, bytes([b]), -alpha * np.log(2.0 * n)
                continue
            if MARK in piece.lstrip(MARK):
                continue  # none in the public models; it would tie units together
            self.surface[i] = piece.replace(MARK, " ").encode()
            self.logw[i] = -alpha * np.log(2.0 - sp.get_score(i))
            at = 0
            for ch in piece:
                at, states = step.setdefault((at, ord(ch)), states), max(states, step[(at, ord(ch))] + 1) if (at, ord(ch)) in step else states + 1
            ends[at] = i
        keys = np.array([s << 21 | c for s, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(step.values()), np.int64)[order]
        self.end = np.full(states + 1, -1, np.int32)
        self.end[list(ends)] = list(ends.values())
        # Direct addressing for (state, code point), two tries, then a search for the rest.
        self.bits = 20
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.slot[self._hash(self.keys)] = np.arange(len(self.keys))
        self.lens = np.array([len(s) for s in self.surface], np.int64)
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.off = np.concatenate([[0], np.cumsum(self.lens)])
        # Kinds of code points, at which units part.
        self.kind = np.full(0x110000, OTHER, np.uint8)
        self.kind[[ord(c) for c in self._linked()]] = LINKED
        self.kind[ord(" ")], self.kind[ord(MARK)] = SPACE, ALONE

    def _linked(self) -> set[str]:
        """The largest set of characters that no piece has beside a character outside it, but for marks in front."""
        near: dict[str, set[str]] = {}
        for raw in self.surface:
            body = raw.decode("utf-8", "replace").lstrip(" ")
            for a, b in zip(body, body[1:]):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        best: set[str] = set()
        while near:
            met, todo = set(), [min(near)]
            while todo:
                if (c := todo.pop()) not in met:
                    met.add(c)
                    todo += near.pop(c)
            best = max(best, met, key=len)
        return best

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def walk(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Next trie states, -1 where there is none."""
        keys = state << 21 | ch
        i = self.slot[self._hash(keys)]
        hit = (i >= 0) & (self.keys[i] == keys)
        out = np.where(hit, self.next[i], -1)
        miss = np.flatnonzero((i >= 0) & ~hit)  # the slot is another key's
        if len(miss):
            j = np.minimum(np.searchsorted(self.keys, keys[miss]), len(self.keys) - 1)
            out[miss] = np.where(self.keys[j] == keys[miss], self.next[j], -1)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+n[0]-1, start[1] ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


class Sampler:
    """Edges of the lattices of all units seen so far, by node; a node is a unit's character boundary."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.drop()

    def drop(self):
        """Also gives the tables' memory back."""
        self.last = np.zeros(1 << 10, np.int32)  # last node of each unit
        self.first_edge = np.zeros(1 << 10, np.int32)  # by node
        # Of each edge: the probability of it and those before it at its node, in units of 2^-32, for the last 2^32 - 1;
        # whence, -1 for the unit's start; piece.
        self.cum, self.src, self.piece = np.zeros(1 << 10, np.uint32), np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.units = self.nodes = self.edges = 0

    def _append(self, name: str, at: int, new: np.ndarray) -> None:
        """Writes ``new`` from ``at`` on, in place where there is room."""
        a = getattr(self, name)
        if at + len(new) > len(a):
            a = np.concatenate([a[:at], np.zeros(max(at // 2, len(new)), a.dtype)])
            setattr(self, name, a)
        a[at : at + len(new)] = new

    def learn(self, new: list[bytes]) -> None:
        """Forward filtering over new units."""
        p = self.p
        units = [u.decode("utf-8", "surrogatepass") for u in new]
        flat = np.frombuffer("".join(units).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(n)
        flat[[ends[k] - 1 for k, u in enumerate(units) if u == MARK]] = OWN_MARK
        stop = np.repeat(ends, n)
        pos = np.arange(len(flat))
        src, dst, pid = [], [], []
        state = np.zeros(len(flat), np.int64)
        at, length = pos, 0
        while len(at):  # all matches of one length at a time
            nxt = p.walk(state, flat[at + length])
            ok = nxt >= 0
            at, state, length = at[ok], nxt[ok], length + 1
            e = p.end[state]
            found = e >= 0
            src.append(at[found])
            dst.append(at[found] + length)
            pid.append(e[found])
            ok = at + length < stop[at]
            at, state = at[ok], state[ok]
        # Every character can also be spelled in bytes, as one edge (piece -1) of its code point.
        nbytes = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)
        spelled = flat != ord(MARK)
        src, dst, pid = (np.concatenate(x) for x in (src + [pos[spelled]], dst + [pos[spelled] + 1], pid + [-1 - flat[spelled]]))
        logw = np.where(pid >= 0, p.logw[np.maximum(pid, 0)], 0.0)
        logw[pid < 0] = nbytes[src[pid < 0]] * p.logw[p.byte_id[0]]
        # Node numbers: unit u's boundary b is (unit start + u) + b.
        unit = np.repeat(np.arange(len(units)), n)
        shift = unit[src]
        src, dst = src + shift, dst + shift
        begin = ends - n + np.arange(len(units))
        depth = dst - begin[shift]
        order = np.argsort(dst, kind="stable")  # runs of one length each are sorted already
        src, dst, pid, logw, depth, shift = src[order], dst[order], pid[order], logw[order], depth[order], shift[order]
        nodes = len(flat) + len(units)
        first = np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=nodes))])
        la = np.zeros(nodes)
        level = np.argsort(depth.astype(np.int16) if n.max() < 1 << 15 else depth, kind="stable")  # short keys sort by radix
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth)[1:])]) if len(depth) else [0]
        whence, to, v = src[level], dst[level], logw[level]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        sizes = np.diff(np.r_[heads, len(to)])
        for a, b in zip(cuts[:-1], cuts[1:]):  # one boundary of every unit at a time
            if a == b:
                continue
            own = slice(*np.searchsorted(heads, (a, b)))
            head, many = heads[own] - a, sizes[own]
            w = v[a:b]
            w += la[whence[a:b]]
            top = np.maximum.reduceat(w, head)
            w -= np.repeat(top, many)
            np.exp(w, out=w)
            total = np.add.reduceat(w, head)
            la[to[a + head]] = top + np.log(total)
            w /= np.repeat(total, many)
        cum = np.empty(len(src))
        cum[level] = v
        # In whole numbers, so that the sums don't depend on the other units of the batch.
        total = np.concatenate([[0], np.cumsum((cum * (2.0**32 - 1)).astype(np.int64))])
        cum = total[1:] - np.repeat(total[first[:-1]], np.diff(first))
        cum[first[1:][np.diff(first) > 0] - 1] = 2**32 - 1
        for k, u in enumerate(new, self.units):
            self.index[u] = k
        self._append("last", self.units, begin + n + self.nodes)
        self._append("first_edge", self.nodes, first + self.edges)
        for name, values in (("cum", cum), ("src", np.where(src == begin[shift], -1, src + self.nodes)), ("piece", pid)):
            self._append(name, self.edges, values)
        self.units, self.nodes, self.edges = self.units + len(units), self.nodes + nodes, self.edges + len(src)

    def sample(self, distinct: list[bytes], codes: np.ndarray, count: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each row: of ``count`` units, which are places in ``distinct``."""
        if self.edges > CACHE_EDGES:
            self.clear()
        known = list(map(self.index.get, distinct))
        if None in known:
            self.learn([u for u, k in zip(distinct, known) if k is None])
            known = list(map(self.index.get, distinct))
        unit = np.array(known, np.int64)[codes]
        row = np.repeat(np.arange(len(count)), count)
        seed = _mix(seeds[row] + np.arange(len(unit), dtype=np.uint64) - np.repeat(np.cumsum(count) - count, count).astype(np.uint64))
        at, t = np.argsort(unit, kind="stable"), 0  # in the tables' order, so that equal and new units lie side by side
        node = self.last[unit[at]]
        who, what = [], []
        seed, size = seed[at], np.zeros(len(unit), np.int64)
        while len(at):
            e = self.first_edge[node]
            u = np.minimum(_mix(seed + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> np.uint64(32), np.uint64(2**32 - 2)).astype(np.uint32)
            on = np.flatnonzero(self.cum[e] <= u)
            while len(on):  # a node's last edge stops all
                e[on] += 1
                on = on[self.cum[e[on]] <= u[on]]
            who.append(at)
            what.append(self.piece[e])
            node, t = self.src[e], t + 1
            live = node >= 0
            size[at[~live]] = t
            at, node, seed = at[live], node[live], seed[live]
        if not who:
            return [np.zeros(0, np.int32) for _ in count]
        # A unit's pieces came last to first: place each by its step.
        stop = np.cumsum(size)
        ids = np.empty(int(stop[-1]), np.int32)
        for step, (w, x) in enumerate(zip(who, what)):
            ids[stop[w] - 1 - step] = x
        what, who = ids, np.repeat(np.arange(len(unit)), size)
        if (what < 0).any():  # spell in bytes
            odd = what < 0
            chars, which = np.unique(what[odd], return_inverse=True)
            spelled = [[self.p.byte_id[b] for b in (_MARK if c == -1 - OWN_MARK else chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
            size = np.array([len(x) for x in spelled])
            n = np.ones(len(what), np.int64)
            n[odd] = size[which]
            ids = np.repeat(what, n)
            ids[np.repeat(odd, n)] = np.concatenate(spelled)[_runs((np.cumsum(size) - size)[which], size[which])]
            what, who = ids, np.repeat(who, n)
        return np.split(what.astype(np.int32), np.cumsum(np.bincount(row[who], minlength=len(count)))[:-1])


def row_seed(key) -> int:
    """First 8 bytes of the SHA-256 of the key as text; a null key has a seed of its own."""
    return int.from_bytes(hashlib.sha256(b"\0" if key is None or key != key else str(key).encode()).digest()[:8], "little")


_WORKER: dict = {}


def _sampler(blob: bytes, alpha: float) -> Sampler:
    k = (hashlib.sha256(blob).digest(), alpha)
    if k not in _WORKER:
        _WORKER.clear()
        _WORKER[k] = Sampler(Pieces(blob, alpha))
    return _WORKER[k]


def _vocabulary(df: DataFrame, model: str | None):
    with open(model or default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _chunks(column):
    """(from, to) of slices of about CHUNK_BYTES of a string or binary column, one row at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size, dtype=np.int64) // CHUNK_BYTES
    starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]).tolist() if len(cut) else []
    return zip(starts, [*starts[1:], len(cut)])


def encode(docs: DataFrame, model: str | None = None, alpha: float = 1.0, key: str = "doc_id", keep=("doc_id",), check: bool = False) -> DataFrame:
    """Columns ``keep``, and ``n_pieces`` and ``piece_ids`` (32-bit little-endian ids, packed) of a sampled segmentation.

    The draw depends on the row's key and text alone: repeated rows get one segmentation. Null texts
    have null ids and no pieces, empty texts empty ids. With ``check``, ``lossless`` tells whether the
    packed ids decode to the very bytes of the text; a null text counts as lossless. Columns of
    ``keep`` go through as they are, whatever their type; a column of it named as one of the new ones gives way.
    """
    blob = _vocabulary(docs, model)
    new = {"n_pieces": IntegerType(), "piece_ids": BinaryType()} | ({"lossless": BooleanType()} if check else {})
    keep = [c for c in dict.fromkeys(keep) if c not in new]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, t) for c, t in new.items()])

    def run(batches):
        sampler = _sampler(blob.value, alpha)
        for batch in batches:
            place = batch.schema.get_field_index
            texts_all, keys = batch.column(place("text")), batch.column(place(key))
            for lo, hi in _chunks(texts_all):
                texts = texts_all.slice(lo, hi - lo).to_pylist()
                ids = segment(sampler, [x or "" for x in texts], np.array([row_seed(k) for k in keys.slice(lo, hi - lo).to_pylist()], np.uint64))
                packed = [None if x is None else i.astype("<i4").tobytes() for x, i in zip(texts, ids)]
                made = [pa.array([len(i) for i in ids], pa.int32()), pa.array(packed, pa.binary())]
                if check:
                    back = [x is None or decode_ids(sampler.p, np.frombuffer(raw, "<i4")) == x.encode("utf-8", "surrogatepass") for x, raw in zip(texts, packed)]
                    made.append(pa.array(back, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(place(c)).slice(lo, hi - lo) for c in keep), *made], names=schema.names)
        sampler.drop()  # a task of usual size fills the cache about once, so the next one loses little
        trim()

    return docs.select(*dict.fromkeys([*keep, key, "text"])).mapInArrow(run, schema)


def split_units(pieces: Pieces, texts: list[str]):
    """(distinct units as UTF-8, the place among them of each unit of the texts in turn, number of units of each text).

    Units are still with spaces in place of marks; a mark of a text's own is a unit alone.
    """
    ends = np.cumsum([len(x) for x in texts])
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = pieces.kind[points]
    before, after = kind[:-1], kind[1:]
    first = np.ones(len(points) + 1, bool)
    first[1:-1] = (before != after) & (before != SPACE) | (before == ALONE) | (after == ALONE)
    first[ends] = True
    at = np.flatnonzero(first)
    raw = whole.encode("utf-8", "surrogatepass")
    offset = np.append(np.flatnonzero(np.frombuffer(raw, np.int8) >= -64), len(raw))[at]  # a character's first byte
    units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offset), pa.py_buffer(raw)]).dictionary_encode()
    return units.dictionary.to_pylist(), units.indices.to_numpy(), np.diff(np.searchsorted(at, ends), prepend=0)


def segment(sampler: Sampler, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each text; a literal mark is spelled as the mark's bytes."""
    return sampler.sample(*split_units(sampler.p, texts), seeds)


def decode_ids(pieces: Pieces, ids: np.ndarray) -> bytes:
    """UTF-8 bytes of a segmentation, exactly those of the text that was encoded."""
    ids = ids.astype(np.int64)
    return pieces.flat[_runs(pieces.off[ids], pieces.lens[ids])].tobytes()


_DECODERS: dict = {}


def decode(df: DataFrame, model: str | None = None) -> DataFrame:
    """Replaces ``piece_ids`` by the ``decoded`` text, exactly the text that was encoded; null ids give null.

    Other columns are kept as they are, but one named decoded gives way. Ids of another model don't decode to the text.
    """
    blob = _vocabulary(df, model)
    rest = [c for c in df.columns if c not in ("piece_ids", "decoded")]

    def run(column):
        name = hashlib.sha256(blob.value).digest()
        if name not in _DECODERS:
            _DECODERS.clear()
            _DECODERS[name] = Pieces(blob.value)
        p = _DECODERS[name]
        return ([None if raw is None else decode_ids(p, np.frombuffer(raw, "<i4")).decode("utf-8", "surrogatepass") for raw in column.to_pylist()],)

    return map_columns(df, rest, ["piece_ids"], run, "decoded string", 256)


def op6(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), check=True)
