"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are words of a fixed lexicon, words and character 4-grams mined from labelled rows, and the
annotators' labels themselves. The label model gives each voter a rate of firing in toxic and in
clean texts and a weight for its correlations with other voters. Rates are re-estimated over the vote
patterns of all documents, correlations and the annotators' own rates over the labelled sample. A
logistic classifier over voters and 4-grams is then trained on the model's posterior labels, of
labelled rows and of rows that no one has labelled. Only counts, votes and feature bits of the
samples reach the driver, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER_BYTES, held_out, map_columns, materialize, release, table, trim

#: Abusive words of the four languages of the corpus.
LEXICON = (
    "arschloch basura bastard clown connard crétin depp disgusting dumm estúpido idiot idiota imbécile imbécil "
    "loser moron müll pathetic patético pathétique salaud scum stupid stupide trash trottel worthless"
).split()
#: Labelled rows that learning may use, and rows without a label that the classifier is fitted on besides: documented bounds on samples drawn by hash.
FIT_ROWS, MORE_ROWS = 12_000, 6_000
MINED_WORDS, MINED_GRAMS, GRAM_FEATURES, BUCKETS = 24, 24, 2048, 1 << 16
#: Rows that a task turns into Python's strings at a time.
ROWS = 1024
#: Where the annotators' rates start, and the pseudo-rows that hold a rate near its start.
EM_ROUNDS, ANNOTATOR, STRENGTH = 4, (0.97, 0.01), 50.0
_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_words(text) -> set[bytes]:
    """Distinct words: runs of ASCII letters, digits and bytes of other characters, A to Z lower-cased."""
    return set((text or "").encode("utf-8", "replace").translate(_TO_WORDS).split())


def text_grams(text) -> np.ndarray:
    """Buckets of the distinct byte 4-grams of the whole lower-cased text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(LOWER_BYTES), np.uint8)
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    seen = np.zeros(BUCKETS, bool)
    for k in range(4):  # four views of aligned words instead of shifts
        n = (len(raw) - k) // 4
        g = np.frombuffer(raw[k : k + 4 * n].tobytes(), "<u4")
        seen[(g * np.uint32(2654435761)) >> np.uint32(16)] = True
    return np.flatnonzero(seen)


def _log_odds(fires: np.ndarray, y: np.ndarray):
    """Smoothed rates of firing in toxic and clean rows."""
    return (fires[y].sum(axis=0) + 0.5) / (y.sum() + 1.0), (fires[~y].sum(axis=0) + 0.5) / ((~y).sum() + 1.0)


class LabelModel:
    """Bernoulli voters given the hidden label; a voter that moves with others counts for less."""

    def __init__(self, prior: float, toxic: np.ndarray, clean: np.ndarray, weight: np.ndarray, annotator=ANNOTATOR):
        self.prior, self.toxic, self.clean, self.weight, self.annotator = prior, toxic, clean, weight, annotator

    @classmethod
    def start(cls, votes: np.ndarray, y: np.ndarray) -> LabelModel:
        a, b = _log_odds(votes, y)
        return cls(min(max(y.mean(), 0.01), 0.5), a, b, cls.weights(votes, y.astype(float)))

    @staticmethod
    def weights(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Weights by the votes' correlation within each label, rows counting for a label by its posterior."""
        weight = np.ones(votes.shape[1])
        for share in (p, 1 - p):
            v = (votes - share @ votes / max(share.sum(), 1e-9)) * np.sqrt(share)[:, None]
            sd = np.sqrt((v**2).sum(axis=0)) + 1e-9
            c = np.abs(v.T @ v) / np.outer(sd, sd)
            np.fill_diagonal(c, 0)
            weight = np.minimum(weight, 1 / (1 + np.where(c > 0.2, c, 0).sum(axis=0)))
        return weight

    def annotators(self, votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Rates of a toxic label in toxic and in clean rows, by the posteriors under the rates so far."""
        p = self.posterior(votes, y)
        return tuple(float((share @ y + STRENGTH * r) / (share.sum() + STRENGTH)) for share, r in zip((p, 1 - p), ANNOTATOR))

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """P(toxic); ``label`` (1, 0 or nan) is one more voter, with the annotators' rates."""
        z = np.log(self.prior / (1 - self.prior)) + (votes * (np.log(self.toxic / self.clean) - np.log((1 - self.toxic) / (1 - self.clean))) + np.log((1 - self.toxic) / (1 - self.clean))) @ self.weight
        if label is not None:
            hit, false = np.clip(self.annotator, 1e-4, 1 - 1e-4)
            z = z + np.where(label == 1, np.log(hit / false), np.where(label == 0, np.log((1 - hit) / (1 - false)), 0))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _parts(x: np.ndarray, rows: int = 1024):
    """Slices of small-integer features as floats, so that only a slice is ever held so."""
    for k in range(0, len(x), rows):
        yield slice(k, k + rows), x[k : k + rows].astype(np.float32)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([p @ w for _, p in _parts(x)])


def _logistic(x: np.ndarray, target: np.ndarray, l2: float = 3.0, rounds: int = 120):
    """Logistic regression on soft targets by accelerated gradient steps; (weights, bias)."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(target.mean() / (1 - target.mean())))
    mw, mb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(x[:512].astype(np.float32)) ** 2 / max(1, min(512, len(x))) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(_times(x, mw) + mb, -30, 30)))
        g = (p - target).astype(np.float32)
        nw, nb = mw - step * (sum(p.T @ g[k] for k, p in _parts(x)) / len(x) + l2 * mw / len(x)), mb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, b


def _threshold(x: np.ndarray, target: np.ndarray, more: np.ndarray, guess: np.ndarray) -> np.float32:
    """Log odds that best part toxic from clean rows, each half judged by a fit on the other half and on ``more`` rows."""
    z, half = np.empty(len(x)), np.arange(len(x)) % 2 == 0
    for side in (half, ~half):
        if not 0 < (target[side] > 0.5).sum() < side.sum():
            return np.float32(0)
        w, b = _logistic(np.concatenate([x[side], more]), np.concatenate([target[side], guess]))
        z[~side] = _times(x[~side], w) + b
    order = np.argsort(z)
    t = target[order]
    # Weighted so that a clean row lost costs as much as two toxic rows missed.
    cost = np.concatenate([[0], np.cumsum(t)]) + 2 * np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    edges = np.concatenate([[z[order[0]] - 1], z[order], [z[order[-1]] + 1]])
    return np.float32(np.clip(np.mean([(edges[k] + edges[k + 1]) / 2 for k in best]), -3, 3))


class Model:
    """Voters, label model and classifier; small, of a size that no input changes."""

    def __init__(self, lexicon=LEXICON):
        self.words = [w.encode().translate(_TO_WORDS) for w in lexicon]
        self.vote_grams = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.int64)
        self.labels = None
        self.w, self.b = None, -3.0

    @property
    def n_votes(self) -> int:
        return len(self.words) + len(self.vote_grams)

    def votes(self, words: set, grams: np.ndarray) -> np.ndarray:
        seen = np.zeros(BUCKETS, bool)
        seen[grams] = True
        return np.concatenate([np.array([w in words for w in self.words], bool), seen[self.vote_grams]]).astype(np.float32)

    def mine(self, words: list[bytes], counts: np.ndarray, toxic: int, clean: int) -> None:
        """Mined words join the voters; so do 4-grams (``counts`` of clean and toxic rows by bucket) that fire in toxic rows alone, near enough."""
        self.words += [w for w in words if w not in self.words][:MINED_WORDS]
        rate = _sure(counts[1], counts[0], toxic, clean)
        often = (rate > 0.9) & (counts[1] >= _least(toxic))
        order = np.argsort(-(counts[1] * rate) * often, kind="stable")[:MINED_GRAMS]
        self.vote_grams = order[often[order]]
        p, q = (counts[1] + 0.5) / (toxic + 1), (counts[0] + 0.5) / (clean + 1)
        gain = np.abs(np.log(p / q)) * np.sqrt(np.maximum(p, q) * (1 - np.minimum(p, q)))
        self.grams = np.sort(np.argsort(-gain, kind="stable")[:GRAM_FEATURES])

    def features(self, words: set, grams: np.ndarray) -> np.ndarray:
        """Votes (weighing more, as they are few) and the selected 4-grams."""
        seen = np.zeros(BUCKETS, np.float32)
        seen[grams] = 1
        return np.concatenate([3 * self.votes(words, grams), seen[self.grams]])

    def score(self, text) -> float:
        if self.w is None:
            return float(1 / (1 + np.exp(-self.b)))
        x = self.features(text_words(text), text_grams(text))
        return float(1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30))))


def _least(toxic: int) -> int:
    """Toxic rows that a mined voter must fire in."""
    return max(3, toxic // 100)


def _sure(hit, miss, toxic: int, clean: int):
    """Share of a voter's firings that are in toxic rows, if both kinds were as many."""
    return (hit + 0.5) / (hit + miss * (max(1, toxic) / max(1, clean)) + 1)


def _sample(docs: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """Texts of the chosen ids (doc_id, toxic), one for each; of several texts of one id the least."""
    # At most the sample's bound of ids: a proven bound for the broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(met.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), label)


def _mine(model: Model, rows: DataFrame, toxic: int, clean: int) -> None:
    """Counts words and 4-grams of the sample in the cluster; candidates that are sure enough come back."""

    def words(batches):
        for pdf in batches:
            found = [(w, int(t)) for x, t in zip(pdf["text"], pdf["toxic"]) for w in text_words(x)]
            yield pd.DataFrame(found, columns=["w", "t"])
        pdf = found = None
        trim()

    def grams(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            for x, t in zip(pdf["text"], pdf["toxic"]):
                total[int(t == 1), text_grams(x)] += 1
        pdf = None
        trim()
        b = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"b": b, "clean": total[0, b], "toxic": total[1, b]})

    n = rows.select("text", "toxic").mapInPandas(words, "w binary, t int").groupBy("w").agg(F.sum("t").alias("hit"), F.count("*").alias("n")).where(F.col("hit") >= _least(toxic))
    sure = n.withColumn("sure", _sure(F.col("hit"), F.col("n") - F.col("hit"), toxic, clean)).where("sure > 0.9")
    best = sure.orderBy(F.desc(F.col("hit") * F.col("sure")), "w").limit(MINED_WORDS + len(model.words)).collect()
    counted = rows.select("text", "toxic").mapInPandas(grams, "b int, clean long, toxic long").groupBy("b").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS rows at most
    counts = np.zeros((2, BUCKETS))
    counts[:, counted["b"]] = counted[["clean", "toxic"]].to_numpy().T
    model.mine([bytes(r["w"]) for r in best], counts, toxic, clean)


def _bits(model: Model, rows: DataFrame):
    """(feature bits, labels) of a sample, on the driver, in order of a hash of the id."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts, toxic):
        return ([np.packbits(shared.value.features(text_words(x), text_grams(x)) > 0).tobytes() for x in texts.to_pylist()],)

    got = map_columns(rows.withColumn("h", F.xxhash64("doc_id")), ["h", "toxic"], ["doc_id", "text", "toxic"], run, "bits binary").orderBy("h", "toxic", "bits").toPandas()
    n = model.n_votes + len(model.grams)
    bits = np.frombuffer(b"".join(map(bytes, got["bits"])), np.uint8).reshape(len(got), -1)
    return np.unpackbits(bits, axis=1)[:, :n], got["toxic"].to_numpy(float, na_value=np.nan)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, more_rows: int = MORE_ROWS, lexicon=LEXICON) -> Model:
    """Train on labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``fit_rows``, the least by hash.

    The classifier also sees rows without a label, none of them held out, under the label model's
    posteriors: of ``more_rows`` of them those for which any voter fires. Labels other than 1 count as clean, null ones and those of null ids not
    at all. Repeated labels of one id: the larger counts. Of repeated documents one text counts in
    the samples (the least), every row in the rates. Without labelled rows, or with one label only,
    the lexicon votes alone. Columns other than doc_id, text and toxic are ignored.
    """
    model = Model(lexicon)
    learn = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    told = learn(labels).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = _sample(docs, first(told, fit_rows), "toxicity-sample")
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if toxic and clean:
        _mine(model, rows, toxic, clean)
        x, y = _bits(model, rows)
        votes = x[:, : model.n_votes].astype(np.float32)
        model.labels = LabelModel.start(votes, y == 1)
        _refine(model, docs, votes, y)
        target = np.clip(model.labels.posterior(votes, y), 0.001, 0.999)
        rest = first(learn(docs.select("doc_id")).join(told, "doc_id", "left_anti").distinct(), more_rows).withColumn("toxic", F.lit(None).cast("int"))
        more = _sample(docs, rest, "toxicity-more")
        unlabelled, _ = _bits(model, more)
        unlabelled = unlabelled[unlabelled[:, : model.n_votes].any(axis=1)]  # where all abstain there is no evidence to learn from
        guess = np.clip(model.labels.posterior(unlabelled[:, : model.n_votes].astype(np.float32)), 0.001, 0.999)
        scale = np.r_[np.full(model.n_votes, 3, np.uint8), np.ones(len(model.grams), np.uint8)]  # as in Model.features
        x, unlabelled = x * scale, unlabelled * scale
        model.w, model.b = _logistic(np.concatenate([x, unlabelled]), np.concatenate([target, guess]))
        model.b -= _threshold(x, target, unlabelled, guess)
        release(more)
    else:
        model.w, model.b = 3 * np.ones(model.n_votes, np.float32), np.float32(-3)
    release(rows)
    return model


def _refine(model: Model, docs: DataFrame, sample: np.ndarray, y: np.ndarray) -> None:
    """Expectation maximisation over the vote patterns of all documents, counted in the cluster.

    The annotators' rates and the correlation weights follow from the labelled sample's votes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches):
        seen: dict[bytes, int] = {}
        for pdf in batches:
            for x in pdf["text"]:
                k = np.packbits(shared.value.votes(text_words(x), text_grams(x)).astype(bool)).tobytes()
                seen[k] = seen.get(k, 0) + 1
            if len(seen) > 100_000:
                yield pd.DataFrame({"votes": list(seen), "n": list(seen.values())})
                seen = {}
        pdf = None
        trim()
        yield pd.DataFrame({"votes": list(seen), "n": list(seen.values())})

    m = model.n_votes
    patterns = materialize(docs.select("text").mapInPandas(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")), "toxicity-votes")
    for _ in range(EM_ROUNDS):
        lm = model.labels

        def expect(batches):
            total = np.zeros((3, m))
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.unpackbits(np.frombuffer(b"".join(map(bytes, pdf["votes"])), np.uint8).reshape(len(pdf), -1), axis=1)[:, :m].astype(float)
                n, p = pdf["n"].to_numpy(float), lm.posterior(v)
                total += np.stack([(n * p) @ v, n @ v, np.full(m, n @ p)])
                expect.rows += n.sum()
            yield pd.DataFrame({"sums": [np.concatenate([total.ravel(), [expect.rows]]).tolist()]})

        expect.rows = 0.0
        # One fixed-size row a partition, summed by place in the cluster.
        parts = patterns.mapInPandas(expect, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        hit, all_, toxic, rows = parts[:m], parts[m : 2 * m], parts[2 * m], parts[-1]
        a = (hit + STRENGTH * lm.toxic) / (toxic + STRENGTH)
        b = (all_ - hit + STRENGTH * lm.clean) / (rows - toxic + STRENGTH)
        weight, annotator = lm.weights(sample, lm.posterior(sample, y)), lm.annotators(sample, y)
        model.labels = LabelModel(min(max(toxic / max(rows, 1), 0.005), 0.5), np.clip(a, 1e-4, 0.9), np.clip(b, 1e-6, 0.5), weight, annotator)
    release(patterns)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each whole text; null counts as empty; repeated rows score alike; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_columns(docs, ["doc_id"], ["text"], lambda texts: ([shared.value.score(x) for x in texts.to_pylist()],), "score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns as they are, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([shared.value.score(x) < threshold for x in texts], pa.bool_()))
        whole = batch = texts = None
        trim()

    return docs.mapInArrow(run, docs.schema)


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
