import hashlib
import pickle
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import decontaminate, license_scan, line_dedup, lm_score, minhash_dedup, queries, sentencepiece_sampling, suffix_dedup, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, very long lines, ties and repeated rows."""
    long = " ".join(f"w{i % 700}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "one"), (4, long), (5, long), (6, "a b c d e f g\n\na b c d e f g"), (6, "a b c d e f g\n\na b c d e f g"), (7, "▁ \x00é\ud7ff\t"), (8, " \n \n"), (None, "alone here")]
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    pick = lambda cols, rows: sorted(str(tuple(r[cols.index(c)] for c in sorted(cols))) for r in rows)
    assert pick(df.columns, df.collect()) == pick(columns, want.fetchall())


def _docs(duck):
    return [(d, t or "") for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()]


def test_suffix_dedup_against_brute_force(spark, duck):
    want = suffix_dedup.brute_force([(d, t.encode()) for d, t in _docs(duck)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_suffix_family_merges_and_finds():
    rng = random.Random(1)
    raw = [(d, bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(40, 300)))) for d in range(30)] + [(40, b"x" * 400), (41, b"x" * 300)]
    want = suffix_dedup.brute_force(raw)
    at = [suffix_dedup.anchors(r)[0] for _, r in raw]
    doc = np.concatenate([np.full(len(a), d) for a, (d, _) in zip(at, raw)])
    lo = np.concatenate([np.maximum(a - suffix_dedup.WINDOW + 1, 0) for a in at])
    pos = np.concatenate(at)
    by = dict(raw)
    ctx = [by[d][l : p + suffix_dedup.SPAN] for d, l, p in zip(doc, lo, pos)]
    for batch in (64, 10**6):
        starts = {}
        for d, s in suffix_dedup.covered(doc, pos, lo, ctx, batch):
            for a, b in zip(d, s):
                starts.setdefault(int(a), set()).add(int(b))
        for d, r in raw:
            s = np.array(sorted(starts.get(d, ())), np.int64)
            assert suffix_dedup.cut(r, s, s + 50)[:2] == want[d][1:3]


def test_lm_counts_against_brute_force(spark, duck):
    import math
    from collections import Counter

    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    toks = {d: re.findall(r"[^\x20\x09-\x0d]+", t.translate(low)) + ["\0"] for d, t in _docs(duck)}
    c = Counter(w for d, ws in toks.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in queries.QUERIES["op1_lm_score"](spark, SF).collect():
        ws = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0


def test_lm_counting_holds_little_beside_what_it_has_gathered(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH_BYTES", 4 << 20)
    with open(lm_score.default_vocabulary(), "rb") as f:
        raw = f.read()

    class Rows:
        """Gives the function that a worker runs, over Arrow batches."""

        select = lambda self, *_: self
        mapInArrow = lambda self, fn, _: fn
        mapInPandas = lambda self, fn, _: lambda it: fn(b.to_pandas() for b in it)

    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60_000, 400)) for _ in range(3000)]
    batch = lambda part: pa.RecordBatch.from_pydict({"text": part, "doc_id": list(range(len(part)))})
    run = lm_score.count(Rows(), type("Blob", (), {"value": raw}), 8)
    for _ in run(iter([batch(texts)])):  # every word is known from now on
        pass
    made = iter(run(iter([batch(texts)])))
    tracemalloc.start()
    try:
        next(made)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * lm_score.FLUSH_BYTES


def test_lm_scores_each_token_once_and_sums_to_one():
    rng = np.random.default_rng(0)
    prev, cur = rng.integers(0, 20, 300), rng.integers(0, 20, 300)
    m = lm_score.Model(np.arange(20), (prev, cur, np.ones(300)), 5)
    m.p["C"] = rng.standard_normal(m.p["C"].shape).astype(np.float32)
    x = rng.integers(0, 20, (1, 9))
    total = sum(np.exp(m.log_prob(x, np.full_like(x, y))) * (5 if y == 20 else 1) for y in range(21))
    assert np.allclose(total, 1, atol=1e-4)
    seq = rng.integers(0, 20, 100).astype(np.uint16)
    lp = [m.log_prob(seq[None, s : s + 32].astype(int), seq[None, s + 1 : s + 33].astype(int))[0] for s in (0, 28, 56)]
    tail = m.log_prob(seq[None, 84:99].astype(int), seq[None, 85:100].astype(int))[0][4:]
    assert m.score([seq])[0] * np.log(10) == pytest.approx(lp[0].sum() + lp[1][4:].sum() + lp[2][4:].sum() + tail.sum(), rel=1e-4)


def test_lm_model_travels_without_entries_for_pairs_that_never_occur():
    rng = np.random.default_rng(0)
    prev, cur = rng.integers(0, 1200, 5000), rng.integers(0, 1200, 5000)
    for counts in (None, np.ones(lm_score.RAW_IDS)):
        m = lm_score.Model(np.arange(1000), (prev, cur, np.ones(5000)), 5, counts)
        c = np.zeros((1001, 1001))
        np.add.at(c, (np.minimum(prev, 1000), np.minimum(cur, 1000)), 1)
        uni = (c.sum(axis=0) + 0.5) / (c.sum(axis=0) + 0.5).sum()
        kinds = (c > 0).sum(axis=1, keepdims=True) + 1
        want = np.log((c + kinds * uni) / (c.sum(axis=1, keepdims=True) + kinds))
        want[:, 1000] -= np.log(5) if counts is None else 0
        x, y = np.divmod(np.arange(1001 * 1001), 1001)
        assert np.allclose(m.log_prior(x, y), want.ravel(), atol=1e-4)
        assert len(pickle.dumps(m.for_training())) < len(pickle.dumps(m)) < 2_500_000  # a full table has 4 MB


def test_lm_trains_on_every_subword_of_long_texts(spark):
    docs = [(i, " ".join(f"w{(i * j) % 700}" for j in range(n))) for i, n in enumerate((0, 3, 5000))]
    with open(lm_score.default_vocabulary(), "rb") as f:
        raw = f.read()
    words = lm_score.Words(raw)
    want = [words.subwords(words.look_up([lm_score.split_words(t)])[0]) for _, t in docs]
    rows = lm_score.count(spark.createDataFrame(docs, "doc_id long, text string"), spark.sparkContext.broadcast(raw), 8).where("kind = 't'").collect()
    wins = np.concatenate([np.frombuffer(bytes(r.a), "<u2").reshape(-1, lm_score.WINDOW + 1) for r in rows])
    pairs = [tuple(x) for w in wins for x in zip(w[:-1].tolist(), w[1:].tolist()) if x[1] != lm_score.PAD]
    assert sorted(pairs) == sorted(x for ids in want for x in zip(ids[:-1].tolist(), ids[1:].tolist()))


def test_sentencepiece_is_lossless_reproducible_and_fits_the_model(spark, odd):
    rows = sentencepiece_sampling.encode(odd, check=True).collect()
    assert all(r.lossless for r in rows) and len(rows) == odd.count()
    assert {(r.n_pieces, r.piece_ids) for r in rows if r.doc_id == 1} == {(0, None)} and {(r.n_pieces, bytes(r.piece_ids)) for r in rows if r.doc_id == 2} == {(0, b"")}
    again = sentencepiece_sampling.encode(odd.repartition(3), check=True).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.piece_ids)) for r in rs)
    assert key(rows) == key(again) and sentencepiece_sampling.encode(odd.limit(0)).count() == 0
    other = odd.selectExpr("doc_id", "text", "lang AS n_pieces", "cast(doc_id AS string) AS decoded")
    back = sentencepiece_sampling.decode(sentencepiece_sampling.encode(other, keep=("doc_id", "text", "n_pieces", "decoded"))).collect()
    assert len(back) == len(rows) and all(r.decoded == r.text and isinstance(r.n_pieces, int) for r in back)
    text_ids = odd.selectExpr("cast(doc_id AS decimal(20, 0)) AS doc_id", "text")
    assert sentencepiece_sampling.encode(text_ids, check=True).where("NOT lossless").count() == 0
    with open(sentencepiece_sampling.default_model(), "rb") as f:
        p = sentencepiece_sampling.Pieces(f.read())
    seeds = np.arange(4000, dtype=np.uint64)
    got = [tuple(x) for x in sentencepiece_sampling.segment(sentencepiece_sampling.Sampler(p), ["ab"] * 4000, seeds)]
    weight = {}
    for cut in [("ab",), ("a", "b")]:  # brute force over the lattice of "ab"
        ids = [np.flatnonzero([s == c.encode() for s in p.surface]) for c in cut]
        ids = [[i for i in x if np.isfinite(p.logw[i])] for x in ids]
        from itertools import product

        for combo in product(*ids):
            weight[combo] = float(np.exp(sum(p.logw[i] for i in combo)))
    total = sum(weight.values())
    for combo, w in weight.items():
        assert abs(got.count(combo) / 4000 - w / total) < 0.05


def test_toxicity_on_held_out_rows(spark, duck):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{sf}/labels.parquet' GROUP BY 1").fetchall())
    rows = [r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect() if r.doc_id in labels]
    pos, neg = [r.score for r in rows if labels[r.doc_id] == 1], [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95 and np.mean([n >= 0.5 for n in neg]) < 0.03


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())


def test_url_rules_and_mining(spark):
    urls = ["https://a.com/en/1"] * 30 + ["http://example.com/en/7x", "ftp://EXAMPLE.com/en/7", "net/de", None, "x://b.net/de/8", "x://example.net/de/8#z", "x://com/en", "x://q.com/zz/en/3"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) and by[0].rule == "com/en/" and by[30].rule == by[31].rule == "example.com/en/7" and by[31].host == "example.com"
    assert by[32].host == by[33].host == "" and by[34].rule == "net/de/" and by[35].verdict == "block" and by[36].rule is None and by[37].verdict == "block" and by[37].mined


def test_mined_rules_against_counting(spark):
    rows = [(["a", "b"], "block")] * 9 + [(["a", "c"], "allow")] + [(["c"], None)] * 5
    rules = {(tuple(r["items"]), r.verdict): round(r.confidence, 6) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string")).collect()}
    assert rules == {(("a",), "block"): 0.9, (("b",), "block"): 1.0, (("a", "c"), "allow"): 1.0}


@pytest.mark.parametrize("op", [line_dedup.dedup_lines, minhash_dedup.near_duplicates, suffix_dedup.dedup_spans, license_scan.scan, lm_score.score])
def test_odd_and_empty_tables(spark, odd, op):
    assert op(odd).count() == odd.count()
    assert op(odd.limit(0)).count() == 0


def test_line_dedup_keeps_first_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta\n\nalpha beta", 9), (2, "Beta  alpha\nnew", 9), (3, None, 9)], "doc_id long, text string, n long")
    got = {r.doc_id: (r.text, r.n) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("alpha beta\n", 9), 2: ("new", 9), 3: (None, 9)}


def test_line_dedup_of_a_large_group_against_brute_force(spark):
    """Lines that are similar to some of a thousand others, through chains too, and case variants."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(rng.choice(("x", "y", "z", w)) + str(rng.randrange(9)) if rng.random() < 0.12 else w for w in base) for _ in range(1200)]
    lines += [" ".join(rng.sample(base, 18)).upper() for _ in range(30)] + [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(153)]
    seen, want = [], {}
    for i, text in docs:
        stay = []
        for line in text.split("\n"):
            ws = set(line.lower().split())
            if not any(5 * len(ws & o) >= 4 * len(ws | o) for o in seen):
                stay.append(line)
            seen.append(ws)
        want[i] = "\n".join(stay)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len(t) for _, t in docs)


def test_line_dedup_of_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "alpha beta\nalpha beta", 7, 8, 9, "k"), (1, "alpha beta\nalpha beta", 7, 8, 9, "k")], "doc_id long, text string, n_lines int, n_removed int, pos int, kept string")
    assert {tuple(r) for r in line_dedup.remove_lines(docs).collect()} == {(1, "alpha beta", 7, 8, 9, "k")}
    assert [(r.n_lines, r.n_removed, r.pos, r.kept) for r in line_dedup.dedup_lines(docs).collect()] == [(2, 1, 9, "k")] * 2


def test_near_duplicates_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd).collect()}
    assert (4, True, 4, True) in got and (5, True, 4, False) in got and (1, False, 1, True) in got and (2, False, 2, True) in got


def test_decontamination_catches_other_parameters_and_mixed_slots(spark):
    item = "the farmer Bob has 3 red apples and then Bob buys 5 more red apples today"
    docs = [(1, "so the farmer Zoe has 7 red apples and then Zoe buys 9 more red apples today"), (2, "the farmer Zoe has 7 red apples and then Ann buys 9 more red apples today"), (3, "nothing of the kind"), (4, None), (5, "")]
    bench = spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1}


def test_decontamination_checks_slots_by_place(spark):
    item = "the farmer Bob has 3 red apples and then Bob buys 5 more red apples today"
    variant = "the farmer Zoe has 10 red apples and then Zoe buys 95 more red apples today"
    long = "we count 12 blue cups on the left shelf of the old kitchen and also 12 blue plates on the right shelf of the very same old kitchen"
    docs = [(1, f"{item} or {variant}"), (2, long.replace("12", "13", 1)), (3, variant.replace("95", "10")), (4, item.replace("then", "just then")), (5, variant.replace("then Zoe", "then Ann"))]
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got >= {(1, 1), (2, 2), (3, 1)} and (5, 1) not in got


def test_decontamination_of_names_that_open_sentences_and_lines(spark):
    item = "Tom has 3 apples. Tom buys 5 more. Tom eats 2. How many apples are left?"
    plain = "one day the baker gave Mary Jones 4 loaves of the very best white bread"
    docs = [(1, item.replace("Tom", "Anna").replace("3", "8")), (2, "so " + item.replace("How", "how")), (3, "Here: " + plain.replace(" Mary", "\nMary")), (4, item.replace("apples", "plums").replace("more", "extra")), (5, item.replace(". How", " how"))]
    bench = spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_matched == r.n_windows) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (2, True), 5: (1, True)}


def test_decontamination_query_matches_its_sql_on_names_and_mixed_slots(spark, tmp_path):
    item = "the farmer Bob has 3 red apples and then Bob buys 5 more red apples today"
    variant = item.replace("Bob", "Zoe").replace("3", "10").replace("5", "95")
    plain = "Tom has 3 apples and he eats two. Tom buys 5 more pears. How many are left in the box?"
    texts = [f"{item} or {variant}", variant, variant.replace("95", "10"), plain, plain.replace("Tom", "Anna").replace("3", "8"), "So " + plain, f"{variant}\n{variant}", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, plain), (3, None), (None, item), (4, "Short One")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, item_id, n_windows, n_matched FROM ({decontaminate.SQL})").fetchall())
    assert want and sorted(map(tuple, decontaminate.op3(spark, str(tmp_path)).select("doc_id", "item_id", "n_windows", "n_matched").collect())) == want


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (20, [float("nan"), 1.0]), (1, None), (2, [None, 1.0]), (3, [1.0, 0.5]), (4, [1.0, 0.5]), (40, [2.0**40, 1.0]), (5, [1.0]), (None, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", lambda i: i % 20 == 0, k=3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 40), (2, 3), (3, 4)]
    assert {r.query_id for r in got} == {0, 40}


def test_ball_tree_shards_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).round(1)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    got = topk.top_k(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", lambda i: i % 20 == 0, k=5).collect()
    q = np.floor(64 * x).astype(int)
    for i in range(0, 300, 20):
        want = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def test_license_scan_units(spark):
    docs = [(1, "x\nReleased under the MIT licence\nReleased under the MIT License!"), (2, "Permission is hereby granted,\n" + license_scan.TEMPLATES["mit-grant"][31:]), (3, None)]
    got = {r.doc_id: (r.n_hits, r.license) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (1, "mit") and got[2][1] == "mit-grant" and got[3] == (0, None)


def test_license_scan_inside_longer_units():
    scanner, isc = license_scan.Scanner(), license_scan.TEMPLATES["isc"].replace(", ", ",\n")
    mid = scanner.scan("All of it is new. Released under the MIT License; see the LICENSE file for more about it.")
    assert [(h[0], h[2]) for h in mid] == [("window", "mit")] and mid[0][3] == 1.0
    glued = scanner.scan("# tool\n" + isc + "\n" + "\n".join(f"x{i} = call(y{i}, z{i})" for i in range(60)))
    assert [(h[0], h[2]) for h in glued] == [("window", "isc")]
    assert [h[0] for h in scanner.scan("a b c d\nReleased under the MIT License.\ne f g h")] == ["line"] and scanner.scan("released under the moon") == []


def test_rows_without_an_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (None, a + " tail"), (None, "x " * 20 + b + " " + a), (None, "short"), (None, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup_spans(docs).where("doc_id IS NULL").collect())
    cut_b = ("x " * 20 + b + " ").encode()
    assert [len(k) for _, k in got[:3]] == [0, 5, 5] and got[3][1] == b" tail" and got[4][1].startswith(cut_b[:-1])
    lines = spark.createDataFrame([(1, "p q r s\nsame old line here"), (None, "unique one\nsame old line here"), (None, "same old line here\nunique two words")], "doc_id long, text string")
    kept = {r.text for r in line_dedup.dedup_lines(lines).where("doc_id IS NULL").collect()}
    assert kept == {"unique one", "unique two words"}


def test_suffix_postings_of_pieces_are_those_of_the_whole():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"abc") for _ in range(5000)) + b"x" * 900
    whole, parts = suffix_dedup.postings(raw), suffix_dedup.postings(raw, 333)
    at, h = suffix_dedup.anchors(raw)
    assert np.array_equal(whole[0], at) and np.array_equal(whole[1], h)
    lo, hi, ctx = suffix_dedup.contexts(raw, at)
    assert np.array_equal(whole[2], lo) and np.array_equal(whole[3], hi)
    order = np.argsort(parts[0], kind="stable")
    assert all(np.array_equal(a, b[order]) for a, b in zip(whole, parts))
    assert all(len(x) == 0 for x in suffix_dedup.postings(b"short"))


@pytest.mark.parametrize("hot", [8, 1 << 14])
def test_suffix_dedup_of_one_passage_in_many_contexts(spark, monkeypatch, hot):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(12))
    docs = [(2**60 + i, " ".join(word() for _ in range(30)) + passage[: rng.randrange(40, 72)] + " ".join(word() for _ in range(9))) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = suffix_dedup.brute_force([(d, t.encode()) for d, t in docs])
    rows = suffix_dedup.dedup_spans(spark.createDataFrame([*docs, (None, "no id")], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows if r.doc_id}
    assert got == want and len(rows) == 301


def test_large_ids_beside_a_null_id(spark):
    big = [2**60 + 1, 2**60 + 3, None]
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in big], "doc_id long, text string")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    want = sorted(big, key=str)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for df in (
        lm_score.score(docs), line_dedup.dedup_lines(docs), suffix_dedup.dedup_spans(docs), sentencepiece_sampling.encode(docs), license_scan.scan(docs),
        minhash_dedup.near_duplicates(docs), toxicity.score(docs, model), toxicity.reject(docs, model),
    ):
        assert ids(df) == want
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {big[0]: (big[0], True), big[1]: (big[0], False), None: (None, True)}


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", None), (None, "")], "doc_id string, text string")
    assert {r.doc_id for r in lm_score.score(docs).collect()} == {"a", "b", None}
    assert {r.doc_id for r in sentencepiece_sampling.encode(docs).collect()} == {"a", "b", None}
    assert {r.doc_id for r in license_scan.scan(docs).collect()} == {"a", "b", None}


def test_urls_of_the_table_against_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_url_filter"](spark, sf).collect()
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])))
    want = duckdb.sql(f"""SELECT page_id, host, path, CASE {cases} END AS rule FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM '{sf}/pages.parquet')""").fetchall()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got) == sorted(want)
    tokens = lambda r: {f"h:{x}" for x in r.host.split(".") if x} | {"p:" + re.sub("[0-9]+", "0", x) for x in r.path.split("/") if x}
    verdict = {h + p: v for h, p, v in url_filter.RULES}
    ruled = [(tokens(r), verdict[r.rule]) for r in got if r.rule]
    assert all(r.verdict == verdict[r.rule] for r in got if r.rule) and any(r.mined for r in got)
    for r in got:
        if r.rule is None and r.mined:
            items = set(r.mined.split(" "))
            held = [v for t, v in ruled if items <= t]
            assert items <= tokens(r) and len(items) <= url_filter.MAX_ITEMS
            assert held.count(r.verdict) >= url_filter.MIN_CONFIDENCE * len(held) and len(held) >= url_filter.MIN_SUPPORT * len(ruled)
        elif r.rule is None:  # no single token of it is sure enough
            for t in tokens(r):
                held = [v for ts, v in ruled if t in ts]
                for v in ("allow", "block"):
                    assert r.verdict == "allow" and not (held.count(v) >= url_filter.MIN_CONFIDENCE * len(held) and held.count(v) >= url_filter.MIN_SUPPORT * len(ruled) and held)


def test_urls_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "http://a.com/en/1", "x", "y"), (1, "http://a.com/en/1", "x", "y"), (2, None, None, None), (None, "", None, None)], "page_id long, url string, host string, verdict string")
    assert sorted((str(r.page_id), r.host, r.verdict) for r in url_filter.judge(rows).collect()) == [("1", "a.com", "block"), ("1", "a.com", "block"), ("2", "", "allow"), ("None", "", "allow")]
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_top_k_of_the_largest_doubles_and_an_empty_table(spark):
    rows = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e308, 0.0]), (2, [-1e308, 2.0]), (3, [0.0, 4.0])], "id long, v array<double>")
    got = topk.top_k(rows, "id", "v", lambda i: i % 20 == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (3, 64 * 256), (2, -(2**63))]
    assert topk.top_k(rows.limit(0), "id", "v", lambda i: i % 20 == 0).count() == 0


def test_sentencepiece_units_part_where_no_piece_reaches():
    with open(sentencepiece_sampling.default_model(), "rb") as f:
        p = sentencepiece_sampling.Pieces(f.read())
    texts = ["  Hello, wörld.\nNext ▁x12 3,4  ", "", "▁▁ \ud800é", "世界 a"]
    units, codes, count = sentencepiece_sampling.split_units(p, texts)
    got = [units[c].decode("utf-8", "surrogatepass") for c in codes]
    assert got == ["  Hello", ",", " wörld", ".\n", "Next", " ", "▁", "x", "12", " 3,4", "  ", "▁", "▁", " \ud800", "é", "世界", " a"] and count.tolist() == [11, 0, 4, 2]
    linked = {chr(c) for c in np.flatnonzero(p.kind == sentencepiece_sampling.LINKED)}
    for s, w in zip(p.surface, p.logw):  # no piece spans a cut
        body = s.decode("utf-8", "replace").lstrip(" ")
        assert not np.isfinite(w) or len({c in linked for c in body}) <= 1
    sampler = sentencepiece_sampling.Sampler(p)
    ids = sentencepiece_sampling.segment(sampler, texts, np.arange(4, dtype=np.uint64))
    assert [sentencepiece_sampling.decode_ids(p, i).decode("utf-8", "surrogatepass") for i in ids] == texts
    alone = [sentencepiece_sampling.segment(sampler, [t], np.array([k], np.uint64))[0].tolist() for k, t in enumerate(texts)]
    assert alone == [i.tolist() for i in ids]


def test_sentencepiece_worker_keeps_no_tables_between_tasks(spark):
    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"edges": [len(s.cum) for s in sentencepiece_sampling._WORKER.values()]}, schema=pa.schema([("edges", pa.int64())]))

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(3000)), "en", "s", 0) for i in range(4)], DOCS).coalesce(1)
    assert sentencepiece_sampling.encode(docs, check=True).where("lossless").count() == 4
    assert all(r.edges <= 1024 for r in docs.select("doc_id").mapInArrow(held, "edges long").collect())


def test_toxic_rows_are_judged_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 2)
    model = toxicity.Model()
    model.w, model.b = 3 * np.ones(model.n_votes, np.float32), np.float32(-3)
    docs = spark.createDataFrame([(i, ["fine", "idiot idiota scum", None][i % 3], "en", "s", 0) for i in range(7)], DOCS).coalesce(1)
    assert sorted(r.doc_id for r in toxicity.reject(docs, model).collect()) == [0, 2, 3, 5, 6]


def test_lm_holds_no_windows_while_texts_are_scored(spark):
    import glob
    import tempfile

    held = lambda: {p for k in ("counts", "pairs", "parameters", "top") for p in glob.glob(f"{tempfile.gettempdir()}/checkpoints/loomgraph/lm-{k}-*")}
    before = held()
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(6)], "doc_id long, text string")
    assert lm_score.score(docs).count() == 6 and held() <= before
