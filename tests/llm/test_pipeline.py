import corpus_pipeline
from loomgraph.llm import decontaminate, line_dedup, minhash_dedup, toxicity
from loomgraph.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert decontaminate.contaminated(docs, table(spark, SF, "benchmark")).count() == 0
    assert minhash_dedup.near_duplicates(docs).where("NOT kept").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == counts[-1] and all(r.lossless for r in last)


def test_toxic_stage_is_the_operator(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}


def test_line_stage_is_the_operator(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    words = lambda t: bool((t or "").split())
    a = {(r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    whole = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert a == {(d, t) for d, t in whole if words(t) or not words(before[d])} and len(a) < len(whole)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, an empty table and columns with the operators' own names."""
    long = " ".join(f"w{i % 900}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " x"), (None, "alone without an id"), (None, None), (2**60 + 1, "a large id\nof two lines"), (5, " \n ")]
    docs = spark.createDataFrame([(d, t, 7, 8, 0.5, d, True, "k") for d, t in rows], "doc_id long, text string, n_lines int, n_removed int, score double, component_id long, kept boolean, n_pieces string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        ids = [r.doc_id for r in got]
        want = {1, 2, 3, 4, None, 2**60 + 1, 5}
        assert set(ids) == (want - {4} if name in ("minhash_dedup", "line_dedup") else want), name
        assert ids.count(3) == 2 and ids.count(None) == 2, name
        assert all((r.n_lines, r.n_removed, r.score, r.kept, r.component_id) == (7, 8, 0.5, True, r.doc_id) for r in got), name
    assert {r.n_pieces for r in got if r.doc_id in (1, 2)} == {0}


def test_near_duplicate_and_benchmark_stages_drop_what_the_operators_find(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    every = {r.doc_id for r in docs.collect()}
    copies = {r.doc_id for r in minhash_dedup.near_duplicates(docs, (8, 10)).where("NOT kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == every - copies and copies
    found = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == every - found and found


def test_near_duplicate_stage_takes_pairs_from_0_8(spark):
    same = [f"w{i}" for i in range(404)]  # 400 shingles; a word changed in the middle loses 5 of them
    edit = lambda n: " ".join("x" if i in range(20, 20 + 20 * n, 20) else w for i, w in enumerate(same))
    docs = spark.createDataFrame([(1, " ".join(same)), (2, edit(8)), (3, " ".join(f"v{i}" for i in range(404)))], "doc_id long, text string")
    a, b = (set(minhash_dedup.shingles(x).tolist()) for x in (" ".join(same), edit(8)))
    assert 0.81 < len(a & b) / len(a | b) < 0.83
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {1, 3}
    assert all(r.kept for r in minhash_dedup.near_duplicates(docs).collect())


def test_bounds_of_op9_are_as_before():
    limits = minhash_dedup.Limits((85, 100))
    assert (limits.matches, limits.bits_off) == (86, 26)
