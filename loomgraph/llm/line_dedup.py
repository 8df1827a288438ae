"""Line dedup: an exact set-similarity self-join of lines, in DataFrame functions alone.

A line is the set of its lower-cased words. It is removed if an earlier line (by doc_id, then line
number) has a Jaccard similarity of ``THRESHOLD`` or more; lines without words stay. Steps:

1. copies of one line text collapse to the first, by a combining aggregate; only these go on;
2. words are ordered by rarity, counted over all documents in a table of fixed size that maps
   each 64-bit word hash one to one to a sort key;
3. first lines are posted under their prefix, the words rare enough that two similar lines share
   one; a semi-join under the length, positional and bitmap filters finds lines with any possible
   partner, at most one row for each posting;
4. the postings that met get finer bitmaps, and semi-joins that carry the whole sets verify Jaccard
   against lines before. A line is decided by the first similar one that it meets, so that a large
   group of similar lines makes one row for each posting and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, release, row_key, table

#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
BUCKET_BITS, MAPS = 14, 4
#: A character of a word; white space but the plain space.
WORD, ODD_SPACE = "[^\\x20\\x09-\\x0D]", "[\\x09-\\x0D]"
#: Words that two similar lines of a.n and b.n words share at least.
NEED = f"(({NUM} * (a.n + b.n) + {NUM + DEN - 1}) div {NUM + DEN})"
EARLIER = "(b.pos < a.pos OR (b.pos = a.pos AND b.line_no < a.line_no))"
SIMILAR = f"size(array_intersect(a.keys, b.keys)) >= {NEED}"
LATER = "(a.pos < b.pos OR (a.pos = b.pos AND a.line_no < b.line_no))"
LINE = ["pos", "line_no"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _split(text: Column) -> Column:
    """Lower-cased words, and empty strings; parting at one plain character is Spark's fast case."""
    low = F.lower(text)
    return F.split(F.when(low.rlike(ODD_SPACE), F.regexp_replace(low, ODD_SPACE, " ")).otherwise(low), " ")


def rarity(docs: DataFrame) -> Column:
    """By bucket of a word hash (its upper bits) what turns these bits into the bucket's place, rarest first."""
    size = 1 << BUCKET_BITS
    counts = (
        docs.select(F.explode(_split(F.coalesce("text", F.lit("")))).alias("w")).where("w <> ''")
        .groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).cast("int").alias("b"))
        .count()
        .collect()  # one row a bucket at most
    )
    n = {r["b"]: r["count"] for r in counts}
    turn = [0] * size
    for i, b in enumerate(sorted(range(size), key=lambda b: (n.get(b, 0), b))):
        x = ((i - size // 2) % size ^ b) << (64 - BUCKET_BITS)
        turn[b] = x - (1 << 64) if x >> 63 else x
    return F.split(F.lit(",".join(map(str, turn))), ",").cast("array<bigint>")


def _keys(line: Column, turns: Column) -> Column:
    """Distinct words of a line as 64-bit keys, rarest first; key and word hash map one to one."""
    hashes = F.array_distinct(F.transform(F.array_remove(_split(line), ""), lambda w: F.xxhash64(w)))
    # Never null, which lets the sort run on plain numbers.
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(F.coalesce(F.get(turns, F.shiftrightunsigned(h, 64 - BUCKET_BITS)), F.lit(0)))))


def _parity(keys: Column, part: int | None = None) -> Column:
    """64 bits, each the parity of the keys that fall to it; two sets' maps differ in no more bits than the sets.

    With ``part``, one of MAPS such maps for a share of the keys each, which tell more apart.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(F.lit(63)).cast("int"))
    if part is not None:
        keys = F.filter(keys, lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(MAPS - 1)) == part)
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(bit(k)))


def _possible(*maps: str) -> str:
    """Length, positional and bitmap filters on postings a and b of one word, as SQL."""
    apart = " + ".join(f"bit_count(a.{m} ^ b.{m})" for m in maps)
    return f"a.tok = b.tok AND {DEN} * a.n >= {NUM} * b.n AND {DEN} * b.n >= {NUM} * a.n AND a.n - a.i >= {NEED} AND b.n - b.i >= {NEED} AND {apart} <= a.n + b.n - 2 * {NEED}"


def _with(a: DataFrame, b: DataFrame, condition: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), F.expr(condition), "left_semi")


def kept_lines(docs: DataFrame) -> DataFrame:
    """(pos, line_no) of every line with words that stays; ``pos`` is the doc_id, or a key by the text where it is null."""
    docs = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("pos"), "text")
    every = docs.select("pos", F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    hashed = every.select("pos", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    first = materialize(hashed.groupBy("h1", "h2").agg(F.min(F.struct(*LINE)).alias("f")).select("f.pos", "f.line_no"), "lines")
    turns = rarity(docs)

    def sets(chosen: DataFrame) -> DataFrame:
        """Keys of the chosen lines; texts meet their line numbers a document at a time."""
        met = docs.join(chosen.groupBy("pos").agg(F.collect_set("line_no").alias("nos")), "pos").dropDuplicates(["pos"]).select("pos", "nos", _lines(F.col("text")).alias("ls"))
        # Only the chosen lines go along with the explosion, not each time the whole text.
        each = met.select("pos", F.inline(F.transform("nos", lambda i: F.struct(i.alias("line_no"), F.get("ls", i).alias("line")))))
        return each.select(*LINE, _keys(F.col("line"), turns).alias("keys"))

    prefix = F.expr(f"slice(keys, 1, size(keys) - ({NUM} * size(keys) + {DEN - 1}) div {DEN} + 1)")
    # Outer, as for the inner kind the optimizer would compute every prefix a second time in a filter.
    post = F.posexplode_outer("prefix").alias("i", "tok")
    postings = sets(first).select(*LINE, F.size("keys").alias("n"), _parity(F.col("keys")).alias("sig"), prefix.alias("prefix")).select(*LINE, "n", "sig", post)
    postings = materialize(postings, "line-postings")  # else filters inferred for the join would compute the keys again
    met = materialize(_with(postings, postings, f"{_possible('sig')} AND (a.pos <> b.pos OR a.line_no <> b.line_no)"), "line-suspects")
    release(postings)
    whole = sets(met.select(*LINE).distinct()).withColumns({f"s{k}": _parity(F.col("keys"), k) for k in range(MAPS)})
    whole = materialize(whole, "line-sets")
    fine = materialize(met.drop("sig").join(whole.drop("keys"), LINE), "line-fine")
    release(met)
    near = _possible(*(f"s{k}" for k in range(MAPS)))
    behind = materialize(_with(fine, fine, f"{near} AND {EARLIER}"), "line-behind")  # with a possible partner before them

    def verified(chosen: DataFrame) -> DataFrame:
        """Lines of the chosen postings with a similar line before them under the same word."""
        asked = _with(fine, chosen, f"{near} AND {LATER}")
        sets_of = whole.select(*LINE, "keys")
        return _with(chosen.join(sets_of, LINE), asked.join(sets_of, LINE), f"{near} AND {EARLIER} AND {SIMILAR}").select(*LINE).distinct()

    # Whole sets go along with one posting of a line first, that of its word with most lines behind others;
    # few lines are not verified there, and these come again with all their postings.
    often = behind.groupBy("tok").agg(F.count("*").alias("often"))
    one = behind.join(often, "tok").groupBy(*LINE).agg(F.max_by(F.struct(*[c for c in behind.columns if c not in LINE]), F.struct("often", "tok")).alias("p")).select(*LINE, "p.*")
    sure = materialize(verified(materialize(one, "line-one")), "line-verified")
    rest = materialize(behind.join(sure, LINE, "left_anti"), "line-rest")
    sure = materialize(sure.unionByName(verified(rest)), "line-verified")
    release(fine, behind, rest, whole)
    out = materialize(first.join(sure, LINE, "left_anti"), "line-kept")
    release(first, sure)
    return out


def _dedup(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed): every row as a struct, its text without removed lines, counts."""
    kept = kept_lines(docs).groupBy("pos").agg(F.collect_set("line_no").alias("kept"))
    lines = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("pos")).join(kept, "pos", "left")
    lines = lines.select("row", "kept", _lines(F.col("row.text")).alias("ls"))
    blank = F.array_compact(F.transform("ls", lambda x, i: F.when(~x.rlike(WORD), i)))
    at = F.sort_array(F.array_union(blank, F.coalesce("kept", F.array().cast("array<int>"))))
    return lines.select("row", "ls", at.alias("at")).select(
        "row",
        F.when(F.col("row.text").isNotNull(), F.array_join(F.transform("at", lambda i: F.get("ls", i)), "\n")).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("ls")).cast("bigint").alias("n_lines"),
        (F.size("ls") - F.size("at")).cast("bigint").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` rid of removed lines, ``n_lines`` and ``n_removed`` added.

    Null texts stay null and have no lines; an empty text is one empty line. A text left without
    lines becomes empty. Rows that repeat a doc_id must repeat its text: the copies then all get
    the result of one. Rows without an id come after all ids under 2 ** 62, in an order by their
    texts' hashes; those of one text are repeats of one document. Other columns are kept, but
    columns of the input named n_lines or n_removed give way to the counts.
    """
    names = [f"row.{c}" for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return _dedup(docs).select(*names, "text", "n_lines", "n_removed")


def remove_lines(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """The documents, with their columns as they are, but ``text`` rid of removed lines; as ``dedup_lines`` otherwise.

    Without ``emptied``, documents that had words and lost them all are left out; those that had
    none before, or no text, stay.
    """
    out = _dedup(docs)
    if not emptied:
        out = out.where(~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)) | F.col("text").rlike(WORD))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns])


def op2(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, no, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM l),
c AS (SELECT s, min((doc_id, no)) AS f, len(s) AS n FROM w WHERE len(s) > 0 GROUP BY s),
t AS (SELECT f, n, unnest(s) AS tok FROM c),
df AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
p AS (SELECT * FROM (SELECT f, n, t.tok, row_number() OVER (PARTITION BY f ORDER BY df, t.tok) AS i FROM t JOIN df USING (tok)) WHERE i <= n - (4 * n + 4) // 5 + 1),
k AS (SELECT DISTINCT a.f AS later, b.f AS earlier FROM p a JOIN p b USING (tok) WHERE b.f < a.f AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT DISTINCT later FROM k JOIN c x ON x.f = later JOIN c y ON y.f = earlier WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
r AS (SELECT w.doc_id, w.no, w.line, len(w.s) > 0 AND ((w.doc_id, w.no) <> c.f OR v.later IS NOT NULL) AS gone FROM w LEFT JOIN c USING (s) LEFT JOIN v ON v.later = c.f),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_md5 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_md5 FROM documents d LEFT JOIN g USING (doc_id)
"""
