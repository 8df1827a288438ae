"""URL filters: an explicit rule list first, then association rules mined by FP-growth.

Main path: DataFrame functions and Spark's own FP-growth; no Python on executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MAX_ITEMS = 0.01, 0.8, 3


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty without ``://`` or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest fitting rule, null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's path; of two of
    one length the smaller text wins. The list is a parameter and so part of the plan.
    """
    listed = F.array(*[
        F.struct((-F.lit(len(h + p))).alias("n"), F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v"))
        for h, p, v in rules
    ])
    fits = F.filter(
        listed,
        lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"])))
        & F.startswith(F.col("path"), r["p"]),
    )
    best = F.array_min(fits)
    return df.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.v")}).drop("_best")


def tokens() -> Column:
    """Distinct URL tokens: labels of the host and segments of the path, digits made ``0``."""
    labels = F.transform(F.split("host", "\\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, max_items=MAX_ITEMS) -> DataFrame:
    """Association rules (items, verdict, confidence, support) from rows (tokens, label).

    Every row counts; a null label makes a row count against any rule that fits it. Kept: rules
    of at most ``max_items`` tokens that reach the support
    and the confidence and have no shorter rule of the same verdict that is at least as sure.
    No labelled rows: no rules.
    """
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], "items array<string>, verdict string, confidence double, support double")
    baskets = labelled.select(F.concat("tokens", F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("="), F.col("label"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(
        F.startswith(F.col("consequent")[0], F.lit("=")) & (F.size("antecedent") <= max_items) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("=")))
    ).select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), "confidence", "support")
    # A shorter rule shares its first item with any longer one that holds it: an equi-join finds all such pairs.
    short = rules.select(F.col("items").alias("s"), F.col("verdict").alias("sv"), F.col("confidence").alias("sc"), F.col("items")[0].alias("k"))
    worse = (
        rules.withColumn("k", F.explode("items"))
        .join(short, "k")
        .where((F.col("sv") == F.col("verdict")) & (F.col("sc") >= F.col("confidence")) & (F.size("s") < F.size("items")) & (F.size(F.array_except("s", "items")) == 0))
        .select("items", "verdict")
        .distinct()
    )
    return rules.join(worse, ["items", "verdict"], "left_anti")


def match(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Best mined rule (``mined``, ``mined_verdict``) by key, through an inverted index.

    A rule is posted under its one least frequent token, so that common tokens have no postings
    of their own; the surest fitting rule wins, then support, then the tokens' order.
    """
    seen = pages.select(key, "tokens").withColumn("t", F.explode("tokens"))
    # Frequency among rules orders tokens: a token of few rules comes first.
    items = rules.withColumn("t", F.explode("items"))
    rarity = items.groupBy("t").agg(F.count("*").alias("n"))
    post = items.join(rarity, "t").groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "t")).getField("t").alias("t"))
    hits = seen.join(post, "t").where(F.size(F.array_except("items", "tokens")) == 0)
    best = hits.groupBy(key).agg(F.min(F.struct(-F.col("confidence"), -F.col("support"), F.array_join("items", " ").alias("mined"), F.col("verdict").alias("v"))).alias("b"))
    return best.select(key, F.col("b.mined").alias("mined"), F.col("b.v").alias("mined_verdict"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", **mining) -> DataFrame:
    """Verdict for every row of (page_id, url).

    Labels for mining are the verdicts of the explicit list on the urls that it covers; support and
    confidence are counted over these urls alone, so that a rule reaches beyond the listed hosts by
    the tokens that it shares with them. A url that no rule fits gets ``default``. Null urls have
    empty host and path. Repeated rows are judged alike and all returned, each counts in mining; an
    empty table gives no rows; other columns are ignored.
    """
    parsed = explicit(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules).withColumn("tokens", tokens())
    mined = mine(parsed.where("rule_verdict IS NOT NULL").select("tokens", F.col("rule_verdict").alias("label")), **mining)
    # Urls with the same tokens share one answer: match each distinct token set once.
    rest = parsed.where("rule_verdict is null").withColumn("k", F.array_join(F.array_sort("tokens"), " "))
    sets = rest.groupBy("k").agg(F.first("tokens").alias("tokens"))
    found = rest.join(match(sets, mined, "k"), "k", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("mined_verdict", F.lit(default)).alias("verdict"), "mined")
    ruled = parsed.where("rule_verdict is not null").select("page_id", "url", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    return ruled.unionByName(found)


def op5(spark, sf_dir):
    from loomgraph.llm.common import table

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined")
