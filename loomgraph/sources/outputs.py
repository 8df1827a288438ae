"""Sinks: answers as JSON lines, the run history, heartbeat and status files."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a heartbeat is trusted.
TRUST = 15
KEEP = 2000


def answer_lines(rows: DataFrame, target: str) -> DataFrame:
    """(target, part, value): JSON of each answer's rows, null fields kept, in parts of bounded size.

    Rows are numbered within a target by a hash, 10,000 or so to a part, so that one target with a
    very large answer fills many tasks; a reader joins a target's parts.
    """
    rest = [c for c in rows.columns if c != target]
    sizes = rows.groupBy(F.col(target).alias("_target")).agg(F.ceil(F.count("*") / 10000).alias("_parts"))
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    sized = rows.select(target, body.alias("body")).join(sizes, F.col(target).eqNullSafe(F.col("_target")))
    parted = sized.select(target, "body", F.pmod(F.xxhash64("body"), F.col("_parts")).alias("part"))
    return parted.groupBy(target, "part").agg(F.sort_array(F.collect_list("body")).alias("b")).select(target, "part", F.concat(F.lit("["), F.array_join("b", ","), F.lit("]")).alias("value"))


def append_history(spark: SparkSession, path: str, run: dict) -> None:
    """Adds one run, a JSON line, to the history below ``path``."""
    spark.createDataFrame([(time.time_ns(), json.dumps(run))], "ts bigint, run string").coalesce(1).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, keep: int = KEEP) -> DataFrame:
    """The last runs, latest first; lines that aren't JSON are left out."""
    return spark.read.schema("ts bigint, run string").json(path).where("ts IS NOT NULL").orderBy(F.desc("ts")).limit(keep)


def write_atomic(path: str, value: dict) -> None:
    """A small file that readers see either as it was or whole."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        json.dump(value, f)
    os.replace(temp, path)


def beat(path: str, state: str, now: float | None = None) -> None:
    write_atomic(path, {"state": state, "at": time.time() if now is None else now, "pid": os.getpid()})


def fresh(path: str, now: float | None = None, trust: float = TRUST) -> bool:
    """Whether the heartbeat says idle and is recent; a missing or broken file isn't."""
    try:
        with open(path) as f:
            beat = json.load(f)
        age = (time.time() if now is None else now) - beat["at"]
    except (OSError, ValueError, KeyError, TypeError):
        return False
    return beat.get("state") == "idle" and 0 <= age <= trust
