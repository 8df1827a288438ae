"""Shared pieces: reading tables, shared scratch folder, held-out test."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases the bytes of A to Z and nothing else.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/loomgraph"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost no recomputation."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    # The lineage ends here: the shuffle files that led here go as soon as the table is written.
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no plan reads any more: what followed from them is itself written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Memory that a task has freed goes back to the system, as Python workers live on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_columns(df: DataFrame, keep: list[str], inputs: list[str], fn, added: str, rows: int = 1024) -> DataFrame:
    """Columns ``keep`` of ``df`` as they are, and the ``added`` ones that ``fn`` makes of the inputs' Arrow arrays.

    Kept columns go through Arrow alone: a long beside a null stays a long, which in pandas it would not.
    ``fn`` sees at most ``rows`` rows at a time and gives one sequence for each added column.
    """
    new = StructType.fromDDL(added)
    out = StructType([df.schema[c] for c in keep] + new.fields)
    types = [f.type for f in to_arrow_schema(new)]

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                made = fn(*(batch.column(batch.schema.get_field_index(c)) for c in inputs))
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, t) for x, t in zip(made, types))], names=out.names)
        whole = batch = made = arrays = None
        trim()

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, out)


def ascii_lower(col: Column) -> Column:
    """A to Z lower-cased, everything else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def words(col: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return; null gives none."""
    parts = F.split(F.coalesce(col, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or for a row without one a key by its text from 2 ** 62 up, after all smaller ids."""
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(doc_id.cast("bigint"), own)


def held_out(doc_id: Column, remainder: int, modulus: int = 5) -> Column:
    """crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
