"""Shared helpers: the cluster's shared folder, cut lineage, and row identity."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 256
#: ASCII white space, as the corpus contracts define it: \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one process alone gets a
    temporary one; a cluster is refused, as its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="confab-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if "://" in base else "file://" + os.path.abspath(base)


#: Where new paths begin, inside ``scratch``.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_SCRATCH.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, label: str):
    """Tables written inside, but for those with a path of their own, are removed at the end: what is
    computed from them must have been written by then."""
    path = new_path(spark, label)
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: work is done once, lineage is cut,
    and a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*names: str):
    """128-bit identity of a row's content, so that repeated rows share one key and nulls have one."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, deal: str, how: str = "left", most: int = 100_000) -> DataFrame:
    """Join ``rows`` with ``facts`` (one row a key) where a key may hold a large share of the rows:
    ``weight`` says how many. A fact of over ``most`` rows is repeated once for each part, and its
    rows are dealt to the parts by ``deal``. Such facts number at most rows / ``most``."""
    parts = F.ceil(F.col(weight) / most).cast("int")
    hot = facts.where(F.col(weight) > most).select(*on, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(deal), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    repeated = facts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(weight)
    return dealt.join(repeated, [*on, "__part"], how).drop("__part")


def slices(batches, rows: int = SLICE_ROWS):
    """Cut Arrow batches so that few long texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ddl_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(","))])


def table(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
