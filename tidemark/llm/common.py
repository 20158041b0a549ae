"""Shared-folder tables and session settings for the training-text operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tables that the settle() around a call has to delete; each thread has its own.
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset and all runs on this machine, as in tests, a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(context, "_tidemark_shared", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._tidemark_shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when its driver ends: results that stand as tables lie there."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/tidemark/{context.applicationId}"
    if getattr(context, "_tidemark_own", None) != path:
        context._tidemark_own = path
        jvm, conf = spark._jvm, context._jsc.hadoopConfiguration()

        def clean():
            with contextlib.suppress(Exception):  # the JVM may have ended before
                _delete(jvm, conf, path)

        atexit.register(clean)
    return path


def _delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back, which cuts the lineage there."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    around = _scratch.get()
    if around is not None:
        around.append(back)
    return back


def settle(label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of build() as a table; the tables that it wrote on the way are deleted and the rows of a batch are as before.

    A result stays until the application ends, or until the settle() around it deletes it.
    """
    spark, tables = SparkSession.active(), []
    rows = spark.conf.get(ARROW_ROWS)
    token = _scratch.set(tables)
    try:
        out = build()
        if getattr(out, "_tidemark_path", None) is None:
            out = materialise(out, label)
    finally:
        _scratch.reset(token)
        spark.conf.set(ARROW_ROWS, rows)
    for t in tables:
        if t is not out:
            discard(t)
    around = _scratch.get()
    if around is not None:
        around.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows that go to a Python worker at once: texts are long, workers have little memory. Ships this package too.

    Batches are cut when a plan runs, so the setting stays for a plan that is returned unrun; settle() puts it back.
    """
    spark.conf.set(ARROW_ROWS, str(rows))
    ship(spark)


def document_keys(docs: DataFrame, key: Column, out: str) -> DataFrame:
    """docs with a column ``out`` that numbers documents, a document being a key with a text; it grows with key.

    That is key itself, unless rows with one key hold different texts: then a rank by key and the text's 64-bit hash.
    """
    sign = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.withColumn(out, key)
    signs = d.select(out, sign.alias("__sign"))
    several = signs.groupBy(out).agg(F.min("__sign").alias("a"), F.max("__sign").alias("b")).filter(F.col("a") != F.col("b"))
    if several.isEmpty():
        return d
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = signs.distinct().repartitionByRange(parts, out, "__sign").sortWithinPartitions(out, "__sign")
    # Ranges follow each other by partition, so this number grows in their order; written once, it stays.
    ranks = materialise(order.select(F.col(out).alias("__of"), F.col("__sign").alias("__s"), F.monotonically_increasing_id().alias("__rank")), "document-keys")
    joined = d.join(ranks, (F.col(out) == F.col("__of")) & (sign == F.col("__s")))
    return joined.withColumn(out, F.col("__rank")).drop("__of", "__s", "__rank")


def guarded(docs: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """body of docs whose other columns have plain names meanwhile, so that no name of theirs matters; body returns the same columns."""
    known = {"doc_id", "text", "lang", "source"}
    names = docs.columns
    return body(docs.toDF(*[c if c in known else f"col{i}" for i, c in enumerate(names)])).toDF(*names)


def crc_mod(column, n: int):
    """crc32 of an id written as text, modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n
