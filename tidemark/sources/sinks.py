"""Sinks: append-only facts by day, rewrites without victims, published documents, reports, streams.

Parquet has no update: results are appended and the newest row of a key is read (operators.enrich.current). A publication
is written aside and then renamed, so readers see the old or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_by_day(rows: DataFrame, path: str, at: str = "started_at") -> None:
    """Rows into folders by day; each day's rows go to few files."""
    rows.withColumn("day", F.date_format(at, "yyyy-MM-dd")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def numbered(rows: DataFrame, last_id: int, order: list[str]) -> DataFrame:
    """rows with ids above last_id, by position within sorted partitions; unique, not gapless."""
    return rows.sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id() + F.lit(last_id + 1))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts new in the place of path. The old one is moved aside first and deleted last, or put back, so it's never lost."""
    target, fs = _files(spark, path)
    source, old = _files(spark, new)[0], _files(spark, f"{path}.old-{uuid.uuid4().hex}")[0]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{new} can't be moved to {path}")
    if had:
        fs.delete(old, True)


def rewrite(rows: DataFrame, path: str) -> None:
    """Replaces a table by rows that may be read from it: written aside, then renamed."""
    aside = f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    _swap(rows.sparkSession, aside, path)


def remove_paths(spark: SparkSession, root: str, paths: list[str]) -> int:
    """Deletes files that lie under root, others stay; the bytes that were freed. A path may be gone already."""
    top, fs = _files(spark, root)
    base, freed = fs.makeQualified(top).toUri().normalize().getPath().rstrip("/") + "/", 0
    for value in paths:
        path = fs.makeQualified(_files(spark, value)[0])
        if path.toUri().normalize().getPath().startswith(base) and fs.exists(path) and fs.getFileStatus(path).isFile():
            size = fs.getFileStatus(path).getLen()
            if fs.delete(path, False):
                freed += size
    return freed


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Hadoop's file system, replaced as a whole."""
    new = f"{path}.{uuid.uuid4().hex}"
    aside, fs = _files(spark, new)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _swap(spark, new, path)


def publish(spark: SparkSession, root: str, pack_id: str, manifest: dict, markdown: str, html: str) -> str:
    """A document's artifact folder; on failure nothing of it is left and the old one stays."""
    aside, final = f"{root}/.{pack_id}-{uuid.uuid4().hex}", f"{root}/{pack_id}"
    staged, fs = _files(spark, aside)
    try:
        write_text(spark, f"{aside}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))
        write_text(spark, f"{aside}/context.md", markdown)
        write_text(spark, f"{aside}/context.html", html)
        _swap(spark, aside, final)
    except BaseException:
        fs.delete(staged, True)
        raise
    return final


def report(rows: DataFrame, path: str, title: str) -> None:
    """A small result as JSON lines and as a Markdown table."""
    found = [r.asDict() for r in rows.limit(10_000).collect()]
    names = rows.columns
    table = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    table += ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in found]
    write_text(rows.sparkSession, f"{path}.jsonl", "".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in found))
    write_text(rows.sparkSession, f"{path}.md", "\n".join(table) + "\n")


def stream_to(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """A stream appended as Parquet, exactly once by its checkpoint."""
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
