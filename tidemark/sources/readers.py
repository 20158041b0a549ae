"""Sources: stored frames and observations as streams, images with truths, judged queries, manifests, settings, device lists."""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..schema import OBSERVATION


def replay(spark: SparkSession, path: str, schema: str = OBSERVATION, files_at_once: int = 1) -> DataFrame:
    """Stored observations as a stream, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(path, frame, data) of files of raw pictures, three bytes a pixel; a short last record is left out."""
    size = width * height * 3
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.floor(F.col("length") / size).cast("int").alias("n"))
    each = files.filter(F.col("n") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    return each.select("path", "frame", F.substring("content", F.col("frame") * size + 1, F.lit(size)).alias("data"))


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def truth_cases(spark: SparkSession, path: str) -> DataFrame:
    """(category, stem, content, truth): images joined with the text file of their name; the category is the first folder."""
    files = images(spark, path).filter(F.col("path").rlike(r"\.(png|jpe?g|webp|txt)$"))
    inner = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    files = files.select("content", inner.alias("category"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"), F.col("path").endswith(".txt").alias("is_text"))
    text = files.filter("is_text").select("category", "stem", F.decode("content", "UTF-8").alias("truth"))
    return files.filter("NOT is_text").select("category", "stem", "content").join(text, ["category", "stem"])


def judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_event_id, kind) of a JSON document with a list of queries."""
    schema = "queries array<struct<query:string,expected_event_id:long,kind:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("queries").alias("q")).select("q.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    item = "array<struct<position:int,event_id:long,sha256:string>>"
    return spark.read.schema(f"schema_version int, id string, title string, note string, query string, items {item}").option("multiLine", "true").json(path)


def used_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files under a folder. Contents aren't read."""
    return images(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("used_bytes"), F.count(F.lit(1)).alias("n_files"))


def device_names(listing: DataFrame) -> DataFrame:
    """(name, nth) of video devices in a device listing (line_no, line): no audio devices, no alternative names, each once."""
    w = W.orderBy("line_no")
    kind = F.when(F.lower("line").contains("video devices"), "video").when(F.lower("line").contains("audio devices"), "audio")
    x = listing.withColumn("section", F.last(kind, ignorenulls=True).over(w))
    own = F.when(F.col("line").rlike(r"\((?:video|none)\)\s*$"), "video").when(F.col("line").rlike(r"\(audio\)\s*$"), "audio")
    x = x.withColumn("kind", F.coalesce(own, "section")).withColumn("name", F.regexp_extract("line", r'"([^"]+)"', 1))
    x = x.filter((F.col("kind") == "video") & (F.col("name") != "") & ~F.lower("line").contains("alternative name"))
    first = x.groupBy("name").agg(F.min("line_no").alias("at"))
    return first.select("name", F.row_number().over(W.orderBy("at")).alias("nth"))


@dataclasses.dataclass
class Settings:
    analysis_fps: float = 2.0
    stable_seconds: float = 1.5
    heartbeat_seconds: float = 60.0
    motion_checkpoint_seconds: float = 5.0
    change_threshold: float = 0.007
    watch_change_threshold: float = 0.003
    retention_days: int = 30
    max_storage_gib: float = 20.0
    minimum_free_gib: float = 2.0
    pack_expiry_hours: int = 24
    max_pack_images: int = 200
    embedding_dimension: int = 384


def settings(path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "TIDEMARK_") -> Settings:
    """Defaults, then a JSON file, then environment variables. Unknown keys are dropped, a broken file counts as empty."""
    found: dict = {}
    if path and Path(path).exists():
        try:
            loaded = json.loads(Path(path).read_text())
            found = loaded if isinstance(loaded, dict) else {}
        except ValueError:
            found = {}
    environment = os.environ if environment is None else environment
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    for name in kinds:
        if (value := environment.get(prefix + name.upper())) is not None:
            found[name] = value
    return Settings(**{k: kinds[k](v) for k, v in found.items() if k in kinds})
