"""Table schemas, and the row checks that a database would enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

LINE = "struct<text:string,confidence:double,polygon:array<array<double>>>"
SESSION = "id string, source_name string, started_at timestamp_ntz, ended_at timestamp_ntz, status string, error string"
EVENT = (
    "id long, session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, frame_path string, thumbnail_path string, phash string, change_score double, "
    "width int, height int, event_kind string, ocr_text string, ocr_confidence double, embedding array<float>, previous_event_id long, created_at timestamp_ntz, processed_at timestamp_ntz"
)
EVIDENCE = f"id long, event_id long, kind string, path string, text string, mime_type string, sha256 string, metadata struct<lines:array<{LINE}>>, created_at timestamp_ntz"
PACK = (
    "id string, title string, query string, note string, deduplicate_overlaps boolean, status string, approved_at timestamp_ntz, expires_at timestamp_ntz, "
    "revoked_at timestamp_ntz, manifest_sha256 string, artifact_path string, build_error string, created_at timestamp_ntz"
)
ITEM = "pack_id string, event_id long, position int, image_path string, ocr_text string, redactions array<struct<x:double,y:double,width:double,height:double>>, sha256 string"
OBSERVATION = "key long, at double, score double, watch double, frame long"

# What a column may hold.
ALLOWED = {"evidence": ("kind", ["frame", "ocr", "note", "file", "clipboard"]), "pack": ("status", ["draft", "approved", "revoked", "expired"])}


def violations(rows: DataFrame, required: list[str] = (), allowed: tuple[str, list[str]] | None = None, unique: list[str] = ()) -> DataFrame:
    """(rule, n) of broken rules: nulls in required columns, values that aren't allowed, keys that repeat."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"not null {c}") for c in required]
    if allowed:
        column, values = allowed
        checks.append(F.count_if(~F.col(column).isin(values)).alias(f"allowed {column}"))
    parts = []
    if checks:
        one = rows.agg(*checks)
        parts.append(one.unpivot([], one.columns, "rule", "n"))
    if unique:
        repeats = rows.groupBy(*unique).count().filter(F.col("count") > 1).agg(F.count(F.lit(1)).alias("n"))
        parts.append(repeats.select(F.lit("unique " + ", ".join(unique)).alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("n") > 0)


def with_missing(rows: DataFrame, schema: str) -> DataFrame:
    """rows with every column of the schema, missing ones null: an additive migration."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
