"""Tables of a folder, and the event, session, document and item views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Events with an interval, text and, where asked for, a vector; a document is an event of its source's session."""
    d = table(spark, sf_dir, "documents")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id")
    d = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("session_id"),
        at.alias("started_at"),
        (at + F.expr("INTERVAL '1' SECOND * (n_chars % 120)")).alias("ended_at"),
        F.col("text").alias("ocr_text"),
        F.when(F.col("doc_id") % 7 != 0, at).alias("processed_at"),
    )
    if not vectors:
        return d
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return d.join(v, "id", "left")


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context documents: an order is a document, its status one of draft, approved and revoked."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "approved").otherwise("revoked")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Clerk%"), (F.col("o_custkey") % 100).cast("string")).alias("query"),
        F.concat(F.lit("note_"), F.col("o_custkey").cast("string")).alias("note"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
        F.col("o_totalprice").alias("size_score"),
    )


def pack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of documents with a 0-based position, numbered by a full order of their columns."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("pack_id"),
        F.col("l_partkey").alias("event_id"),
        (F.row_number().over(order) - 1).alias("position"),
        F.col("l_shipdate").alias("added_at"),
        F.col("l_extendedprice").alias("weight"),
    )


#: The same views for the SQL side.
EV_SQL = """ev AS (SELECT doc_id AS id, source AS session_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS started_at,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_seconds(n_chars % 120) AS ended_at, text AS ocr_text,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS processed_at FROM documents)"""
PACK_SQL = """pack AS (SELECT o_orderkey AS id, o_orderpriority AS title, 'Clerk%' || (o_custkey % 100)::VARCHAR AS query,
  'note_' || o_custkey::VARCHAR AS note, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'approved' ELSE 'revoked' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL 24 HOURS AS expires_at, o_totalprice AS size_score FROM orders)"""
ITEM_SQL = """item AS (SELECT l_orderkey AS pack_id, l_partkey AS event_id, l_shipdate AS added_at, l_extendedprice AS weight,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS position FROM lineitem)"""
