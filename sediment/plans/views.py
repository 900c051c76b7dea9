"""How the driver's tables stand in for a repository's relations, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ADD, RECOVER, REMOVE

NOW = "2001-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tag_lookup(key: str):
    """Tags of the items view as columns, so that predicates on them reach the scan."""
    return {"name": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "custkey": F.col("o_custkey").cast("string")}.get(key, F.lit(None).cast("string"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "*", F.lpad(F.lower(F.hex("o_orderkey")), 32, "0").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("long").alias("size"),
        F.expr(f"(unix_micros(timestamp'{NOW}Z') - unix_micros(cast(o_orderdate AS timestamp))) * 1000").alias("age"),
    )


ITEMS_SQL = f"""items_v AS (SELECT *, lpad(lower(to_hex(o_orderkey)), 32, '0') AS item_id, o_orderdate AS ts, CAST(trunc(o_totalprice) AS BIGINT) AS size,
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) * 1000 AS age FROM orders)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with optional tags."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    return joined.select("*", F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")), lambda _, v: v.isNotNull()).alias("tags"))


DOCS_SQL = "docs_v AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "error", REMOVE).when((F.col("event_type") == "purchase") & (k < 2), RECOVER).when(F.col("event_type").isin("signup", "view", "click"), ADD)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("log_offset"), kind.alias("op"), F.col("event_id").cast("string").alias("item_id"))
    removed = F.when(F.col("op") == REMOVE, F.array((F.col("log_offset") - 1).cast("string"), (F.col("log_offset") - 3).cast("string")))
    return events.where("op IS NOT NULL").withColumn("removed_ids", removed).withColumn("item_id", F.when(F.col("op") == ADD, F.col("item_id")))


OPLOG_SQL = """oplog_v AS (SELECT * FROM (SELECT event_id AS log_offset, CASE WHEN event_type = 'error' THEN 'RemoveItems'
    WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) < 2 THEN 'RecoverRemoved'
    WHEN event_type IN ('signup', 'view', 'click') THEN 'AddItem' END AS op FROM events) WHERE op IS NOT NULL),
states AS (SELECT CAST(a.log_offset AS VARCHAR) AS item_id, a.log_offset AS added_at, max(r.log_offset) AS removed_at,
    (SELECT max(log_offset) FROM oplog_v WHERE op = 'RecoverRemoved') AS recovered_at
  FROM oplog_v a LEFT JOIN (SELECT log_offset, unnest([log_offset - 1, log_offset - 3]) AS item FROM oplog_v WHERE op = 'RemoveItems') r
    ON r.item = a.log_offset AND r.log_offset > a.log_offset WHERE a.op = 'AddItem' GROUP BY a.log_offset),
live AS (SELECT * FROM states WHERE removed_at IS NULL OR coalesce(recovered_at > removed_at, false))"""


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Two snapshots of the documents as file indexes."""
    text = F.col("text") if side == "a" else F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    keep = F.col("doc_id") % (7 if side == "a" else 5) != 0
    return table(spark, sf_dir, "documents").where(keep).select(
        F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), F.sha2(text, 256).alias("data_hash"),
        F.lit(33188).cast("long").alias("mode"), (F.lit(0) if side == "a" else F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).cast("long").alias("mtime"), F.lit(0).cast("long").alias("mtime_nsec"),
    )


def snapshot_sql(side: str) -> str:
    text = "text" if side == "a" else "CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END"
    mtime = "0" if side == "a" else "CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END"
    return f"snap_{side} AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, n_chars AS size, sha256({text}) AS data_hash, CAST(33188 AS BIGINT) AS mode, CAST({mtime} AS BIGINT) AS mtime FROM documents WHERE doc_id % {7 if side == 'a' else 5} <> 0)"


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*(F.lit(x) for x in (4096, 8192, 16384, 24576, 32768, 40960, 49152)))
    return table(spark, sf_dir, "part").select("p_partkey", (F.element_at(types, (F.col("p_partkey") % 7 + 1).cast("int")) + (F.col("p_partkey") * 37) % 4096).alias("mode"))


MODES_SQL = "modes_v AS (SELECT p_partkey, [4096, 8192, 16384, 24576, 32768, 40960, 49152][p_partkey % 7 + 1] + (p_partkey * 37) % 4096 AS mode FROM part)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("dev"), F.get_json_object("props", "$.k").cast("long").alias("ino"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.lit(33188).cast("long").alias("mode"))
    return events.withColumn("nlink", F.count("*").over(Window.partitionBy("dev", "ino")))


LINKS_SQL = "links_v AS (SELECT user_id AS dev, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ino, event_id AS seq, event_type || '/' || event_id AS path, count(*) OVER (PARTITION BY user_id, json_extract_string(props, '$.k')) AS nlink FROM events)"

CHUNK = 1024


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as one stream of characters, in chunks of 1024."""
    from pyspark.sql import Window

    own = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"), F.coalesce(F.sum("n_chars").over(own), F.lit(0)).alias("a"))
    cursor = F.struct(F.expr(f"(a + size) div {CHUNK} - a div {CHUNK}").alias("chunk_delta"), F.expr(f"a % {CHUNK}").alias("start_byte_offset"), F.expr(f"(a + size) % {CHUNK}").alias("end_byte_offset"))
    return placed.select("source", "seq", "size", cursor.alias("data_cursor"))


CURSORS_SQL = f"""placed AS (SELECT source, doc_id AS seq, n_chars AS size, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM documents),
cursors_v AS (SELECT source, seq, size, CAST(a // {CHUNK} AS BIGINT) AS s, CAST((a + size) // {CHUNK} AS BIGINT) AS last, CAST(a % {CHUNK} AS BIGINT) AS so, CAST((a + size) % {CHUNK} AS BIGINT) AS eo FROM placed)"""

PIECE = 256


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pieces of 256 characters, by content address."""
    split = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE))).alias("k")
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", split).select("doc_id", F.col("k").alias("pos"), F.expr(f"substring(text, cast(k * {PIECE} + 1 AS int), {PIECE})").alias("data")).select("doc_id", "pos", F.sha2("data", 256).alias("address"), F.octet_length("data").cast("long").alias("n_bytes"))


PIECES_SQL = f"pieces_v AS (SELECT doc_id, k AS pos, sha256(substr(text, CAST(k * {PIECE} + 1 AS BIGINT), {PIECE})) AS address, CAST(strlen(substr(text, CAST(k * {PIECE} + 1 AS BIGINT), {PIECE})) AS BIGINT) AS n_bytes FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {PIECE} + 1)) AS k FROM documents WHERE length(text) > 0))"

FANOUT = 16


def fixed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, doc_id, parent, level): documents under nodes of a fixed fan-out."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.concat(F.lit("0/"), F.col("doc_id").cast("string")).alias("child"), F.concat(F.lit("1/"), F.expr(f"doc_id div {FANOUT}").cast("string")).alias("parent"))
