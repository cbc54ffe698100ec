"""Session logs and the views that stand in for them over the star-schema tables.

A session log is JSON lines: a header, then entries. `scan_jsonl` reads any number of files at once and counts lines that
don't parse; `ledger` and the other views give the same shapes over given Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENTRY = "type string, id string, parentId string, timestamp string, customType string, summary string, firstKeptEntryId string, cwd string, message struct<role:string,content:string>, content string, data struct<observations:array<struct<id:string,content:string,timestamp:string,relevance:string,sourceEntryIds:array<string>,tokenCount:bigint>>,reflections:array<struct<id:string,content:string,supportingObservationIds:array<string>,tokenCount:bigint>>,observationIds:array<string>,coversUpToId:string>"
#: What an event stands for in the ledger.
KINDS = {"view": "message", "click": "observation", "signup": "reflection", "purchase": "compaction", "error": "drop"}
TIERS = ("low", "medium", "high", "critical")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files over all cores; nothing is shuffled of a large one."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = cores * int(spark.sparkContext._jsc.sc().conf().getSizeAsBytes("spark.sql.files.maxPartitionBytes", "128m"))
    small = 0 < len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < most
    return df.repartition(cores) if small else df


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0, within the file), entry, ok: blank lines are passed over, malformed ones keep ok false."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.filter(F.trim("value") != "").withColumn("entry", F.from_json("value", ENTRY, {"mode": "PERMISSIVE"}))
    place = F.row_number().over(W.partitionBy("file").orderBy("block", "at")) - 1
    return lines.select("file", place.cast("long").alias("line"), "entry", F.col("entry.type").isNotNull().alias("ok"))


def scan_report(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.count_if("ok").alias("entries"), F.count_if(~F.col("ok")).alias("parse_errors"))


def observations_of(entries: DataFrame) -> DataFrame:
    """Rows for every observation that entries record."""
    rows = entries.filter(F.col("entry.customType") == "om.observations.recorded").select("file", "line", F.col("entry.data.coversUpToId").alias("covers_up_to_id"), F.posexplode("entry.data.observations").alias("record", "o"))
    return rows.select("file", "line", "record", "covers_up_to_id", "o.*")


def scope_dir(cwd: Column) -> Column:
    """A working directory as a partition name: --a-b--."""
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(cwd, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, pos, idx (place among all messages of the session), role, text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("idx", (F.row_number().over(W.partitionBy("session_id").orderBy("pos")) - 1).cast("long"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, pos, kind, tokens, key: the events of a user in order of time as entries of a session."""
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", kind.alias("kind"), F.ceil("value").cast("long").alias("tokens"), F.get_json_object("props", "$.k").cast("long").alias("key"))
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")) - 1).cast("long")).drop("ts")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, content, session_id, relevance: documents as observations, tiers by their labels."""
    labels = table(spark, sf_dir, "labels")
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when((F.col("quality") == 1) & (F.col("toxic") == 1), "critical").when(F.col("quality") == 0, "low").otherwise("medium")
    docs = spread(table(spark, sf_dir, "documents")).withColumn("content", F.coalesce("text", F.lit("")))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("ord"), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 12).alias("id"), "content", F.col("source").alias("session_id"), tier.alias("relevance"))
