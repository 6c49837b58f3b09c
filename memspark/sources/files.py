"""Readers and writers of logs, snapshots, notes and profiles. Malformed lines are set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

REWARD_EVENT = "reward_id string, timestamp string, reward_type string, reward double, memory_ids array<string>, experience string, context string, explanation string"
PREDICTION = "id string, timestamp string, schema_version int, status string, pack_id string, pack_author string, cited_step string, case_id string, applied_action string, prevented_action string, expected_signal string, expected_window_days int, notes string, prediction string, confidence double, strategic_value double, memory_ids_used array<string>, client_id string"
OUTCOME = "prediction_id string, timestamp string, actual_signal string, outcome string, source string, days_to_resolve int, reward double, cause_category string, notes string"
RETRIEVAL = "session_id string, timestamp string, query string, memory_ids array<string>, scores array<double>"
OBSERVATION = "id string, timestamp string, session_id string, type string, tool string, summary string, project string, context struct<file_path:string,command:string>, tags array<string>"
DEALS = "deal_id string, stage string, client_id string, name string, value string, paid_date string"
LEADS = "lead_id string, stage string, company_id string, estimated_value string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed lines with the given columns."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, pos: raw lines with the order of the file: the byte that the block begins at which a task reads, and the place of the line among what the task reads, which grows within a block."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), pos.alias("pos"))


def lines_per_file(spark: SparkSession, path: str) -> DataFrame:
    """date (from the file's name) and lines, by files named with a date."""
    rows = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    return rows.select(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), "file", "lines").where("date != ''")


def read_notes(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """date, name and the start of each dated note: what a retrospective reads of one."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.substring("value", 1, most).alias("text"))
    return rows.withColumn("date", F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})-", 1)).where("date != ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their place in the file; none where there is no file."""
    try:
        rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = empty(spark, schema)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def read_deals(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DEALS)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LEADS)


def read_usefulness(spark: SparkSession, path: str) -> DataFrame:
    """A nested map of memories and contexts as rows; a flat map (values at the first level) is read as the context ``default``."""
    entry = "struct<q_value:double,q_action:double,q_hypothesis:double,q_fit:double,q_visits:int,q_updated_at:string,last_reward:double,reward_contexts:array<string>,protected:boolean>"
    raw = spark.read.text(path, wholetext=True)
    flat = raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("memory_id", "e")).where("e.q_value is not null").select("memory_id", F.lit("default").alias("experience"), "e.*")
    nested = raw.select(F.explode(F.from_json("value", f"map<string,map<string,{entry}>>")).alias("memory_id", "m")).select("memory_id", F.explode("m").alias("experience", "e")).where("e.q_value is not null").select("memory_id", "experience", "e.*")
    return nested.unionByName(flat)


def append_log(rows: DataFrame, path: str, date: str | None = None) -> None:
    """Append-only logs as Parquet, partitioned by day where a date column is named."""
    writer = rows.write.mode("append")
    (writer.partitionBy(date) if date else writer).parquet(path)


def write_chunks(messages: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    """One folder of JSON lines for each chunk."""
    messages.repartition(chunk).write.mode("overwrite").partitionBy(chunk).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The chunks' rows as JSON lines in order of the chunk, beside their folders."""
    manifest.repartitionByRange(1, "chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").json(f"{path.rstrip('/')}/manifest")


def snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
