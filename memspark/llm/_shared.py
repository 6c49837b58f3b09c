"""Small helpers that several operators use: durable intermediate tables and safe names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word everywhere in this subpackage: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset a session on one machine (tests) gets a temporary folder as its
    checkpoint folder; a cluster is refused, as its machines would not see it.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='memspark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage in the shared folder, so a lost executor costs a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, for larger tables."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(folder: str) -> str:
    """The mounted path of a shared folder that workers map into memory; other schemes are refused."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder or not os.path.isabs(folder):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder to map files from it, not {folder}")
    return folder


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, *_LOWER)


def held(col: Column) -> Column:
    """``col`` as it is, but so that filters stay above its projection: pushed below, they would compute its arrays anew for each element of a lambda."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def carried(df: DataFrame, *cols: Column) -> DataFrame:
    """``df`` as one column ``_row`` beside ``cols``, so that names of the input meet none of an operator's own. ``restored`` takes it apart."""
    return df.select(F.struct("*").alias("_row"), *cols)


def restored(df: DataFrame, columns: list[str], **made: Column | str) -> DataFrame:
    """The input's ``columns`` in their order with the ``made`` ones: in the place of a column of that name, else at the end."""
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in made.items()}
    kept = [made[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in made.items() if k not in columns])


def row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``_rk``: equal for rows of equal id and text, and the same on every recomputation.

    Repeated rows share the key and so the decision taken for it; nulls have keys of their own.
    """
    return df.withColumn("_rk", F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col), F.col(id_col)).alias("h")))


def small_arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds at once: long texts make the default of 10,000 rows a batch too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def dealt(df: DataFrame, parts: int, part: str) -> DataFrame:
    """``df`` in ``parts`` partitions by a number from 0 on, each number in one of its own: plain hashing would put several together and leave others empty."""
    ids = df.sparkSession.range(64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    own = {r["p"]: r["id"] for r in ids.collect()}
    return df.repartition(parts, F.get(F.lit([own.get(k, k) for k in range(parts)]).cast("array<bigint>"), F.col(part)))
