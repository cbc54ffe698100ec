"""Helpers that the operators share: written cuts of the lineage, word rules, hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a translate table and a regex.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir, which all executors share; deleted when the session's JVM
    ends. Where the setting is unset, a local master gets a temporary folder; a cluster, whose executors would each write
    to a disk of their own, an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="memloom-"))
    path = f"{base.rstrip('/')}/memloom/{sc.applicationId}"
    if path not in _kept:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _kept.add(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a few small files would leave most of them idle: at most a partition's bytes a core are
    shuffled, and nothing is where the table is large or has many files. Results don't hang on it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files, plan = df.inputFiles(), df._jdf.queryExecution().optimizedPlan()
    most = cores * int(spark.sparkContext._jsc.sc().conf().getSizeAsBytes("spark.sql.files.maxPartitionBytes", "128m"))
    small = 0 < len(files) < cores and int(str(plan.stats().sizeInBytes())) < most
    return df.repartition(cores) if small else df


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memloom_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that no later result reads."""
    spark, path = df.sparkSession, df._memloom_path
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
