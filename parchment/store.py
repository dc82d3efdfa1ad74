"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may go without: it gets a temporary folder. A cluster without the setting is an error,
    as its executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parchment-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and any executor can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parchment-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.parchment_path = path
    return table


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(table: DataFrame | None) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    path = getattr(table, "parchment_path", None)
    if path:
        at, fs = _files(table.sparkSession, path)
        fs.delete(at, True)


#: Tables of fewer bytes are not worth dealing out; files are split at about as many bytes as the second figure.
LEAST_BYTES, SPLIT_BYTES = 1 << 20, 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it is a small table in fewer files than there are cores; any other table as it is.

    Parsing takes a core many times longer than reading, and a file may hold one group of rows only, which a scan gives to
    one task. Large tables come in more splits than there are cores, and nothing of them is moved; nor is a table that was dealt
    out before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if not LEAST_BYTES <= size < cores * SPLIT_BYTES or re.search(r"(?m)^\W*Repartition \d+, true", plan.toString()):
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as a row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join whose other side grows too: the join is a merge, whatever Spark takes the sizes to be.

    Behind a parser the sizes are guesses from the few columns that are left of a wide row, so Spark would take a table of
    millions of rows for a small one and have the driver broadcast it.
    """
    return df.hint("merge")


def replace(df: DataFrame, path: str) -> DataFrame:
    """Write df in place of the table at path, so that a reader sees the old rows or the new ones and never a part.

    The rows are committed beside it first; then the old folder is moved away, the new one moved in and the old one deleted.
    If the second move fails, the old folder is moved back.
    """
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside + ".new")
    (new, fs), (old, _), (at, _) = _files(spark, beside + ".new"), _files(spark, beside + ".old"), _files(spark, path)
    held = fs.exists(at)
    if held and not fs.rename(at, old):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(new, at):
        if held:
            fs.rename(old, at)
        raise OSError(f"{path} cannot be replaced")
    if held:
        fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)
