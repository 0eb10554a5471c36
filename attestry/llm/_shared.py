"""Helpers that the corpus operators share: table reading and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes up to which a side of a join may be sent to every task; beyond, both sides are exchanged.
SENT_BYTES = 64 << 20


def sent(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", row: int = 32) -> DataFrame:
    """A join that sends ``small``, of ``row`` bytes a row, to every task if it has few enough bytes; its rows are counted."""
    return big.join(F.broadcast(small) if small.count() * row <= SENT_BYTES else small, on, how)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for cut lineage.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark
    runs inside this one process (tests) is a temporary folder used instead.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="attestry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor cannot lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` as Parquet in folders by the columns ``by``.  The table stands for the plan from then on: the plan's shuffle files go."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame) -> DataFrame:
    """Like ``durable`` but as columns, for wide rows; whoever wrote the table hands it to ``released`` once nothing reads it any more."""
    path = f"{shared_dir(df.sparkSession)}/attestry-{uuid.uuid4().hex}"
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Gives a folder another name, through the file system that holds it."""
    sc = spark.sparkContext
    old, new = sc._jvm.org.apache.hadoop.fs.Path(old), sc._jvm.org.apache.hadoop.fs.Path(new)
    if not old.getFileSystem(sc._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"cannot move {old} to {new}")


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` wrote, through the file system that holds them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("attestry-"):
                raise ValueError(f"not a table of written(): {folder}")
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
