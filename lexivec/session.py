"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a folder of our own is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = os.path.join(tempfile.gettempdir(), "lexivec-checkpoints")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.LocalFileSystem").isInstance(fs):
        fs = fs.getRawFileSystem()  # without files of checksums beside the files
    return fs, where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever file system it is."""
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def read_text(path: str) -> str:
    """A small text file of whatever file system the session knows; without a session a local one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, value: str) -> None:
    """Write a small text file beside its place and move it there, so it is never half there."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            f.write(value)
        os.replace(f"{path}.tmp", path)
        return
    fs, where = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(beside, True)  # its folders too
    try:
        out.write(bytearray(value.encode("utf-8")))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"cannot write {path}")


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` on all cores before Python work: small inputs of few files are repartitioned.

    Inputs with as many partitions as cores, so all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
