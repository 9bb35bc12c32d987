"""Session helpers: reading tables, shared scratch space, spreading small inputs over the cores."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the scan is left to Catalyst (pruning and pushdown apply)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


@atexit.register
def _clean() -> None:
    for d in _OWN:
        shutil.rmtree(d, ignore_errors=True)


def scratch(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names a folder shared by all executors in ``spark.checkpoint.dir``. Only where that
    setting is absent and Spark runs in this one process (tests, a laptop) a local folder is made, and
    removed at the end; on a cluster it is an error, since each executor would see its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN.append(tempfile.mkdtemp(prefix="termloom-"))
        sc.setCheckpointDir(_OWN[-1])
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again.

    Cuts the lineage with files every executor can read, so a lost executor costs nothing, and lets
    several consumers share one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int | None:
    """Bytes a plan reads as the optimizer knows them from file sizes, None if it doesn't. Runs nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return n if n < 1 << 60 else None


def partitions_of(df: DataFrame, per_core: int = 2, split: int = 64 << 20) -> int:
    """Partitions for costly row-wise work: enough for all cores, and none much over ``split`` bytes of
    files."""
    return max(df.sparkSession.sparkContext.defaultParallelism * per_core, (size_of(df) or 0) // split)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """More partitions for costly row-wise work where the input has fewer splits than the cluster has cores.

    Decided by file sizes, without running anything: large inputs have more splits than cores and pass
    unchanged, so the shuffle is only ever paid on inputs of a few hundred MB."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = size_of(df)
    return df.repartition(cores * per_core) if size is not None and size < cores * split else df
