"""Session, shared-folder and table helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quizlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIZLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SMALL_TABLE = 256 << 20  # bytes up to which a table in few files is spread over the cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder.

    A row group is read by one task, so a small table in fewer files than there are cores would occupy few of them; it
    is spread by one bounded shuffle. Larger tables, or those in many files, are left as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_TABLE:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-machine session that names none gets a folder of its own; on a cluster that folder would be
    the driver's alone, so it is refused.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quizlens-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


_STAGES: dict[str, SparkSession] = {}  # written tables that are still there


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def _forget(paths: list[str]) -> None:
    for path in paths:
        spark = _STAGES.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` once, as parquet, to the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation that could
    renumber or re-draw anything. ``release`` removes the table when nothing reads it any more,
    ``stages`` all tables of a block, and what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGES[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` returned; frames derived from them must have been written or collected."""
    _forget([p for t in tables if (p := getattr(t, "_stage_path", None))])


@contextmanager
def stages() -> Iterator[None]:
    """Remove at the end of the block whatever was materialised in it."""
    before = set(_STAGES)
    try:
        yield
    finally:
        _forget([p for p in _STAGES if p not in before])


atexit.register(lambda: _forget(list(_STAGES)))
