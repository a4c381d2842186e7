"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All calendar arithmetic is UTC; a session handed to us may say otherwise."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else (local master only) a fresh one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of the current run's staged tables."""
    return f"{_staging_dir(spark)}/{_RUN.get()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read one expensive frame. The table is columnar, so each branch
    reads only its columns; it survives lost executors; and its file size is what the planner
    compares with the broadcast threshold.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _staging_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tickloom-{spark.sparkContext.applicationId}"


#: Folder of the tables that the current run stages.
_RUN: ContextVar[str] = ContextVar("staging run", default="shared")


@contextlib.contextmanager
def staging_run(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go to a folder of their own, which is deleted when the block ends.

    Tables that other frames of the session still read are left alone.
    """
    token = _RUN.set(f"run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{_staging_dir(spark)}/{_RUN.get()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _RUN.reset(token)
