"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: set[str] = set()
_SCOPES: list[str] = []


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else one beside the warehouse; every executor must reach it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the interpreter ends with the session still open."""
    app = spark.sparkContext.applicationId
    if app not in _OPEN:
        _OPEN.add(app)
        atexit.register(_drop_quietly, spark)
    return f"{shared_folder(spark)}/tidepanel/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([_own_folder(spark), *_SCOPES, f"{name}-{uuid.uuid4().hex[:12]}"])


@contextlib.contextmanager
def scratch_scope(name: str):
    """What is staged inside goes to a folder of its own, which ``drop_scratch`` can delete alone."""
    _SCOPES.append(name)
    try:
        yield
    finally:
        _SCOPES.pop()


def drop_scratch(spark: SparkSession, scope: str | None = None) -> None:
    """Delete what this application staged or checkpointed, or a scope of it; call it when the results are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_folder(spark) + (f"/{scope}" if scope else ""))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _drop_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        drop_scratch(spark)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Use it where a result feeds several later steps: it is computed once, survives
    lost executors, stays column-prunable, and its size on disk is known, so that
    the optimizer broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def allow_checkpoints(spark: SparkSession) -> None:
    """Name a checkpoint folder where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    allow_checkpoints(df.sparkSession)
    return df.checkpoint()
