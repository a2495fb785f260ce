"""Session settings this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tablescope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    # Tasks share the cores of an executor, so linear algebra in a Python worker takes one thread.
    session.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    session.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    return folder.rstrip("/")
