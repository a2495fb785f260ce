"""What the operators of this folder share: Arrow passes over tables, shared staging, texts as words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``df``; tasks hold one batch at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def share(spark: SparkSession, value) -> Callable:
    """Broadcast an object of bounded size; the result returns it, loaded once in each task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held = []

    def get():
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session that names none gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and kept when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, divisor: int) -> Column:
    """CRC-32 of the column as text, modulo ``divisor``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""
