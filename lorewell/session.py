"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # job metadata and chunk metadata merge with "later map wins"
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is worth an extra shuffle: split it even if the next step needs the partitioning back
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches for Python are bounded by size as well as by rows: texts may be very long
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    # streaming state on disk, so that it may outgrow an executor's memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above; cluster sizing stays with the cluster."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_local_folder: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the folder named in `spark.checkpoint.dir`.

    Only a local run for which none is named uses a temporary folder.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="lorewell-")
            atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
        base = _local_folder
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, compression: str | None = None, options: dict | None = None):
    """Write `df` to the shared folder, with the writer's `options`, and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, *keys: str):
    """Spread a scan with fewer splits than cores, such as one small file, over all cores.

    A table of many files already has more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
