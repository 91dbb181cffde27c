"""Rows that come too late, kept beside the stream instead of vanishing behind a watermark.

Every micro-batch is split by one stored value, the latest event time of the batches before it: rows older than that less the delay go
to the late table, all others to the on-time table, and both are counted. The rule is Spark's own watermark, so a query that reads
the on-time table with the same delay drops nothing. A batch that runs again writes the same rows to the same folders.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.streaming.tables import BATCH, batch_writer, read_batches

PROGRESS = "latest timestamp, n bigint, n_late bigint"


@dataclass
class LateGate:
    """Folders and delay of one gate; `time` is the column with the event time. Rows without one are on time."""

    base: str
    delay: dt.timedelta
    time: str = "ts"

    @property
    def on_time_path(self) -> str:
        return f"{self.base}/on_time"

    @property
    def late_path(self) -> str:
        return f"{self.base}/late"

    def counts(self, spark: SparkSession) -> DataFrame:
        """(batch, latest, n, n_late): rows of each batch, the late ones among them, and the latest time up to its end."""
        return read_batches(spark, f"{self.base}/progress", StructType.fromDDL(PROGRESS))

    def latest(self, spark: SparkSession, before: int) -> dt.datetime | None:
        """The latest event time of all earlier batches: one row, read from the batch before."""
        row = self.counts(spark).filter(F.col(BATCH) == before - 1).select("latest").first() if before else None
        return row and row["latest"]

    def process(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        latest = self.latest(spark, batch_id)
        late = F.lit(False) if latest is None else F.coalesce(F.col(self.time) < F.lit(latest - self.delay), F.lit(False))
        seen = Observation()
        marked = rows.withColumn("__late", late).observe(
            seen, F.max(self.time).alias("latest"), F.count(F.lit(1)).alias("n"), F.count_if("__late").alias("n_late")
        )
        marked = marked.persist()  # a lost part is computed again from the batch, whose offsets are fixed
        batch_writer(self.on_time_path)(marked.filter(~F.col("__late")).drop("__late"), batch_id)
        batch_writer(self.late_path)(marked.filter("__late").drop("__late"), batch_id)
        marked.unpersist()
        found = seen.get
        latest = max((t for t in (latest, found["latest"]) if t is not None), default=None)
        progress = spark.createDataFrame([(latest, found["n"], found["n_late"])], PROGRESS)
        batch_writer(f"{self.base}/progress")(progress, batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Split everything that is there and stop."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def on_time(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The on-time rows as a stream."""
        return spark.readStream.schema(schema).parquet(f"{self.on_time_path}/{BATCH}=*").select(*schema.names)

    def late(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The late rows so far, with their batch."""
        return read_batches(spark, self.late_path, schema)
