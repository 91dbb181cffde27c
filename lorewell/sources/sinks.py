"""Writers: the chunk store, note and dead-letter messages, reports and golden sets.

The chunk store appends: a version holds the chunks it adds and a narrow log of keys that came or went, and a manifest
row publishes it. Readers merge the versions; compaction folds them into one. Nothing that is read is ever overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.operators.indexing import diff_counts
from lorewell.schemas import RUN_COLUMNS
from lorewell.session import materialize

MANIFEST = "version bigint, kind string, user_buckets int, source_buckets int"
#: What identifies a stored chunk: its key and its owner, so that a document that changes user is replaced.
IDENTITY = ["chunk_key", "owner"]


def _owner() -> Column:
    """The user as text; a missing user differs from an empty one."""
    return F.coalesce(F.concat(F.lit("u"), F.col("user_id")), F.lit(""))


@dataclass(frozen=True)
class ChunkStore:
    """A chunk store below `base`.

    `chunks/version=N` holds added rows by user bucket, `keys/version=N` the (key, owner, source, live) changes by source
    bucket. An update reads the key log of its sources' buckets only and writes in proportion to the batch. The bucket counts may be
    changed at any time: every version keeps the counts it was written with.
    """

    base: str
    user_buckets: int = 32
    source_buckets: int = 16

    @staticmethod
    def bucket(value: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(n)).cast("int")

    def manifest(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], MANIFEST)
            raise

    def current(self, spark: SparkSession) -> list:
        """The versions that make up the index: the last full one and the changes after it."""
        versions = self.manifest(spark).orderBy("version").collect()
        full = max((i for i, r in enumerate(versions) if r["kind"] == "full"), default=0)
        return versions[full:]

    def holds(self, spark: SparkSession, version: int) -> bool:
        """Whether a version is published; a replayed batch finds its own number and is skipped."""
        return not self.manifest(spark).filter(F.col("version") == version).isEmpty()

    def _parts(self, spark: SparkSession, what: str, schema: T.StructType, by: str, wanted: DataFrame | None) -> DataFrame:
        """Rows of `what` over the current versions; with `wanted` (one column), only buckets that can hold its values."""
        counts = f"{by}s"
        out = None
        versions = self.current(spark)
        for n in sorted({r[counts] for r in versions}):
            folder = f"{self.base}/{what}"
            paths = [f"{folder}/version={r['version']}" for r in versions if r[counts] == n]
            full = T.StructType(list(schema.fields)).add(by, T.IntegerType())
            rows = spark.read.schema(full).option("basePath", folder).parquet(*paths)
            if wanted is not None:
                buckets = [r[0] for r in wanted.select(self.bucket(F.col(wanted.columns[0]), n)).distinct().collect()]
                rows = rows.filter(F.col(by).isin(buckets))  # at most n numbers
            out = rows.drop(by) if out is None else out.unionByName(rows.drop(by))
        return spark.createDataFrame([], schema) if out is None else out

    def _keys(self, spark: SparkSession, sources: DataFrame | None = None) -> DataFrame:
        schema = T.StructType.fromDDL("chunk_key string, owner string, source string, live boolean, version bigint")
        return self._parts(spark, "keys", schema, "source_bucket", sources)

    def _live(self, spark: SparkSession, sources: DataFrame) -> DataFrame:
        """(chunk_key, owner, source) of the stored chunks of the given sources (column source)."""
        changes = self._keys(spark, sources).join(sources.distinct(), "source", "left_semi")
        newest = changes.groupBy(*IDENTITY).agg(F.max_by(F.struct("live", "source"), "version").alias("n"))
        return newest.filter("n.live").select(*IDENTITY, "n.source")

    def sources(self, spark: SparkSession, asked: DataFrame) -> DataFrame:
        """Those of the asked sources (column source) that have chunks in the store."""
        return self._live(spark, asked).select("source").distinct()

    def _publish(self, spark: SparkSession, version: int, kind: str, chunks: DataFrame, keys: DataFrame) -> None:
        """Write one version. `rebalance` sizes the files and splits a bucket that holds much more than the others."""
        placed = chunks.withColumn("user_bucket", self.bucket(F.col("user_id"), self.user_buckets))
        logged = keys.select(
            F.col("chunk_key").cast("string").alias("chunk_key"), "owner", "source", "live",
            self.bucket(F.col("source"), self.source_buckets).alias("source_bucket"),
        )
        for rows, what, by in ((placed, "chunks", "user_bucket"), (logged, "keys", "source_bucket")):
            rows.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(f"{self.base}/{what}/version={version}")
        row = [(version, kind, self.user_buckets, self.source_buckets)]
        spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.base}/manifest")

    def write(self, chunks: DataFrame, version: int) -> None:
        """Publish the chunks as the whole index."""
        unique = _stored_unique(chunks.withColumn("owner", _owner()), "whole")
        keys = unique.select(*IDENTITY, "source", F.lit(True).alias("live"))
        self._publish(chunks.sparkSession, version, "full", unique.drop("owner"), keys)

    def read(self, spark: SparkSession, schema, users: Sequence[str] | None = None) -> DataFrame:
        """The current chunks. With `users`, only the buckets that can hold their chunks are opened.

        A chunk is live unless a later version took its key away; the removed keys are the small side of the join
        until compaction folds them in.
        """
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        stored = T.StructType(list(schema.fields)).add("version", T.LongType())
        wanted = None if users is None else spark.createDataFrame([(u,) for u in users], "user_id string")
        rows = self._parts(spark, "chunks", stored, "user_bucket", wanted)
        if wanted is not None:
            rows = rows.filter(F.col("user_id").isin(list(users)))
        gone = self._keys(spark).filter(~F.col("live")).groupBy(*IDENTITY).agg(F.max("version").alias("gone"))
        gone = gone.select(*[F.col(c).alias(f"gone_{c}") for c in IDENTITY], "gone")
        dead = (
            (F.col("chunk_key").cast("string") == F.col("gone_chunk_key")) & (F.col("gone_owner") == _owner())
            & (F.col("version") < F.col("gone"))
        )
        return rows.join(gone, dead, "left_anti").select(*[f.name for f in schema.fields])

    def update(self, incoming: DataFrame, version: int) -> dict[str, int]:
        """Bring the sources of a batch of chunks in step with it; returns how many chunks were added, skipped and deleted."""
        spark = incoming.sparkSession
        incoming = _stored_unique(incoming.withColumn("owner", _owner()), "incoming")
        new = incoming.select(F.col("chunk_key").cast("string").alias("chunk_key"), "owner", "source")
        old = self._live(spark, incoming.select("source"))
        old = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns])
        same = (F.col("chunk_key") == F.col("old_chunk_key")) & (F.col("owner") == F.col("old_owner"))
        op = F.when(F.col("old_chunk_key").isNull(), "added").when(F.col("chunk_key").isNull(), "deleted").otherwise("skipped")
        joined = new.join(old, same, "full_outer").select(
            *[F.coalesce(c, f"old_{c}").alias(c) for c in [*IDENTITY, "source"]], op.alias("op")
        )
        diff = materialize(joined, "diff")
        counts = diff_counts(diff).first().asDict()
        if counts["num_added"] or counts["num_deleted"]:
            changed = diff.filter("op <> 'skipped'")
            keys = changed.select(*IDENTITY, "source", (F.col("op") == "added").alias("live"))
            if counts["num_skipped"]:  # else every incoming chunk is new
                kept = diff.filter("op = 'skipped'").select(F.col("chunk_key").alias("old_key"), F.col("owner").alias("old_owner"))
                known = (F.col("chunk_key").cast("string") == F.col("old_key")) & (F.col("owner") == F.col("old_owner"))
                incoming = incoming.join(kept, known, "left_anti")
            self._publish(spark, version, "delta", incoming.filter("chunk_key IS NOT NULL").drop("owner"), keys)
        return counts

    def delete(self, sources: DataFrame, schema, version: int) -> int:
        """Take away all chunks of the given sources (column source); returns how many there were."""
        spark = sources.sparkSession
        gone = materialize(self._live(spark, sources.select("source")), "gone")
        n = gone.count()
        if n:
            self._publish(spark, version, "delta", spark.createDataFrame([], schema), gone.withColumn("live", F.lit(False)))
        return n

    def compact(self, spark: SparkSession, schema, version: int) -> None:
        """Fold all versions into one, with this store's bucket counts."""
        self.write(self.read(spark, schema), version)

    def vacuum(self, spark: SparkSession) -> list[int]:
        """Remove the folders of versions before the last full one; returns their numbers. No reader may still use them."""
        kept = {r["version"] for r in self.current(spark)}
        old = sorted(r["version"] for r in self.manifest(spark).collect() if r["version"] not in kept)
        for version in old:
            for what in ("chunks", "keys"):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{what}/version={version}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return old


def _stored_unique(chunks: DataFrame, name: str) -> DataFrame:
    """The chunks, written, and one row per identity of them. Texts are only shuffled for identities that occur more than once."""
    stored = materialize(chunks, name)
    repeated = stored.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = materialize(repeated.select(*[F.col(c).alias(f"again_{c}") for c in IDENTITY]), f"{name}-repeated")
    if repeated.isEmpty():
        return stored
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"again_{c}"))
    return stored.join(repeated, same, "left_anti").unionByName(_unique(stored.join(repeated, same, "left_semi")))


def _unique(chunks: DataFrame) -> DataFrame:
    """One row per identity: of rows with one key and owner the one that comes first in its source."""
    others = [c for c in chunks.columns if c not in IDENTITY]
    order = [c for c in ("source", "chunk_index", "content") if c in others]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return chunks.groupBy(*IDENTITY).agg(first).select(*IDENTITY, "r.*").select(*chunks.columns)


def publish_notes(events: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    """Write note events (key, value) to a Kafka topic, or as JSON message files."""
    if kafka:
        events.select("key", "value").write.format("kafka").options(**kafka).save()
        return
    headers = F.array().cast("array<struct<key:string,value:string>>")
    messages = events.select("key", "value", headers.alias("headers"), F.current_timestamp().alias("timestamp"))
    messages.write.mode("append").json(path)


def write_dead_letters(letters: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of dead letters; writing the same batch again replaces it."""
    letters.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def write_csv_report(exported: DataFrame, path: str) -> None:
    """Runs as CSV with the report's column names, newest first."""
    named = exported.select(*[F.col(name).alias(label) for label, name in RUN_COLUMNS.items()])
    newest_first = named.orderBy(F.col("Start Time").desc(), "Run ID")
    newest_first.write.mode("overwrite").csv(
        path, header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSSXXX"
    )


def write_golden(golden: DataFrame, path: str) -> None:
    golden.write.mode("overwrite").json(path)
