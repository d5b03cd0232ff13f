"""Streaming jobs; each is a transformation of a stream, or of a batch with the same columns.

They extend the batch operators: files arrive, rows are merged by id, late rows are bounded by a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.storage import removed


def files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, total) of tumbling windows; rows later than the watermark are left out of a stream."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark("__t", late).groupBy(F.window("__t", window).alias("w"), F.col(kind).alias("kind"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n) of sessions that a gap ends."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = stamped.groupBy(F.col(user).alias("user"), F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.dropDuplicatesWithinWatermark([key]).drop("__t")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The written versions of each bucket of a merged table, by its folders; under -1 the batches that were finished."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if not store.exists(at):
        return found
    for bucket in store.listStatus(at):
        name = bucket.getPath().getName()
        if name == "done":
            found[-1] = sorted(int(x.getPath().getName()) for x in store.listStatus(bucket.getPath()))
        elif name.startswith("merge_bucket="):
            inside = [x.getPath().getName() for x in store.listStatus(bucket.getPath())]
            found[int(name.partition("=")[2])] = sorted(int(x.partition("=")[2]) for x in inside if x.startswith("merge_version="))
    return found


def _newest(versions: dict[int, list[int]], upto: int) -> dict[int, int]:
    return {b: max(own) for b, vs in versions.items() if b >= 0 and (own := [v for v in vs if v <= upto])}


def merge_into(path: str, key: str, time: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key by ``time`` in a table of ``buckets`` parts, by the key's hash.

    A batch reads and rewrites only the buckets that its keys are in, as a new version of each, and then
    marks itself as done. A batch that runs again writes its versions again, so the merge is idempotent;
    a version is kept until a batch that is done has replaced it twice. ``merged`` reads the table.
    """

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(time)).alias("row")).select("row.*")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(key), F.lit(buckets))
        fresh = newest(batch)
        touched = [r[0] for r in fresh.select(place).distinct().collect()]  # buckets at most
        versions = _versions(spark, path)
        old = _newest(versions, batch_id - 1)
        held = [f"{path}/merge_bucket={b}/merge_version={old[b]}" for b in touched if b in old]
        every = newest(spark.read.schema(fresh.schema).parquet(*held).unionByName(fresh)) if held else fresh
        out = every.select("*", place.alias("merge_bucket"), F.lit(batch_id).alias("merge_version"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("merge_bucket", "merge_version").parquet(path)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done/{batch_id}")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
        removed(spark, *[f"{path}/merge_bucket={b}/merge_version={v}" for b in touched if b in old for v in versions[b] if v < old[b]], *[f"{path}/done/{i}" for i in versions.get(-1, []) if i < batch_id - 1])

    return merge


def merged(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table of ``merge_into`` after the last batch that is done."""
    versions = _versions(spark, path)
    done = max(versions.get(-1, [-1]))
    paths = [f"{path}/merge_bucket={b}/merge_version={v}" for b, v in sorted(_newest(versions, done).items())]
    read = spark.read.schema(schema) if schema else spark.read
    return read.parquet(*paths)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process what is there, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
