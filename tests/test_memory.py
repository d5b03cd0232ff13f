"""The stream of turns against the fold of the whole table."""

import time

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import answer
from lumenfold.streaming import jobs, memory


@pytest.fixture
def store(spark):
    for k, v in memory.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in memory.STORE:
        spark.conf.unset(k)


def ran(spark, folder, out, schema):
    stream = jobs.files(spark, f"{folder}/in", schema, 1)
    found = memory.remembered(stream, "conv_id", "turn", ["topic", "place"])
    query = found.writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_fold(spark, sf, tmp_path, store):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.md5("text")).alias("topic"), F.when(F.col("turn") % 3 == 1, F.substring("text", 1, 9)).alias("place"))
    shuffled = turns.withColumn("batch", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))).cache()
    for batch in range(4):
        if batch == 2:  # the first half runs, and the rest starts again from its checkpoint
            ran(spark, tmp_path, "out", turns.schema)
        shuffled.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ran(spark, tmp_path, "out", turns.schema)
    found = spark.read.parquet(f"{tmp_path}/out").drop("late").withColumnRenamed("conversation", "conv_id")
    expected = answer.fold_memory(turns, "conv_id", "turn", ["topic", "place"])
    assert found.count() == expected.count()
    assert found.select(*expected.columns).exceptAll(expected).isEmpty() and expected.exceptAll(found.select(*expected.columns)).isEmpty()


def test_gaps_late_turns_and_lifetime(spark, tmp_path, store):
    schema = spark.createDataFrame([], "conv_id string, turn long, topic string, place string").schema
    (tmp_path / "in").mkdir()
    found = memory.remembered(jobs.files(spark, f"{tmp_path}/in", schema, 1), "conv_id", "turn", ["topic", "place"], patience_ms=1, lifetime_ms=9000)
    query = found.writeStream.queryName("turns").format("memory").trigger(processingTime="200 milliseconds").start()

    def add(upto, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        end = time.time() + 60
        while spark.table("turns").count() < upto and time.time() < end and query.isActive:
            time.sleep(0.3)

    try:
        add(3, ("a", 0, "x", None), ("a", 2, None, "p"), (None, 0, None, "n"))  # turn 1 of a doesn't come in time
        add(5, ("a", 1, None, "q"), ("a", 3, None, None))
        time.sleep(12)
        add(6, ("a", 4, None, None))
        got = {(r.conversation, r.turn): (r.known_topic, r.known_place, r.late) for r in spark.table("turns").collect()}
    finally:
        query.stop()
    assert got == {("a", 0): ("x", None, False), (None, 0): (None, "n", False), ("a", 2): ("x", "p", False), ("a", 1): ("x", "q", True), ("a", 3): ("x", "q", False), ("a", 4): (None, None, False)}
