import pytest
from pyspark.sql import functions as F

from docloom.operators.jobs import job_events, job_states
from docloom.streaming import events as E

FOLDER = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in files of consecutive times."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = spark.read.parquet(FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def drained(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def test_windows_of_a_stream_are_those_of_the_batch(spark, folder):
    stream = drained(spark, E.windowed(E.event_stream(spark, folder), late="400 days"), "w", "complete")
    assert {tuple(r) for r in stream.collect()} == {tuple(r) for r in E.windowed(spark.read.parquet(folder)).collect()}


def test_sessions(spark, folder):
    stream = drained(spark, E.sessions(E.event_stream(spark, folder), late="400 days"), "s", "complete")
    assert {tuple(r) for r in stream.collect()} == {tuple(r) for r in E.sessions(spark.read.parquet(folder)).collect()}


def test_deduplication(spark, folder):
    rows = E.event_stream(spark, folder)
    stream = drained(spark, E.deduplicated(rows.union(rows), late="400 days"), "d", "append")
    assert stream.count() == spark.read.parquet(folder).count() == E.deduplicated(spark.read.parquet(folder)).count()


def test_job_states_of_a_stream_are_those_of_the_batch(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = job_events(spark.read.parquet(folder)).where("job_id < 20")
        source = E.event_stream(spark, folder, per_trigger=100).where("user_id < 20")
        source = source.select(F.col("user_id").alias("job_id"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), "event_id", F.col("event_type").alias("event")).withWatermark("ts", "400 days")
        states = source.groupBy("job_id").transformWithStateInPandas(statefulProcessor=E.JobProcessor(), outputStructType="job_id long, status string, attempts int, n_events long", outputMode="Update", timeMode="EventTime")
        try:
            got = {(r.job_id, r.status, r.attempts, r.n_events) for r in drained(spark, states, "j", "update").collect()}
        except Exception as error:  # the state server needs protobuf, which isn't a dependency of this package
            if "protobuf" in str(error).lower():
                pytest.skip("protobuf isn't installed")
            raise
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {(r.job_id, r.status, r.attempts, r.n_events) for r in job_states(rows).collect()}
