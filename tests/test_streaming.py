import time

from pyspark.sql import functions as F
from siftworks.operators.state import sweep_states
from siftworks.streaming.sweep import IDLE, append_log, last_streaks, sweep_stream, use_rocksdb

SF = "/root/testdata/sf0.001"
VERDICTS = "CAST(user_id AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "CASE event_type WHEN 'error' THEN 'unverifiable_direct' WHEN 'click' THEN 'stale' ELSE 'live' END AS verdict"


def run(stream, out, checkpoint):
    """All that is there in one batch; the checkpoint lets the next call go on. Result files, so that restarts add to them."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
    assert query.awaitTermination(120)


def rows_of(df):
    return {(r.event_id, r.verdict, r.streak, r.escalated) for r in df.collect()}


def test_sweep_stream_equals_the_batch_over_restarts(spark, tmp_path):
    use_rocksdb(spark)
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = rows_of(sweep_states(events.selectExpr(*VERDICTS), "key", ["ts", "event_id"]))
    cuts = [r.t for r in events.selectExpr("explode(percentile_approx(ts, array(0.0, 0.2, 0.5, 0.8, 1.0))) AS t").collect()]
    for i in range(4):  # the query stops and goes on between the parts
        part = events.where((F.col("ts") > cuts[i]) & (F.col("ts") <= cuts[i + 1]) | ((F.lit(i) == 0) & (F.col("ts") <= cuts[0])))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(sweep_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).selectExpr(*VERDICTS), 3_600_000), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want


def test_sweep_stream_goes_on_from_a_batch_log(spark, tmp_path):
    use_rocksdb(spark)
    events = spark.read.parquet(f"{SF}/events.parquet")
    all_states = sweep_states(events.selectExpr(*VERDICTS), "key", ["ts", "event_id"])
    cut = events.selectExpr("percentile_approx(ts, 0.5) AS t").first().t
    before = sweep_states(events.where(F.col("ts") <= cut).selectExpr(*VERDICTS), "key", ["ts", "event_id"])
    events.where(F.col("ts") > cut).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).selectExpr(*VERDICTS)
    run(sweep_stream(stream, first=last_streaks(before, ["ts", "event_id"])), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(all_states.where(F.col("ts") > cut))


def test_idle_keys_go(spark, tmp_path):
    use_rocksdb(spark)
    schema = "key string, ts timestamp, event_id long, verdict string"

    def feed(*rows):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(sweep_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 8_000, tell_idle=True), str(tmp_path / "out"), str(tmp_path / "cp"))
        return {(r.key, r.event_id, r.verdict, r.streak) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    unsure = "unverifiable_direct"
    assert feed(("a", "2024-01-01", 1, unsure), ("b", "2024-01-01", 2, unsure)) == {("a", 1, unsure, 1), ("b", 2, unsure, 1)}
    time.sleep(9)
    # Both keys are past their time: a starts anew, b is told as idle and is gone.
    got = feed(("a", "2024-01-02", 3, unsure))
    assert ("a", 3, unsure, 1) in got and ("b", None, IDLE, 0) in got
    got = feed(("b", "2024-01-03", 4, unsure))
    assert ("b", 4, unsure, 1) in got


def test_append_log(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for checkpoint, times in (("cp2", 1), ("cp2", 1), ("cp3", 2)):  # the same query again adds nothing, a new one keeps what is there
        append_log(stream, str(tmp_path / "log"), str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "log")).count() == times * events.count()
