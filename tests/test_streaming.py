from pyspark.sql import functions as F

from tablesmith.streaming.cleaning import frozen
from tablesmith.streaming.windows import files, sessions, sliding, tumbling


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = files(spark, str(tmp_path / "in"), events.schema)
    n = [F.count(F.lit(1)).alias("n")]
    for name, plan in {
        "s_tumbling": lambda d: tumbling(d, "ts", "1 hour", ["event_type"], n, "1 minute"),
        "s_sliding": lambda d: sliding(d, "ts", "2 hours", "1 hour", ["event_type"], n, "1 minute"),
        "s_sessions": lambda d: sessions(d, "ts", "30 minutes", ["user_id"], n, "1 minute"),
    }.items():
        got = drained(plan(stream), name, "complete")
        assert sorted(map(str, got.collect())) == sorted(map(str, plan(events).collect()))


def test_frozen_votes_clean_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("$5", "yes", "15/04/2026", " a  b "), ("x", "maybe", "bad", "n/a")], "m string, b string, d string, t string")
    rows.write.parquet(str(tmp_path / "in"))
    types, orders = {"m": "numeric", "b": "boolean", "d": "date", "t": "text"}, {"d": "dmy"}
    got = drained(frozen(files(spark, str(tmp_path / "in"), rows.schema), types, orders), "s_clean")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5.0, True, "2026-04-15", "a b"), (None, None, None, None)], key=str)
