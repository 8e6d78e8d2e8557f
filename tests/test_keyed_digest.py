"""The keyed digest replayed day by day: baseline, changes, a failed delivery, an incomplete collection, a restart; beside the plain comparison of snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewell.streaming import keyed_digest as K

MONDAY = datetime(2024, 1, 1, 6, tzinfo=timezone.utc)


def test_next_delivery_over_clock_changes():
    at = lambda s: int(datetime.fromisoformat(s).timestamp() * 1000)
    assert K.next_delivery(at("2024-01-01T07:30:00+00:00"), "07:30", "UTC") == at("2024-01-02T07:30:00+00:00")
    assert K.next_delivery(at("2024-03-09T20:00:00+00:00"), "07:30", "America/Denver") == at("2024-03-10T13:30:00+00:00")  # summer time began that night
    assert K.next_delivery(at("2024-11-02T14:00:00+00:00"), "07:30", "America/Denver") == at("2024-11-03T14:30:00+00:00")


def test_days_of_a_digest(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, sent, down = f"file://{tmp_path}/events", [], set()
    days = [{"a", "b", "c"}, {"a", "b", "d"}, {"a", "d", "e"}, set(), {"a", "e", "f"}, {"a", "b", "e", "f"}]  # the fourth collection failed
    complete = [0, 1, 2, 4, 5]

    def send(df, batch_id):
        day = int(df.select(F.date_format("day", "d").alias("d")).first().d)
        if day in down:
            raise K.DeliveryError("no connection")
        sent.append((day, sorted((r.change, r.key) for r in df.collect())))

    def runs():
        return spark.createDataFrame([((MONDAY + timedelta(days=d)).replace(hour=7, minute=30),) for d in complete], "day timestamp")

    baseline = spark.createDataFrame([(k, k.upper(), MONDAY) for k in days[0]], "key string, shown string, seen_at timestamp")
    down.add(2)  # Tuesday's delivery fails
    spark.createDataFrame([], K.EVENTS).write.parquet(source)
    for d in range(1, len(days)):
        at = MONDAY + timedelta(days=d)
        rows = [(k, f"{k.upper()} of day {d}", "seen", None, at) for k in days[d]] + [("", None, "tick", None, at.replace(hour=8))]
        spark.createDataFrame(rows, K.EVENTS).write.mode("append").parquet(source)
        digest = K.KeyedDigest(spark, f"file://{tmp_path}/digest", send, runs)  # a new object each day: a restart
        digest.start(spark.readStream.schema(K.EVENTS).parquet(source), baseline).awaitTermination()

    # snapshots compared with the last one that was delivered
    want, last = [], days[0]
    for d in range(1, len(days)):
        if d in complete and 1 + d not in down:
            change = sorted([("added", k) for k in days[d] - last] + [("removed", k) for k in last - days[d]])
            want += [(1 + d, change)] if change else []
            last = days[d]
    assert sent == want and len(want) == 3
