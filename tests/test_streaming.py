"""Structured Streaming monitors agree with their batch operators."""

import tempfile

from skylane.operators import experiment as ab
from skylane.sources.fixtures import fx_ab
from skylane.streaming import monitor


def test_ab_monitor_matches_batch(spark, sf_small):
    src = tempfile.mkdtemp(prefix="skylane-stream-ab-")
    batch = fx_ab(spark, sf_small).withColumnRenamed("ab_group", "GROUP").withColumnRenamed("converted", "CONVERTED")
    batch.repartition(4).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = monitor.ab_monitor(stream).writeStream.outputMode("complete").format("memory").queryName("ab_mon").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select * from ab_mon").first()
    want = ab.ab_ztest(batch).first()
    assert abs(got["p_value"] - want["p_value"]) < 1e-12 and got["abs_diff"] == want["abs_diff"]


def _log(seed=1, n=4000, days=12):
    import datetime as dt
    import random
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "signup", "purchase", "other"]
    return [(rng.randrange(60), t0 + dt.timedelta(seconds=rng.randrange(86400 * days)), rng.choice(kinds)) for _ in range(n)]


SCHEMA = "user_id long, ts timestamp_ntz, event_type string"


def _land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(path)


def test_event_funnel_stream_equals_batch_on_shuffled_files(spark):
    import datetime as dt
    import random
    from skylane.operators import funnel as fn
    from skylane.streaming.funnel import EventFunnelStream
    rows, root = _log(), tempfile.mkdtemp(prefix="skylane-funnel-")
    rng = random.Random(2)
    by_arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(40)))
    funnel = EventFunnelStream(spark, f"{root}/state", dt.timedelta(days=2))
    assert [r["ENTITY_DAYS"] for r in funnel.funnel().orderBy("STAGE_NO").collect()] == [0, 0, 0, 0]
    closed = []
    for i in range(0, len(rows), 1000):
        _land(spark, by_arrival[i:i + 1000], f"{root}/in")
        funnel.start(spark.readStream.schema(SCHEMA).parquet(f"{root}/in")).awaitTermination()
        closed.append(funnel.funnel().where("STAGE_NO = 1").first()["ENTITY_DAYS"])
    assert 0 < closed[1] < closed[2] < closed[3]  # days come out while the stream runs
    funnel.finish()
    funnel.finish()
    want = sorted(map(tuple, fn.event_funnel(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sorted(map(tuple, funnel.funnel().collect())) == want
    assert tuple(funnel.late().first()) == (0, 0)


def test_event_funnel_stream_counts_late_events_and_repeats_a_batch(spark):
    import datetime as dt
    from skylane.operators import funnel as fn
    from skylane.streaming.funnel import EventFunnelStream
    rows, root = sorted(_log(3, 1500), key=lambda r: r[1]), tempfile.mkdtemp(prefix="skylane-funnel-")
    late = [r for r in rows if r[0] % 7 == 0]
    timely = [r for r in rows if r[0] % 7]
    funnel = EventFunnelStream(spark, root, dt.timedelta(days=1))
    first = spark.createDataFrame(timely, SCHEMA)
    second = spark.createDataFrame([*late, (1, None, "view"), (None, rows[0][1], "view")], SCHEMA)
    funnel.add(first, 0)
    funnel.add(second, 1)
    before = sorted(map(tuple, funnel.funnel().collect()))
    again = EventFunnelStream(spark, root, dt.timedelta(days=1))  # the batch is run again by another driver
    again.add(second, 1)
    assert sorted(map(tuple, again.funnel().collect())) == before
    again.finish()
    limit = max(r[1] for r in timely) - dt.timedelta(days=1)
    kept = timely + [r for r in late if r[1].date() >= limit.date()]
    assert tuple(again.late().first()) == (len(late) - (len(kept) - len(timely)) + 1, 1)
    want = sorted(map(tuple, fn.event_funnel(spark.createDataFrame(kept, SCHEMA)).collect()))
    assert sorted(map(tuple, again.funnel().collect())) == want
    empty = EventFunnelStream(spark, root + "-none")
    empty.add(first.limit(0), 0)
    empty.finish()
    assert empty.funnel().where("ENTITY_DAYS > 0").count() == 0 and tuple(empty.late().first()) == (0, 0)
