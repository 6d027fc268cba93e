"""Streams that stop and go on from their checkpoint, and histories of which an upsert rewrites the touched buckets only."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditlake.operators import history, usage
from auditlake.streaming import events as ev

CALLS = "session string, ts timestamp, kind string, output_tokens long"
START = datetime(2024, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(seconds=t), k, n) for s, t, k, n in rows], CALLS)


def test_live_durations_equal_the_batch_over_several_runs(spark, tmp_path):
    first = [("a", 0, "start", 0), ("b", 1, "end", 5), ("a", 7, "end", 70), ("b", 9, "start", 0), (None, 2, "start", 0)]
    second = [("b", 4, "start", 0), ("b", 10, "end", 3), ("a", 30, "start", 0), ("a", 30, "end", 9), ("a", 31, "end", 9), (None, 33, "end", None)]  # b's start at 4 comes late, within the watermark
    third = [("b", 40, "start", 0), ("z", 4000, "end", 1)]
    late = [("a", 5, "start", 0), ("z", 9000, "end", 1)]  # passed by the watermark: left out
    parts = [calls(spark, rows) for rows in (first, second, third, late)]
    place = f"file://{tmp_path}"
    sink = lambda s: ev.live_call_durations(s, "10 minutes").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    ev.arrivals(parts, f"{place}/in", sink)
    got = sorted(spark.read.parquet(f"{place}/out").collect(), key=str)
    want = sorted(usage.call_durations(calls(spark, first + second + third)).filter("ts < '2024-01-01 01:00:00'").collect(), key=str)
    assert got == want
    assert len(got) == 4


def test_live_durations_by_buckets_in_any_time_zone(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(40)}", t, rng.choice(["start", "end"]), rng.randrange(9)) for t in rng.sample(range(4000), 600)]
    parts = [calls(spark, rows[at : at + 200]) for at in (0, 200, 400)] + [calls(spark, [("z", 90000, "end", 1)])]
    want = sorted(usage.call_durations(calls(spark, rows)).collect(), key=str)
    place = f"file://{tmp_path}"
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ev.arrivals(parts, f"{place}/in", lambda s: ev.live_call_durations(s, "2 hours", buckets=3).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(spark.read.parquet(f"{place}/out").collect(), key=str) == want and len(want) > 100


def findings(spark, names):
    rows = [(n, 1, 1, n, "info", "other", 1.0) for n in names]
    return history.with_fingerprint(spark.createDataFrame(rows, "file_path string, line_start int, line_end int, title string, severity string, category string, confidence double"))


def folders(path):
    return {f"{v}/{b}" for v in os.listdir(f"{path}/data") for b in os.listdir(f"{path}/data/{v}") if b.startswith("bucket=")}


def test_an_upsert_writes_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "h")
    at = lambda day: F.lit(datetime(2024, 1, day)).cast("timestamp")
    assert history.upsert(findings(spark, [f"n{i}" for i in range(100)]), root, at(1)) == 1
    before = folders(root)
    assert history.upsert(findings(spark, ["n3"]), root, at(2)) == 2
    assert len(folders(root) - before) == 1
    rows = {r.title: r.run_count for r in history.current(spark, root).collect()}
    assert rows == {f"n{i}": 1 + (i == 3) for i in range(100)}
    assert history.upsert(findings(spark, ["n3"]), root, at(2), version=1) == 2  # a retried run counts once
    assert {r.run_count for r in history.lookup(history.current(spark, root), findings(spark, ["n3"]).first().fingerprint).collect()} == {2}
    assert history.upsert(findings(spark, []), root, at(3)) == 3
    assert history.upsert(findings(spark, ["new"]), root, at(4)) == 4
    history.prune(spark, root, 1)
    assert history.current(spark, root).count() == 101
    assert {f.split("/")[0] for f in folders(root)} <= {"v=1", "v=2", "v=4"}
    assert len(folders(root)) == len({r[0] for r in history.current(spark, root).select(history._bucket()).collect()})
    history.clear(spark, root)
    assert history.current(spark, root).count() == 0


def test_late_and_repeated_rows(spark, tmp_path):
    rows = [spark.createDataFrame([(i, START + timedelta(minutes=m)) for i, m in part], "event_id long, ts timestamp") for part in ([(1, 0), (1, 0), (2, 60)], [(1, 0), (3, 10), (4, 70), (2, 60)])]
    place = f"file://{tmp_path}"
    runs = ev.arrivals(rows, f"{place}/in", lambda s: ev.without_repeats(s, late="30 minutes").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint"))
    assert sorted(r.event_id for r in spark.read.parquet(f"{place}/out").collect()) == [1, 2, 4]
    assert sum(map(ev.dropped, runs)) == 2
