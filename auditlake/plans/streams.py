"""Streams over the driver's events, run as streams: files arrive in three parts, each run stops and the next goes on from its checkpoint.

Events come in order of time but for every fiftieth, which comes a part late. SQL follows the watermark: before a part it
is the latest time of the parts before, less the delay; rows or windows that it has passed are left out, and what it has
not passed at the end has not come out yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import history
from ..shared import scratch_path, ship
from ..streaming import events as ev

PARTS = 3


def _arriving(spark: SparkSession, sf_dir: str, late: bool = True) -> list[DataFrame]:
    """The events in parts: thirds of their time, and every fiftieth one part later."""
    events = ship(spark).read.parquet(f"{sf_dir}/events.parquet")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    third = F.expr(f"cast({PARTS} * (unix_micros(cast(ts as timestamp)) - unix_micros(cast(a as timestamp))) div (unix_micros(cast(b as timestamp)) - unix_micros(cast(a as timestamp)) + 1) as int)")
    part = F.least(third + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0), F.lit(PARTS - 1)) if late else third
    rows = events.crossJoin(F.broadcast(span)).withColumn("part", part).drop("a", "b")
    rows = rows.select("part", F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", F.col("event_type").alias("session"), (F.col("event_id") % 7).alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"), F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end").alias("kind"))
    return [rows.filter(F.col("part") == k).drop("part") for k in range(PARTS)]


def _appended(spark: SparkSession, parts: list[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an append-mode stream has written after all parts."""
    place, schemas = scratch_path(spark, "stream"), []

    def start(stream: DataFrame) -> DataStreamWriter:
        out = made(stream)
        schemas.append(out.schema)
        return out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")

    ev.arrivals(parts, f"{place}/in", start)
    return spark.read.schema(schemas[-1]).parquet(f"{place}/out")


def _plain(df: DataFrame) -> DataFrame:
    """Times as the driver's tables have them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


# Parts, the watermark before each (milliseconds) and at the end.
_ARRIVING = """t AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
    q AS (SELECT e.*, ({parts} * (epoch_us(ts) - epoch_us(a))) // (epoch_us(b) - epoch_us(a) + 1) AS third FROM events e, t WHERE {only}),
    r AS (SELECT q.*, least(third + CASE WHEN {late} AND event_id % 50 = 7 THEN 1 ELSE 0 END, {parts} - 1) AS part FROM q),
    p AS (SELECT part, epoch_ms(max(ts)) - {delay} AS top FROM r GROUP BY part),
    m AS (SELECT x.part, coalesce(max(p.top), 0) AS mark FROM range({parts} + 1) AS x(part) LEFT JOIN p ON p.part < x.part GROUP BY x.part),
    e AS (SELECT r.*, mark, (SELECT mark FROM m WHERE part = {parts}) AS final FROM r JOIN m USING (part))"""


def _arriving_sql(delay_ms: int, late: bool = True, only: str = "true") -> str:
    return _ARRIVING.format(parts=PARTS, late=str(late).lower(), delay=delay_ms, only=only)


HOUR = 3_600_000


def stream_usage_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L02 with late rows: hours that the watermark has passed."""
    return _plain(_appended(spark, _arriving(spark, sf_dir), lambda s: ev.usage_per_window(s, "1 hour", late="12 hours")).drop("end"))


def stream_usage_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L02: two hours, each hour."""
    return _plain(_appended(spark, _arriving(spark, sf_dir), lambda s: ev.usage_per_window(s, "2 hours", "1 hour", "12 hours")).drop("end"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L03: sessions by inactivity that the watermark has passed."""
    return _plain(_appended(spark, _arriving(spark, sf_dir, late=False), ev.activity_sessions))


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L04: totals of each session after all parts."""
    place = scratch_path(spark, "stream")
    ev.arrivals(_arriving(spark, sf_dir), f"{place}/in", lambda s: ev.latest_rows(ev.running_totals(s), f"{place}/out", f"{place}/checkpoint"))
    rows = spark.read.parquet(f"{place}/out")
    kept = [c for c in rows.columns if c not in ("n", "batch", "session")]
    return _plain(rows.groupBy("session").agg(F.max_by(F.struct(*kept), "batch").alias("x")).select("session", "x.*"))


def stream_call_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01 as a stream: starts and ends of each user, paired once the watermark has passed them."""
    parts = [p.filter("kind is not null").select(F.col("user_id").alias("session"), "ts", "kind", "output_tokens") for p in _arriving(spark, sf_dir)]
    out = _appended(spark, parts, lambda s: ev.live_call_durations(s, "12 hours"))
    return _plain(out.select("session", "ts", F.round("duration_s", 3).alias("duration_s")))


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L06: every third event comes twice in its part and once more in the next; each is kept once."""
    parts = [p.select("event_id", "ts", "session") for p in _arriving(spark, sf_dir)]
    again = [p.filter("event_id % 3 = 0") for p in parts]
    parts = [p.unionByName(a) if k == 0 else p.unionByName(a).unionByName(again[k - 1]) for k, (p, a) in enumerate(zip(parts, again, strict=True))]
    out = _appended(spark, parts, lambda s: ev.without_repeats(s, late="4000 days"))
    return out.groupBy("session").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L07: events that the watermark had passed when they came, and those kept."""
    place = scratch_path(spark, "stream")
    parts = [p.select("event_id", "ts") for p in _arriving(spark, sf_dir)]
    runs = ev.arrivals(parts, f"{place}/in", lambda s: ev.without_repeats(s, late="12 hours").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint"))
    late = sum(ev.dropped(q) for q in runs)
    return spark.read.parquet(f"{place}/out").agg(F.count("*").alias("kept")).withColumn("late", F.lit(late).cast("long"))


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L05: events as findings of their users, upserted into a history part by part."""
    place = scratch_path(spark, "stream")
    title, user = F.col("session"), F.col("user_id")
    found = [p.select(F.concat(F.lit("u"), user.cast("string")).alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), title.alias("title"), F.lit("info").alias("severity"), F.lit("other").alias("category"), F.lit(1.0).alias("confidence"), F.col("ts").alias("seen_at")) for p in _arriving(spark, sf_dir)]
    for part in found:
        part.write.mode("append").parquet(f"{place}/in")
        ev.stream_history(spark.readStream.schema(part.schema).parquet(f"{place}/in"), f"{place}/history", f"{place}/checkpoint").awaitTermination()
    kept = history.current(spark, f"{place}/history")
    return _plain(kept.select("file_path", "title", F.col("run_count").cast("long").alias("run_count"), "first_seen", "last_seen"))


_WINDOW = "SELECT {start} AS start, event_type AS session, sum(event_id % 7)::BIGINT AS input_tokens, sum(floor(value)::BIGINT)::BIGINT AS output_tokens, count(*) AS calls FROM {rows} WHERE epoch_ms({start}) + {length} > mark AND epoch_ms({start}) + {length} <= final GROUP BY ALL"
ORACLE_SQL = {
    "stream_usage_tumbling": f"WITH {_arriving_sql(12 * HOUR)} " + _WINDOW.format(start="date_trunc('hour', ts)", rows="e", length=HOUR),
    "stream_usage_sliding": f"WITH {_arriving_sql(12 * HOUR)} " + _WINDOW.format(start="date_trunc('hour', ts) - to_hours(j)", rows="e, (VALUES (0), (1)) v(j)", length=2 * HOUR),
    "stream_sessions": f"""WITH {_arriving_sql(HOUR, False)}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM s GROUP BY user_id, k HAVING epoch_us(max(ts)) + 1800000000 <= any_value(final) * 1000""",
    "stream_totals": "SELECT event_type AS session, sum(event_id % 7)::BIGINT AS input_tokens, sum(floor(value)::BIGINT)::BIGINT AS output_tokens, count(*) AS calls, max(ts) AS last_ts FROM events GROUP BY event_type",
    "stream_call_durations": f"""WITH {_arriving_sql(12 * HOUR, only="event_type IN ('click', 'purchase')")}, k AS (SELECT user_id, ts, final, CASE WHEN event_type = 'click' THEN 'start' ELSE 'end' END AS kind FROM e WHERE epoch_us(ts) > mark * 1000),
    x AS (SELECT *, lag(ts) OVER w AS p, lag(kind) OVER w AS k FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN kind = 'start' THEN 0 ELSE 1 END))
    SELECT user_id AS session, ts, round((epoch_us(ts) - epoch_us(p)) / 1000000.0, 3) AS duration_s FROM x WHERE kind = 'end' AND k = 'start' AND epoch_us(ts) < final * 1000""",
    "stream_repeats": "SELECT event_type AS session, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type",
    "stream_late": f"WITH {_arriving_sql(12 * HOUR)} SELECT count(*) FILTER (epoch_us(ts) > mark * 1000) AS kept, count(*) FILTER (epoch_us(ts) <= mark * 1000) AS late FROM e",
    "stream_findings": f"""WITH {_arriving_sql(0)}, top AS (SELECT part, max(ts) AS seen FROM e GROUP BY part), g AS (SELECT user_id, event_type, count(*) AS n, min(part) AS a, max(part) AS b FROM e GROUP BY ALL)
    SELECT 'u' || user_id AS file_path, event_type AS title, n AS run_count, x.seen AS first_seen, y.seen AS last_seen FROM g JOIN top x ON x.part = a JOIN top y ON y.part = b""",
}
QUERIES = {f.__name__: f for f in (stream_usage_tumbling, stream_usage_sliding, stream_sessions, stream_totals, stream_call_durations, stream_repeats, stream_late, stream_findings)}
