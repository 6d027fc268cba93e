"""Structured Streaming over usage events, findings and guideline files. Each function also takes a batch table, but for the sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import guidelines, history
from ..sources.files import guideline_documents


def usage_per_window(events: DataFrame, length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tokens per window (tumbling, or sliding with ``slide``) and session; events later than the watermark are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "session").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session", "input_tokens", "output_tokens", "calls")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions by inactivity."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def running_totals(events: DataFrame) -> DataFrame:
    """Totals per session so far, for update mode; state is one row per session."""
    return events.groupBy("session").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"), F.max("ts").alias("last_ts"))


#: Fixed value: sessions are dealt to so many buckets; a call for each session would cost more than its events do.
CALL_BUCKETS = 1024
#: What a bucket keeps between batches, as Arrow streams: events that the watermark has not passed, and each session's last one that it has.
_WAITING = "waiting binary, last binary"
_CALLS = pa.schema([("session", pa.string()), ("us", pa.int64()), ("ends", pa.bool_()), ("tokens", pa.int64())])


def _stored(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CALLS) as out:
        out.write_table(pa.Table.from_pandas(rows, _CALLS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def live_call_durations(events: DataFrame, late: str = "10 minutes", buckets: int = CALL_BUCKETS) -> DataFrame:
    """``session, ts, duration_s, tokens_per_s`` of each end event from the start just before it, as a stream.

    events(session, ts, kind 'start' or 'end', output_tokens). Events wait until the watermark has passed them, and are
    then taken in the order of :func:`..operators.usage.call_durations`, so arrival order and batches make no difference;
    events that come after the watermark, and those without a time, are left out. State is what a session has within the
    watermark, kept for a bucket of sessions at a time.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(x).read_all().to_pandas() for x in state.getOption] if state.exists else [_CALLS.empty_table().to_pandas()] * 2
        rows = pd.concat([held[0], *(() if state.hasTimedOut else (b[_CALLS.names] for b in batches))], ignore_index=True)
        passed = state.getCurrentWatermarkMs() * 1000
        due, waiting = rows[rows["us"] < passed], rows[rows["us"] >= passed]
        run = pd.concat([held[1].assign(now=False), due.assign(now=True)], ignore_index=True)
        run = run.assign(code=pd.factorize(run["session"], use_na_sentinel=False)[0]).sort_values(["code", "now", "us", "ends", "tokens"], kind="stable", ignore_index=True)
        code, us, ends = run["code"].to_numpy(), run["us"].to_numpy(np.int64), run["ends"].to_numpy(bool)
        same = code[1:] == code[:-1]
        hit = np.flatnonzero(same & ends[1:] & ~ends[:-1]) + 1
        seconds, tokens = (us[hit] - us[hit - 1]) / 1e6, run["tokens"].to_numpy(np.int64)[hit]
        rate = np.divide(tokens, seconds, out=np.full(len(hit), np.nan), where=(seconds > 0.01) & (tokens > 0))
        state.update((_stored(waiting), _stored(run[np.append(~same, True)[: len(run)]][_CALLS.names])))
        if len(waiting):
            state.setTimeoutTimestamp(int(waiting["us"].min()) // 1000 + 1)
        if len(hit):
            yield pd.DataFrame({"session": run["session"].iloc[hit], "us": us[hit], "duration_s": seconds, "tokens_per_s": pd.Series(rate, run.index[hit])})

    kind, session = events.schema["session"].dataType, F.col("session").cast("string")
    rows = events.filter("ts is not null").select(session.alias("session"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col("kind") == "end", F.lit(False)).alias("ends"), F.coalesce(F.col("output_tokens").cast("long"), F.lit(0)).alias("tokens"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets))).withWatermark("ts", late)
    out = dealt.groupBy("bucket").applyInPandasWithState(pair, "session string, us long, duration_s double, tokens_per_s double", _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("session").cast(kind).alias("session"), F.timestamp_micros("us").alias("ts"), "duration_s", F.nanvl("tokens_per_s", F.lit(None)).alias("tokens_per_s"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class LateRows(StreamingQueryListener):
    """Adds up the rows that watermarks drop, by query name: ``spark.streams.addListener(late := LateRows())``, then ``late.dropped``.

    A listener sees every batch; a query's recent progress holds the last hundred only.
    """

    def __init__(self) -> None:
        self.dropped: dict[str | None, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def dropped(query: StreamingQuery) -> int:
    """Rows that watermarks dropped in a query that has ended after a hundred batches at most."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def arrivals(parts: list[DataFrame], inbox: str, start: Callable[[DataFrame], DataStreamWriter]) -> list[StreamingQuery]:
    """Put each part into the folder ``inbox`` and run the stream over it until all is read; each run goes on from the one before."""
    runs = []
    for part in parts:
        part.write.mode("append").parquet(inbox)
        runs.append(start(part.sparkSession.readStream.schema(part.schema).parquet(inbox)).trigger(availableNow=True).start())
        runs[-1].awaitTermination()
    return runs


def latest_rows(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """An update-mode stream into a folder for each batch; of several rows of a key that of the last ``batch`` holds."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/n={n}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def stream_history(findings: DataFrame, root: str, checkpoint: str, lines: DataFrame | None = None):
    """Findings with ``seen_at`` into the history at ``root``, micro-batch by micro-batch.

    A stream goes on from the version that it finds when it starts; batch n of a checkpoint makes the version n + 1 after
    that one (kept beside the checkpoint), so a retried batch is written again from the same version and counts once. A
    batch rewrites the buckets only that its findings fall into; versions before the last two go.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        mark = f"{checkpoint}/history-start"
        try:
            start = spark.read.parquet(mark).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            start = history.latest_version(spark, root)
            spark.range(1).select(F.lit(start).alias("start")).write.mode("overwrite").parquet(mark)
        keyed = history.with_fingerprint(batch, lines)
        now = F.lit(batch.agg(F.max("seen_at")).first()[0]).cast("timestamp")
        history.upsert(keyed, root, now, start + n)
        history.prune(spark, root)

    return findings.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_guidelines(spark: SparkSession, folder: str, index: str, checkpoint: str, embedder=None):
    """New guideline files at any depth into the index: chunks of a source replace its former ones.

    Sources are named and chosen as by ``read_guidelines``, without a limit on their number.
    """
    docs = guideline_documents(spark.readStream.option("recursiveFileLookup", "true").text(folder, wholetext=True), folder)

    def held() -> bool:
        try:
            return bool(spark.read.parquet(index).columns)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False  # batches so far held no guideline files

    def put(batch: DataFrame, n: int) -> None:
        chunks = guidelines.embed_chunks(guidelines.chunk_documents(batch), embedder)
        if not held():
            guidelines.write_index(chunks, index)
        else:
            guidelines.replace_sources(chunks, index)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
