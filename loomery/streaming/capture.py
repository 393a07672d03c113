"""Continuous capture with Structured Streaming (ST1-ST6, ST11).

Transcript lines arrive in files of a folder. State is kept a session: the open exchange only. An exchange
is final once a later human turn, a final stop reason or ten quiet minutes end it; until then it is given
out as in flight and replaced by name later. Names hang on a turn's time, so a restart or a repeated
capture gives the same rows, and the sink is an upsert.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomery.config import CONFIG
from loomery.operators.capture import is_machine
from loomery.sources.buckets import BucketTable

FINAL = ("end_turn", "stop_sequence")
OUT = "session_id string, name string, ask string, reply string, ts timestamp, end_ts timestamp, turns int, in_flight boolean"
STATE = "ask string, reply string, ts timestamp, end_ts timestamp, turns int, stop string"


def turns_stream(spark: SparkSession, folder: str, schema: str = "session_id string, ix long, role string, text string, ts timestamp, stop_reason string") -> DataFrame:
    """ST1: a growing folder of turns as a stream; files are taken once, by checkpoint."""
    return spark.readStream.schema(schema).json(folder)


def _name(session: str, ts) -> str:
    return f"x-{session[:8]}-{pd.Timestamp(ts).strftime('%Y%m%dT%H%M%S')}{pd.Timestamp(ts).microsecond // 1000:03d}Z"


def assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, event_time: bool = False) -> Iterator[pd.DataFrame]:
    """ST3, ST4: folds a session's new turns into exchanges; gives closed ones and the open one."""
    session = key[0]
    open_ = list(state.get) if state.exists else None
    out: list[tuple] = []

    def row(x: list, flying: bool) -> tuple:
        return (session, _name(session, x[2]), x[0], x[1], x[2], x[3], x[4], flying)

    if state.hasTimedOut:
        if open_ is not None:
            out.append(row(open_, False))
        state.remove()
    else:
        parts = [b for b in batches if len(b)]
        if parts:
            for t in pd.concat(parts).sort_values("ix").itertuples():
                if t.human:
                    if open_ is not None:
                        out.append(row(open_, False))
                    open_ = [t.text, "", t.ts, t.ts, 1, None]
                elif open_ is not None:
                    if t.role == "assistant":
                        open_[1] = t.text if not open_[1] else f"{open_[1]}\n\n{t.text}"
                        open_[5] = t.stop_reason
                    open_[3], open_[4] = max(open_[3], t.ts), open_[4] + 1
        if open_ is not None:
            out.append(row(open_, open_[5] not in FINAL))
            state.update(tuple(open_))
            if event_time:
                quiet = pd.Timestamp(open_[3]).value // 1_000_000 + CONFIG.quiet_minutes * 60_000
                state.setTimeoutTimestamp(max(quiet, state.getCurrentWatermarkMs() + 1))
            else:
                state.setTimeoutDuration(CONFIG.quiet_minutes * 60_000)
    yield pd.DataFrame(out, columns=["session_id", "name", "ask", "reply", "ts", "end_ts", "turns", "in_flight"])


def exchanges_stream(turns: DataFrame, event_time: bool = False) -> DataFrame:
    """ST3: exchanges of a stream of turns, open ones as in flight.

    ``event_time``: an exchange is quiet by the times of the turns, once a turn of any session is ten minutes past it (and the watermark's delay of
    as much); else by the clock of the machine.
    """
    human = (F.col("role") == "user") & ~is_machine(F.col("text"))
    rows = turns.withColumn("human", human)
    if event_time:
        rows = rows.withWatermark("ts", f"{CONFIG.quiet_minutes} minutes")
    timers = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("session_id").applyInPandasWithState(partial(assemble, event_time=event_time), OUT, STATE, "update", timers)


def upsert_sink(path: str, buckets: int = 64):
    """ST4, ST6: a foreachBatch function that replaces rows by name; only buckets that a batch touches are written anew."""

    def write(batch: DataFrame, _: int) -> None:
        # a batch that is replayed replaces its own rows by equal ones; numbers of batches begin anew with a new checkpoint, so they decide nothing
        BucketTable(batch.sparkSession, path, "name", buckets).upsert(batch, [F.desc("turns"), F.col("in_flight")])

    return write


def captured(spark: SparkSession, path: str, since=None) -> DataFrame:
    """The table of the sink; ST5: only what was active after ``since``."""
    rows = BucketTable(spark, path, "name").read()
    if rows is None:
        rows = spark.createDataFrame([], OUT)
    return rows if since is None else rows.where(F.col("end_ts") >= F.lit(since))


def start(turns: DataFrame, path: str, checkpoint: str, once: bool = True, event_time: bool = False):
    """ST2: runs the capture, once over what is there or every five minutes.

    A run over what is there is one batch: with timers of the machine's clock, batches for them would follow without end. Timers by ``event_time`` end by themselves, but
    drop turns that are older than the watermark.
    """
    w = exchanges_stream(turns, event_time).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert_sink(path))
    if once:
        return (w.trigger(availableNow=True) if event_time else w.trigger(once=True)).start()
    return w.trigger(processingTime="5 minutes").start()
