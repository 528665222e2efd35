"""The tape as a stream (SRC-13, STR-1..6, STR-8..10).

Set operators use watermarks and window aggregates. The rules that carry state per key (order, guard, dip signal, last reference) run in event time:
``in_event_time`` keeps the rows of a key that the watermark has not passed in a reorder buffer, and an event-time timer releases them in order.
So files may come in any order within the delay and the rows that come out equal the batch operator's. Rows behind the watermark are dropped by Spark,
which counts them (``run_counted``), or marked (``ordered_tape``). A key's buffer holds one delay of its rows.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.clean import BandFilter
from tidemark.session import ensure_checkpoint_dir

DELAY = "2 hours"  # how far out of order a row may come


def stream_tape(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    """SRC-13: a folder of tape files as a stream."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and read its sink; both live in the shared folder."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_counted(df: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """``run_available`` and the number of rows that stateful operators dropped as too late, from the progress of every trigger."""
    spark, dropped = df.sparkSession, {}

    class Late(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            dropped[str(p.runId), p.batchId] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

        def onQueryTerminated(self, event):
            ended.set()

    ended, late = threading.Event(), Late()
    spark.streams.addListener(late)
    try:
        out = run_available(df, mode)
        ended.wait(60)  # the last progress comes before the end
    finally:
        spark.streams.removeListener(late)
    return out, sum(dropped.values())


def watermarked_tape(df: DataFrame, ts: str = "event_time", delay: str = DELAY) -> DataFrame:
    """The tape with its watermark: rows may come up to ``delay`` out of order."""
    return df.withWatermark(ts, delay)


def ordered_tape(df: DataFrame, key: Sequence[str], delay: str = DELAY) -> DataFrame:
    """STR-1: rows that come up to ``delay`` out of order, put in order: ``seq`` numbers the rows of a key by time. A row that comes after later rows
    of its key went out has a null ``seq``; one that lies behind the watermark of the trigger before is dropped by Spark (``run_counted``)."""
    def late(rows):
        return pd.DataFrame({"blk": rows["blk"], "ts": rows["ts"], "seq": pd.array([None] * len(rows), dtype="Int64")})

    def step(held, rows):
        n = (held or {}).get("n", 0)
        after = n + len(rows["blk"])
        return {"n": after}, pd.DataFrame({"blk": rows["blk"], "ts": rows["ts"], "seq": np.arange(n, after, dtype=np.int64)})
    return in_event_time(df, key, "blk long, ts long, seq long", step, ("ts", "blk"), delay=delay, on_late=late)


def stream_dedupe(df: DataFrame, keys: Sequence[str] = ("blk", "li")) -> DataFrame:
    """STR-2: the same log from several collectors counts once within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def stream_candles(df: DataFrame, key: Sequence[str], width: str, ts: str = "event_time") -> DataFrame:
    """STR-3: tumbling OHLCV, emitted once the watermark passes the end of the window."""
    pos = F.struct(ts, "blk")
    return df.groupBy(*key, F.window(ts, width)).agg(
        F.min_by("px", pos).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", pos).alias("close"),
        F.sum("usd").alias("vol"), F.count("*").alias("n"))


def stream_activity(df: DataFrame, key: Sequence[str], width: str, step: str, min_usd: float = 10.0, ts: str = "event_time") -> DataFrame:
    """STR-4: sliding counts of large prints."""
    return df.filter(F.col("usd") >= min_usd).groupBy(*key, F.window(ts, width, step)).agg(F.count("*").alias("n"))


def stream_sessions(df: DataFrame, key: Sequence[str], gap: str, ts: str = "event_time") -> DataFrame:
    """STR-8: activity sessions, closed after a silence of ``gap``."""
    return df.groupBy(*key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.sum("usd").alias("vol"))


Step = Callable[[dict | None, dict[str, list]], tuple[dict, pd.DataFrame]]


def in_event_time(df: DataFrame, key: Sequence[str], out_schema: str, step: Step, columns: Sequence[str], order: Sequence[str] = ("ts", "blk"),
                  ts: str = "event_time", delay: str | None = DELAY, on_late: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """A sequential rule per key in event time: ``step(state, rows)`` sees the rows of ``columns`` in ``order``, once the watermark has passed them.
    ``rows`` maps columns to plain lists: most keys have few rows, and a frame of its own for each would cost more than the rule.

    Rows that it has not passed wait in the state; a timer at the first of them releases what is due. The rule's own state never expires. A row that
    comes after later rows of its key went through the rule has no part in it; ``on_late`` says what comes out for such rows (nothing by default). Without ``delay`` the stream has its watermark already.
    """
    names = list(dict.fromkeys([*columns, *order]))
    spots = [1 + names.index(c) for c in order]

    def place(row: list) -> list:
        """Where a row stands in the order; what is missing comes last."""
        return [(v is None or v != v, 0 if v is None or v != v else v) for v in map(row.__getitem__, spots)]

    def run(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        saved = json.loads(state.get[0]) if state.exists else {"held": None, "wait": [], "done": None}
        mark, done, rows = state.getCurrentWatermarkMs(), saved["done"], saved["wait"]
        if not state.hasTimedOut:
            for pdf in batches:
                rows += map(list, zip(*[pdf[c].tolist() for c in ("_ms", *names)], strict=True))
            if done is not None:
                if on_late and any(r[0] < done for r in rows):
                    yield on_late(pd.DataFrame([r for r in rows if r[0] < done], columns=["_ms", *names]))
                rows = [r for r in rows if r[0] >= done]
        due = [r for r in rows if r[0] < mark]
        wait = [r for r in rows if r[0] >= mark] if len(due) < len(rows) else []
        held, out = saved["held"], ()
        if due:
            done = max(r[0] for r in due)
            due.sort(key=place)
            held, out = step(held, dict(zip(("_ms", *names), map(list, zip(*due, strict=True)), strict=True)))
        state.update((json.dumps({"held": held, "wait": wait, "done": done}),))
        if wait:
            state.setTimeoutTimestamp(max(min(r[0] for r in wait), mark + 1))
        if len(out):
            yield out

    rows = (df.withWatermark(ts, delay) if delay else df).select(*key, ts, F.unix_millis(ts).alias("_ms"), *[c for c in names if c not in key])
    return rows.groupBy(*key).applyInPandasWithState(run, out_schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_guard(df: DataFrame, key: Sequence[str], band: float = 20.0, window: int = 15, min_n: int = 5, confirm: float = 2.0, delay: str = DELAY) -> DataFrame:
    """STR-5: the bad-print guard on the stream; its state is the last accepted prices and never expires."""
    def step(held, rows):
        g = BandFilter(band, window, min_n, confirm, False, held)
        px, usd = (np.array(rows[c], dtype=float) for c in ("px", "usd"))  # what is missing is not a number, so no valid print
        ok = (px > 0) & (usd >= 1)
        ok[ok] = g.flags(px[ok])
        return g.state(), pd.DataFrame({"blk": rows["blk"], "accepted": ok})
    return in_event_time(df, key, "blk long, accepted boolean", step, ("px", "usd"), delay=delay)


def stream_dip_signal(df: DataFrame, key: Sequence[str], dip: float, bucket_s: int = 60, buckets: int = 60, cooldown: int = 3600, delay: str = DELAY) -> DataFrame:
    """STR-6: signal when the price lies ``dip`` below the high of the last ``buckets`` buckets, outside the cool-down.
    A price of zero below a high of zero counts as a full loss, as in the SQL (0/0 is NaN there, above every number).

    The state is a falling queue: buckets that a later one tops can never be the high again, so the first is the high and every row costs a
    constant on average.
    """
    def step(held, rows):
        s = held or {"queue": [], "last": None}
        queue, last, out = deque(map(tuple, s["queue"])), s["last"], []
        for ts, blk, px in zip(rows["ts"], rows["blk"], rows["px"], strict=True):
            b = ts // bucket_s
            while queue and queue[0][0] <= b - buckets:
                queue.popleft()
            while queue and queue[-1][1] <= px:
                queue.pop()
            if not queue or queue[-1][0] != b:
                queue.append((b, px))
            high = queue[0][1]
            lost = 1 - px / high if high else 1.0
            if lost >= dip and (last is None or ts >= last + cooldown):
                last = ts
                out.append((blk, ts, px, high))
        return {"queue": [list(x) for x in queue], "last": last}, pd.DataFrame(out, columns=["blk", "ts", "px", "high"])
    return in_event_time(df, key, "blk long, ts long, px double, high double", step, ("px",), delay=delay)


def stream_asof_enrich(df: DataFrame, key: Sequence[str], is_ref: str, static: DataFrame | None = None, on: str | None = None, delay: str = DELAY) -> DataFrame:
    """STR-9: the last reference price of the key on each other row, after a stream-static join with a dimension table."""
    df = watermarked_tape(df, delay=delay)  # before the join: rows that it drops move time on as well
    if static is not None:
        df = df.join(static, on)

    def step(held, rows):
        last, out = (held or {}).get("px"), []
        for blk, px, ref in zip(rows["blk"], rows["px"], rows[is_ref], strict=True):
            if ref:
                last = px
            else:
                out.append((blk, last))
        return {"px": last}, pd.DataFrame({"blk": [b for b, _ in out], "ref_px": np.array([p for _, p in out], dtype=float)})
    return in_event_time(df, key, "blk long, ref_px double", step, ("px", is_ref), delay=None)


def late_audit(df: DataFrame, cut: int, ts: str = "ts") -> DataFrame:
    """STR-10: per trigger its rows, those at or past ``cut``, those behind the largest time of all triggers before, the largest lateness (how far behind), and
    the running maximum itself.

    Each trigger is one aggregate over its rows; the running maximum is the only thing that goes from one to the next,
    kept by the driver (one number). A trigger without rows writes nothing; one that is run again overwrites its own row.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    schema = "trigger long, rows long, past_cut long, behind long, lateness long, max_ts long"
    top: dict = {}

    def audit(batch: DataFrame, number: int) -> None:
        before = top.get("ts")
        t = F.col("ts")
        late = F.lit(before).cast("long") - t
        r = batch.agg(F.count("*").alias("rows"), F.count_if(t >= cut).alias("past_cut"), F.count_if(late > 0).alias("behind"),
                      F.greatest(F.max(late), F.lit(0)).alias("lateness"), F.greatest(F.max(t), F.lit(before).cast("long")).alias("max_ts"))
        row = r.first()  # one row a trigger
        if row["rows"]:
            top["ts"] = row["max_ts"]
            spark.createDataFrame([(number, *row)], schema).coalesce(1).write.mode("overwrite").parquet(f"{base}/out/trigger={number}")

    q = (df.select(F.col(ts).cast("long").alias("ts")).writeStream.foreachBatch(audit)
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
