"""Structured Streaming forms of the job operators: event time, watermarks and keyed state.

Rows later than the watermark are dropped (Spark counts them in the query's progress); keyed
processors hold the others back until the watermark has passed them and take them by event time, so their
results don't hang on batches.  Their steps are those of ``operators.folds``.  State goes when a key has been idle.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from speechprep.functions.text import embed_player, normalize, post_of_job, segment, word_count
from speechprep.operators.checks import publishable
from speechprep.operators.folds import CLOSED, called, limited, moved
from speechprep.operators.jobs import TERMINAL
from speechprep.sources import posts
from speechprep.sources.tables import extract_post


def stream_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Webhook payloads, one JSON text per line, as publishable posts."""
    raw = spark.readStream.schema("value string").text(folder).withColumnRenamed("value", "raw")
    return publishable(extract_post(raw)).filter("post_id is not null and skip_reason is null")


def first_submissions(df: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The first submission of a job within its TTL."""
    return df.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["job_id"])


def metrics(df: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Counters and a duration histogram per window."""
    n = {k: F.count_if(F.col("status") == s).alias(k) for k, s in (("created", "queued"), ("completed", "completed"), ("failed", "failed"))}
    buckets = [F.count_if(F.col("duration_s") <= e).alias(f"le_{e}") for e in (1, 5, 10, 30, 60)]
    return df.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(*n.values(), *buckets, F.count("duration_s").alias("n")).select("window.start", *n, *[f"le_{e}" for e in (1, 5, 10, 30, 60)], "n")


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their event times, whatever the batches that they came in.

    New rows wait in a list state until the watermark has passed them; a timer on the earliest of them then drains
    all that it has passed, sorted by time (rows of one time by their other values), through ``step(state, row) -> (state, output)``.
    No row can come before a drained one any more: Spark drops it and counts it in the query's progress
    (``numRowsDroppedByWatermark``).  The state goes ``idle_s`` after the last row, in event time.
    """

    def __init__(self, key: str, columns: list[str], start: Callable, step: Callable, output: list[str], idle_s: float | None, load: Callable = lambda x: x, dump: Callable = lambda x: x):
        self.key, self.columns, self.start, self.step, self.output, self.idle_s, self.load, self.dump = key, columns, start, step, output, idle_s, load, dump

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("us", LongType()), StructField("row", StringType())]))
        #: The state as JSON, the time of the last drained row and the timer set (milliseconds; 0 for none).
        self.now = handle.getValueState("now", StructType([StructField("state", StringType()), StructField("us", LongType()), StructField("timer", LongType())]))

    def _state(self) -> tuple:
        if not self.now.exists():
            return self.start(), 0, 0
        state, us, timer = self.now.get()
        return self.load(json.loads(state)), us, timer

    def _kept(self, state, us: int, timer: int, wanted: int) -> None:
        """Store the state and see that the one timer is the ``wanted`` one."""
        if timer != wanted:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        self.now.update((json.dumps(self.dump(state)), us, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), json.dumps(values)) for t, values in zip(us, pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None).values.tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            state, us, timer = self._state()
            # a waiting row's timer is at or before the watermark's next steps; an idle one gives way to it
            first = min(t for t, _ in new) // 1000 + 1
            self._kept(state, us, timer, min(timer, first) if timer else first)
        yield self.told(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((t, row) for t, row in self.waiting.get())
        due = [x for x in rows if x[0] <= passed * 1000]
        rest = rows[len(due) :]
        state, us, timer = self._state()
        out = []
        for us, row in due:
            values = dict(zip(self.columns, json.loads(row), strict=True))
            state, more = self.step(state, us / 1e6, values)
            out += [(us, *values.values(), *x) for x in more]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        state, more = self.until(state, min(passed * 1000, rest[0][0] if rest else passed * 1000) / 1e6)
        out += [(us, *[None] * len(self.columns), *x) for x in more]
        wanted = self.wake(state, us)
        if rest:
            wanted = min(wanted or rest[0][0] // 1000 + 1, rest[0][0] // 1000 + 1)
        if wanted is None or not rest and 0 < wanted <= passed:
            if timer > passed:
                self.handle.deleteTimer(timer)
            self.now.clear()
        else:
            self._kept(state, us, timer if timer > passed else 0, wanted)
        yield self.told(key, out)

    def until(self, state, t: float) -> tuple:
        """What time alone brings about up to ``t``, all rows before it being worked."""
        return state, []

    def wake(self, state, us: int) -> int | None:
        """When to look again if nothing comes, in milliseconds; 0 if never, None if there is nothing to keep."""
        if state == self.start():
            return None
        return 0 if self.idle_s is None else int(us / 1000 + self.idle_s * 1000) + 1

    def told(self, key, out: list[tuple]) -> pd.DataFrame:
        names = [self.key, "ts", *self.columns, *self.output]
        pdf = pd.DataFrame([(key[0], *x) for x in out], columns=names)
        return pdf.assign(ts=pd.to_datetime(pdf["ts"], unit="us"))

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, key: str, columns: list[str], added: str, late: str, processor: StatefulProcessor) -> DataFrame:
    kinds = dict(df.dtypes)
    rows = df.select(key, "ts", *columns).withWatermark("ts", late)
    schema = ", ".join([f"{key} {kinds[key]}", "ts timestamp", *[f"{c} {kinds[c]}" for c in columns], added])
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_limit(df: DataFrame, limit: int = 60, window_s: int = 60, late: str = "1 minute") -> DataFrame:
    """``df(key, ts)`` -> each request with ``accepted``: one is refused if ``limit`` accepted ones lie in the window before it.  A key's log goes when its window has passed."""

    def step(kept: deque, t: float, _: dict) -> tuple:
        return kept, [(limited(kept, t, limit, window_s),)]

    return _in_order(df, "key", [], "accepted boolean", late, InOrder("key", [], deque, step, ["accepted"], window_s, deque, list))


def job_machine(df: DataFrame, ttl_s: int | None = 86_400, late: str = "1 minute") -> DataFrame:
    """``df(job_id, ts, status)`` -> each event with the job's ``state`` after it and whether it was ``applied``.  A state is forgotten ``ttl_s`` after its last event."""

    def step(now: str | None, t: float, row: dict) -> tuple:
        now, ok = moved(now, row["status"])
        return now, [(now, ok)]

    return _in_order(df, "job_id", ["status"], "state string, applied boolean", late, InOrder("job_id", ["status"], _nothing, step, ["state", "applied"], ttl_s))


def _nothing() -> None:
    return None


def breaker(df: DataFrame, k: int = 3, recovery_s: float = 60.0, idle_s: int | None = 86_400, late: str = "1 minute") -> DataFrame:
    """``df(endpoint, ts, ok)`` -> each call with ``allowed`` and the ``state`` after it; a closed breaker without failures keeps nothing, another one for ``idle_s``."""

    def step(state: tuple, t: float, row: dict) -> tuple:
        state, allowed = called(state, t, bool(row["ok"]), k, recovery_s)
        return state, [(allowed, state[0])]

    return _in_order(df, "endpoint", ["ok"], "allowed boolean, state string", late, InOrder("endpoint", ["ok"], _closed, step, ["allowed", "state"], idle_s, tuple, list))


def _closed() -> tuple:
    return CLOSED


def timeouts(submissions: DataFrame, statuses: DataFrame, first_s: int = 600, last_s: int = 1800) -> DataFrame:
    """Submissions without any status within ``first_s``, and those without an end within ``last_s`` (both, if neither came): outer joins with a time bound, in batch or stream."""
    left = submissions.select("job_id", F.col("ts").alias("submitted")).withWatermark("submitted", "1 minute")

    def missed(rows: DataFrame, limit_s: int, reason: str) -> DataFrame:
        right = rows.select(F.col("job_id").alias("sid"), F.col("ts").alias("at")).withWatermark("at", "1 minute")
        bound = (F.col("job_id") == F.col("sid")) & (F.col("at") >= F.col("submitted")) & (F.col("at") <= F.col("submitted") + F.expr(f"interval {limit_s} seconds"))
        return left.join(right, bound, "leftOuter").filter("sid is null").select("job_id", "submitted", F.lit(reason).alias("reason"))

    return missed(statuses, first_s, "no status").unionByName(missed(statuses.filter(F.col("status").isin(*TERMINAL)), last_s, "not finished"))


class Overdue(InOrder):
    """Rows in order, and a timer on each state that has a limit; the job's next event cancels it."""

    def __init__(self, limits: dict[str, int]):
        super().__init__("job_id", ["status"], _nothing, self.changed, ["overdue", "since"], None, lambda x: x and tuple(x))
        self.limits = limits

    def changed(self, state: tuple | None, t: float, row: dict) -> tuple:
        """A state is (status, since, told); it is told once, here if its limit passed before this row."""
        _, out = self.until(state, t)
        return (row["status"], t, False), [(state[0], pd.Timestamp(state[1], unit="s").round("us")) for _ in out]

    def until(self, state: tuple | None, t: float) -> tuple:
        if state and not state[2] and state[0] in self.limits and state[1] + self.limits[state[0]] < t:
            return (*state[:2], True), [(state[0], pd.Timestamp(state[1], unit="s").round("us"))]
        return state, []

    def wake(self, state: tuple | None, us: int) -> int | None:
        return int((state[1] + self.limits[state[0]]) * 1000) + 1 if state and not state[2] and state[0] in self.limits else None


#: Seconds that a job may run or stand paused.
LIMITS = {"processing": 28_800, "paused": 3600}


def overdue(df: DataFrame, limits: dict[str, int] = LIMITS, late: str = "1 minute") -> DataFrame:
    """``df(job_id, ts, status)`` -> (job_id, status, since) of states that outlast their limit."""
    found = _in_order(df, "job_id", ["status"], "overdue string, since timestamp", late, Overdue(limits))
    return found.select("job_id", F.col("overdue").alias("status"), "since")


def apply_callbacks(events: DataFrame, table: str, checkpoint: str, widget: str = '<div class="audio-player"><audio src="%s"></audio></div>'):
    """Completed callbacks put the player into their posts, a table of ``sources.posts``: a batch rewrites the parts that it touches and commits them with its epoch.

    A batch that comes again changes nothing, and other streams may write the same table.  At most ``PARTS`` numbers reach the driver.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = batch.filter("status = 'completed'").select(post_of_job(F.col("job_id")).alias("post_id"), F.format_string(widget, F.col("audio_uri")).alias("#w"), "ts")
        newest = done.filter("post_id is not null").groupBy("post_id").agg(F.max_by("#w", "ts").alias("#w"))
        touched = [r.part for r in newest.select(posts.part_of(F.col("post_id")).alias("part")).distinct().collect()]

        def embedded(old: DataFrame) -> DataFrame:
            new = old.join(newest.hint("merge"), "post_id", "left")
            return new.withColumn("html", F.when(F.col("#w").isNotNull(), embed_player(F.col("html"), F.col("#w"))).otherwise(F.col("html"))).drop("#w")

        if touched:
            posts.update(spark, table, embedded, touched, posts.stream_name(spark, checkpoint), epoch)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def stream_segments(df: DataFrame, target: int = 400) -> DataFrame:
    """New articles as numbered segments; no state."""
    return df.select("doc_id", F.posexplode(segment(normalize(F.col("text")), target)).alias("seg_idx", "text")).withColumn("word_count", word_count(F.col("text")))
