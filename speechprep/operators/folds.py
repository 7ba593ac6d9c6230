"""Ordered folds over the rows of a key, for states that depend on earlier decisions.

One step function serves the batch form here and the stream's keyed processor.  In batch, rows are
shuffled and sorted by key and order, and stream through a task with the state of the current key
only, so a key of any length needs no memory of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """``df`` with the columns ``added``: ``step(state, row) -> (state, values of them)`` along each key's rows in ``order``."""
    more = T._parse_datatype_string(added)
    names = [f.name for f in more]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, None, True
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if first or not (k == now or (pd.isna(k) and pd.isna(now))):
                    now, state, first = k, start(), False
                state, values = step(state, row)
                out.append(values)
            yield pdf.assign(**{c: [v[i] for v in out] for i, c in enumerate(names)})

    schema = T.StructType([*df.schema.fields, *more.fields])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def limited(kept: deque, t: float, limit: int, window_s: float) -> bool:
    """Whether a request at ``t`` is accepted; ``kept`` holds the accepted ones of the window, in order."""
    while kept and kept[0] <= t - window_s:
        kept.popleft()
    if len(kept) < limit:
        kept.append(t)
        return True
    return False


def moved(now: str | None, status: str) -> tuple[str | None, bool]:
    """The job's state after ``status``, and whether it applies: no pause of an ended job, no resumption of one that isn't paused; deleted is final."""
    ok = now != "deleted" and not (status == "paused" and now in ("completed", "failed")) and not (status == "resumed" and now != "paused")
    return ("processing" if status == "resumed" else status) if ok else now, ok


#: Of a breaker: name, failures in a row, and when it opened.
CLOSED = ("closed", 0, 0.0)


def called(state: tuple[str, int, float], t: float, ok: bool, k: int, recovery_s: float) -> tuple[tuple[str, int, float], bool]:
    """The breaker after a call at ``t``, and whether the call was allowed."""
    name, failures, at = state
    if name == "open" and t - at >= recovery_s:
        name = "half_open"
    if name == "open":
        return (name, failures, at), False
    if ok:
        return CLOSED, True
    failures += 1
    return (("open", failures, t) if name == "half_open" or failures >= k else (name, failures, at)), True


def rate_limited(log: DataFrame, limit: int = 60, window_s: int = 60) -> DataFrame:
    """Sliding-log limiter: ``log(key, ts)`` -> each request with ``accepted``; only accepted ones count."""
    return folded(log.select("key", "ts"), "key", ["ts"], deque, lambda kept, r: (kept, (limited(kept, r.ts.timestamp(), limit, window_s),)), "accepted boolean")


def job_states(events: DataFrame) -> DataFrame:
    """``events(job_id, ts, status)`` -> each with the job's ``state`` after it and whether it was ``applied``."""

    def step(now, r):
        now, ok = moved(now, r.status)
        return now, (now, ok)

    return folded(events, "job_id", ["ts"], lambda: None, step, "state string, applied boolean")


def breaker_states(calls: DataFrame, k: int = 3, recovery_s: float = 60.0) -> DataFrame:
    """``calls(endpoint, ts, ok)`` -> each with ``allowed`` and the ``state`` after it."""

    def step(state, r):
        state, allowed = called(state, r.ts.timestamp(), bool(r.ok), k, recovery_s)
        return state, (allowed, state[0])

    return folded(calls, "endpoint", ["ts"], lambda: CLOSED, step, "allowed boolean, state string")
