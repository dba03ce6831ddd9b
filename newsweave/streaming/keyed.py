"""Jobs that keep state per key in the state store, with event-time timers.

A batch reads its own rows and the state of their keys, nothing that earlier batches wrote. Rows may
come late by ``lateness``: what is younger than the watermark stays in the state one by one, so that a
late row takes its place in time; what is older is kept as totals. Rows later than that are dropped by
the watermark. A key's rows of one batch pass through one task, so the trigger bounds them.

A call into Python and the frames around it cost far more than a key's work, so keys share their calls:
they are dealt into ``BUCKETS`` by hash, a bucket is one entry of the state store, and its keys keep their
own state and timers in it. Calls and frames then no longer grow with the keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsweave import params as P
from newsweave.operators import lifecycle as L

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
# What numpy takes for a missing time.
NO_TIME = np.iinfo("int64").min


# Entries of the state store; a stream keeps the number it was started with in its state.
BUCKETS = 1024
# The keys of a bucket as JSON: [key, state or null, timer in milliseconds or null].
BUCKET_STATE = "bucket_keys STRING"


class KeyState:
    """One key's state and timer within its bucket, used as a group's state is."""

    def __init__(self, value, watermark_ms: int, timed_out: bool = False):
        self.value, self.timer, self.watermark_ms, self.hasTimedOut = value, None, watermark_ms, timed_out

    @property
    def exists(self) -> bool:
        return self.value is not None

    @property
    def get(self) -> tuple:
        return tuple(self.value)

    def update(self, value: tuple) -> None:
        self.value = value

    def remove(self) -> None:
        self.value = self.timer = None

    def getCurrentWatermarkMs(self) -> int:
        return self.watermark_ms

    def setTimeoutTimestamp(self, ms: int) -> None:
        self.timer = ms


def _keyed(rows: DataFrame, key: str, names: list[str], run, output: str, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows(key, ts, ...) through ``run(key, rows, state)``, which yields rows of ``output``.

    A key's rows are tuples of ``names`` in order of the first two; ``us`` is their time in microseconds.
    Other whole numbers than ``us`` travel as text, so that a missing one doesn't make the others inexact.
    """
    types = dict(rows.dtypes)
    whole = [n for n in [key, *names] if types.get(n) in ("bigint", "int")]
    fields = [field.split() for field in output.split(", ")]

    def column(values: list, kind: str):
        if kind == "TIMESTAMP":
            return np.array([NO_TIME if v is None else v for v in values], dtype="int64").view("datetime64[us]")
        return pd.array(values, dtype="Int64") if kind == "BIGINT" else values

    def call(_, frames, state):
        watermark = state.getCurrentWatermarkMs()
        kept = {k: (v, t) for k, v, t in json.loads(state.get[0])} if state.exists else {}
        came: dict = {}
        if not state.hasTimedOut:
            for k, row in _columns(frames, key, names, whole):
                came.setdefault(k, []).append(row)
        # Keys without rows whose time is over.
        over = [k for k, (_, timer) in kept.items() if timer is not None and timer < watermark and k not in came]
        found = []
        for k in [*came, *over]:
            own = KeyState(kept.pop(k, (None,))[0], watermark, k not in came)
            found += run((int(k) if key in whole and k is not None else k,), sorted(came.get(k, ()), key=lambda r: r[:2]), own)
            if own.exists:
                kept[k] = (own.value, own.timer)
        if kept:
            state.update((json.dumps([(k, *v) for k, v in kept.items()]),))
            timers = [timer for _, timer in kept.values() if timer is not None]
            if timers:
                state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({name: column([r[i] for r in found], kind) for i, (name, kind) in enumerate(fields)})

    return (
        rows.withColumn("us", F.unix_micros("ts"))
        .withWatermark("ts", lateness)
        .withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        .select("bucket", "ts", *[F.col(n).cast("string" if n in whole else {**types, "us": "bigint"}[n]) for n in [key, *names]])
        .groupBy("bucket")
        .applyInPandasWithState(call, output, BUCKET_STATE, "update", "EventTimeTimeout")
    )


def _columns(frames: Iterator[pd.DataFrame], key: str, names: list[str], whole: list[str]) -> Iterator[tuple]:
    """(key, row) of a bucket's rows of this batch, without the wide frame around them."""
    for frame in frames:
        keys = [None if k is None or k != k else k for k in frame[key].tolist()]
        values = [
            [None if v is None or v != v else int(v) for v in frame[n].tolist()] if n in whole else frame[n].tolist() for n in names
        ]
        yield from zip(keys, zip(*values))


def _set_timer(state, us: int) -> bool:
    """Wake the key at a time; false if the watermark has passed it."""
    ms = -(-us // 1000)
    if ms <= state.getCurrentWatermarkMs():
        return False
    state.setTimeoutTimestamp(ms)
    return True


# --- circuit breaker ------------------------------------------------------------------------

BREAKER = "source_id BIGINT, failures BIGINT, last_failure_at TIMESTAMP, disabled_until TIMESTAMP, enabled BOOLEAN"
# A key's state: time and id of the last success, failures that are totals, last failure, times and ids of the others.


def breaker_runs(attempts: DataFrame, breaker: P.BreakerParams = P.BreakerParams(), lateness: str = "2 hours") -> DataFrame:
    """Attempts(source_id, event_id, ok, ts) to each touched source's run of failures.

    Only failures after the last success count, whichever of them arrives first. At the limit the source
    is off until ``disable_hours`` after its last failure; a timer then gives it out as enabled again,
    with its run as it was: one more failure switches it off anew.
    """
    off, most = breaker.disable_hours * HOUR_US, breaker.max_failures

    def run(key, rows, state):
        if state.hasTimedOut:
            ok_us, ok_id, old, last, times, ids = state.get
            state.update((ok_us, ok_id, old, last, times, ids))
            yield key[0], old + len(times), last, last + off, True
            return
        ok, old, last, failed = (-1, -1), 0, None, []
        if state.exists:
            ok_us, ok_id, old, last, times, ids = state.get
            ok, failed = (ok_us, ok_id), list(zip(times, ids))
        for us, event, fine in rows:
            if not fine:
                failed.append((us, event))
            elif (us, event) > ok:
                # Whatever the totals hold is older than the watermark and so than this success.
                ok, old = (us, event), 0
        failed = sorted(f for f in failed if f > ok)
        settled = state.getCurrentWatermarkMs() * 1000
        kept = [f for f in failed if f[0] >= settled]
        count = old + len(failed)
        last = None if not count else max([last or 0, *(us for us, _ in failed)]) if old else failed[-1][0]
        state.update((*ok, old + len(failed) - len(kept), last, [us for us, _ in kept], [i for _, i in kept]))
        until = last + off if count >= most else None
        waits = until is not None and _set_timer(state, until)
        yield key[0], count, last, until, not waits

    rows = attempts.select("source_id", "event_id", "ok", "ts")
    return _keyed(rows, "source_id", ["us", "event_id", "ok"], run, BREAKER, lateness)


# --- change tracking ------------------------------------------------------------------------

CHANGES = (
    "url STRING, n_fetches BIGINT, n_unchanged BIGINT, last_changed_at TIMESTAMP, last_etag BIGINT, "
    "last_seen_at TIMESTAMP, idle BOOLEAN"
)
# A key's state: the totals of ``_walk``; times, ids and versions of the younger fetches.


def change_states(fetches: DataFrame, idle_days: int = 90, lateness: str = "2 hours") -> DataFrame:
    """Fetches(url, event_id, etag, ts) to each touched address's version and when it last changed.

    An address that isn't fetched for ``idle_days`` is given out as idle by a timer and forgotten.
    """
    idle = idle_days * DAY_US

    def run(key, rows, state):
        if state.hasTimedOut:
            n, same, changed, etag, seen, *recent = state.get
            totals = _walk((n, same, changed, etag, seen), list(zip(*recent)))
            state.remove()
            yield _change_row(key[0], totals, True)
            return
        totals, recent = (0, 0, None, None, None), []
        if state.exists:
            *totals, times, ids, etags = state.get
            totals, recent = tuple(totals), list(zip(times, ids, etags))
        recent = sorted([*recent, *rows], key=lambda r: r[:2])
        settled = state.getCurrentWatermarkMs() * 1000
        cut = next((at for at, r in enumerate(recent) if r[0] >= settled), len(recent))
        totals, kept = _walk(totals, recent[:cut]), recent[cut:]
        state.update((*totals, *([r[i] for r in kept] for i in range(3))))
        now = _walk(totals, kept)
        _set_timer(state, now[4] + idle)
        yield _change_row(key[0], now, False)

    rows = fetches.select("url", "event_id", "etag", "ts")
    return _keyed(rows, "url", ["us", "event_id", "etag"], run, CHANGES, lateness)


def _walk(totals: tuple, rows: list[tuple]) -> tuple:
    """Fetches, unchanged ones, last change, last version and last time after some more fetches in order."""
    n, same, changed, etag, seen = totals
    for us, _, now in rows:
        if etag is not None and now == etag:
            same += 1
        elif etag is None or now is not None:
            changed = us
        n, etag, seen = n + 1, now, us
    return n, same, changed, etag, seen


def _change_row(url, totals, idle) -> tuple:
    n, same, changed, etag, seen = totals
    return url, n, same, changed, etag, seen, idle


# --- reviews ----------------------------------------------------------------------------------

REVIEWS = "article_id STRING, status STRING, sent_at TIMESTAMP, decided_at TIMESTAMP"
# A key's state: when it was sent; times, ids and decisions that wait for that; status.


def review_events(queue: DataFrame, presses: DataFrame, chat_id: str) -> DataFrame:
    """Queue(article_id, sent_at) and button presses as one log: article_id, event_id, decision, ts; sent rows have no decision."""
    sent = queue.select(
        F.col("article_id").cast("string").alias("article_id"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(None).cast("string").alias("decision"), F.col("sent_at").alias("ts"),
    )
    return sent.unionByName(L.parse_decisions(presses, chat_id).select("article_id", "event_id", "decision", "ts"))


def review_states(log: DataFrame, hours: int = P.REVIEW_TIMEOUT_HOURS, lateness: str = "0 seconds") -> DataFrame:
    """A review log to the state of every touched review: pending, approved, rejected or expired.

    The first decision between sending and the deadline counts and is never replaced; a timer at the
    deadline expires a review without one. Decisions that come before their review was sent wait for it
    until the deadline that they could meet has passed.
    """
    limit = hours * HOUR_US

    def run(key, rows, state):
        sent, held, status = None, [], None
        if state.exists:
            sent, times, ids, decisions, status = state.get
            held = list(zip(times, ids, decisions))
        if state.hasTimedOut:
            state.remove()
            if sent is not None and status == "pending":
                yield key[0], "expired", sent, None
            return
        for us, event, decision in rows:
            if decision is None or decision != decision:
                sent = us if sent is None else sent
            else:
                held.append((us, event, decision))
        if sent is None:
            state.update((None, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], None))
            if not _set_timer(state, max(h[0] for h in held) + limit):
                state.remove()
            return
        first = min((h for h in held if sent <= h[0] < sent + limit), default=None)
        before = status
        if status not in ("approved", "rejected"):
            status = first[2] if first else "pending"
        # A decided review is held until its deadline so that later presses meet a decision.
        state.update((sent, [], [], [], status))
        if not _set_timer(state, sent + limit):
            status = "expired" if status == "pending" else status
            state.remove()
        if status != before:
            yield key[0], status, sent, first[0] if first else None

    rows = log.select("article_id", "event_id", "decision", "ts")
    return _keyed(rows, "article_id", ["us", "event_id", "decision"], run, REVIEWS, lateness)
