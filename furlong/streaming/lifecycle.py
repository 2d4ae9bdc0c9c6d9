"""Lifecycle of each race as a keyed state machine driven by event-time timers.

Events wait in the state of their race's bucket until the watermark has passed them, so they are applied in
event time whatever files or batches bring them. Every mark before and after the start is a timer
of its own: when the watermark jumps over several, each is taken at its own time. A race is closed by
its result and keeps that flag until it expires, a fixed time after its start, when all it held goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furlong.plans.lifecycle import CAPTURE, EMERGENCY, POST_START, PRE_WINDOW

OUTPUT = "race_id string, state string, at timestamp"
#: The open races of a bucket as JSON, each a list: race_id, start in ms, supported, final, result, last
#: state, clock, waiting (events not yet reached by the watermark, as "time:kind" joined by commas).
STATE = "races string"
COLUMNS = ["race_id", "start_ms", "supported", "at_ms", "kind"]
#: Races share state by a hash, so Python is called once a bucket and batch, not once a race.
BUCKETS = 512
#: Seconds after the start at which a race is forgotten; later events are not of it.
EXPIRY = 86_400
# Seconds before (positive) or after the start at which the state may change by time alone.
MARKS = [PRE_WINDOW, CAPTURE, EMERGENCY, 0, -POST_START]


def classify(now_ms: int, start_ms: int, final: bool, result: bool, supported: bool = True) -> str:
    ahead = (start_ms - now_ms) / 1000.0
    if not supported:
        return "SOURCE_UNSUPPORTED"
    if result:
        return "RESULT_CAPTURED"
    if final:
        return "FINAL_CAPTURED" if ahead > 0 else "RESULT_PENDING"
    if ahead <= -POST_START:
        return "FAILED"
    if ahead <= 0:
        return "POST_START_RETRY"
    if ahead <= EMERGENCY:
        return "FINAL_CAPTURING"
    if ahead <= CAPTURE:
        return "CAPTURING"
    if ahead <= PRE_WINDOW:
        return "PRE_WINDOW"
    return "WAITING"


def advance(state: tuple, events: list[tuple[int, str]], until_ms: int) -> tuple[tuple, list[tuple[int, str]]]:
    """A race's state after all events and timers up to ``until_ms``, and its changes (time, state).

    The race begins with its first event; timers before it do not count."""
    start, supported, final, result, last, clock, waiting = state
    held = sorted([*events, *((int(t), k) for t, k in (x.split(":") for x in waiting.split(",") if x))])
    ripe = [(t, k) for t, k in held if t <= until_ms]
    begun = clock is not None or bool(ripe)
    if begun:
        first = clock if clock is not None else ripe[0][0]
        timers = [start - m * 1000 for m in MARKS]
        instants = sorted({t for t, _ in ripe} | {t for t in timers if first < t <= until_ms})
    else:
        instants = []
    out, i = [], 0
    for now in instants:
        while i < len(ripe) and ripe[i][0] <= now:
            at, kind = ripe[i]
            final = final or (kind == "prediction" and start - CAPTURE * 1000 <= at < start)
            result = result or kind == "result"
            i += 1
        current = classify(now, start, final, result, supported)
        if current != last:
            out.append((now, current))
            last = current
    clock = until_ms if begun else None
    left = ",".join(f"{t}:{k}" for t, k in held if t > until_ms)
    return (start, supported, final, result, last, clock, left), out


def next_timer(state: tuple, now_ms: int) -> int:
    """The next instant at which the race may change or expire."""
    start, *_, waiting = state
    times = [start - m * 1000 for m in MARKS] + [start + EXPIRY * 1000] + [int(x.split(":")[0]) for x in waiting.split(",") if x]
    return min(t for t in [*times, start + EXPIRY * 1000] if t > now_ms)


def _step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All races of a bucket: those with events and those held."""
    now = max(state.getCurrentWatermarkMs(), 0)
    held = {race: tuple(rest) for race, *rest in json.loads(state.get[0])} if state.exists else {}
    events: dict[str | None, list[tuple[int, str]]] = {}
    if not state.hasTimedOut:
        for batch in batches:
            for race, start, supported, at, kind in zip(*(batch[c].tolist() for c in COLUMNS), strict=True):
                race = race if isinstance(race, str) else None
                if race not in held:
                    held[race] = (start, supported, False, False, None, None, "")
                events.setdefault(race, []).append((at, kind))
    out, left, timers = [], [], []
    for race, before in held.items():
        after, changes = advance(before, events.get(race, []), now)
        out += [(str(race), s, t) for t, s in changes]
        if now < after[0] + EXPIRY * 1000:
            left.append((race, *after))
            timers.append(next_timer(after, now))
    if left:
        state.update((json.dumps(left, separators=(",", ":")),))
        state.setTimeoutTimestamp(min(timers))
    else:
        state.remove()
    races, states, times = zip(*out, strict=True) if out else ((), (), ())
    yield pd.DataFrame({"race_id": list(races), "state": list(states), "at": pd.to_datetime(list(times), unit="ms")})


def transitions(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """State changes per race from events (race_id, race_start_at, kind, at[, supported]).

    ``kind`` is seen, prediction or result; without ``supported`` every race is. Changes come once
    the watermark, ``delay`` behind the newest event, has passed them. Events after a race's expiry
    are dropped. State holds open races and those of the last day."""
    supported = F.col("supported") if "supported" in events.columns else F.lit(True)
    start = F.unix_millis("race_start_at")
    race = F.col("race_id").cast("string")
    keyed = events.filter(F.unix_millis("at") < start + EXPIRY * 1000).select(
        F.pmod(F.xxhash64(race), F.lit(BUCKETS)).alias("bucket"), race.alias("race_id"), start.alias("start_ms"), F.coalesce(supported, F.lit(False)).alias("supported"),
        "kind", "at", F.unix_millis("at").alias("at_ms"),
    ).withWatermark("at", delay)
    return keyed.groupBy("bucket").applyInPandasWithState(
        _step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
