"""Ordered folds over a key's events that SQL windows cannot state: each decision depends on the earlier decisions.

Rows are partitioned by key and sorted in the partition; the fold streams over them with a small state for one key, so a
hot key costs its task time but no memory."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame, key: str, order: list[str], outputs: dict[str, str], start: Callable[[], dict], step: Callable[[dict, dict], tuple]) -> DataFrame:
    """events with the outputs (name: type) that step(state, row) gives; start() makes a key's first state."""
    rows = events.repartition(key).sortWithinPartitions(key, *order)
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{n} {t}" for n, t in outputs.items())])
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        current, state = object(), None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row[key] != current:
                    current, state = row[key], start()
                found.append(step(state, row))
            cols = list(zip(*found, strict=True)) if found else [[] for _ in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, arrow[t]) for c, t in zip(cols, outputs.values(), strict=True))], names=[*batch.schema.names, *outputs])

    return rows.mapInArrow(run, types)


def first_hit(second: str, seconds: int, limit: int) -> tuple[dict, Callable, Callable]:
    """(outputs, start, step) of a counter whose window begins with its first hit: count, allowed, retry_after (seconds; 0 if
    allowed)."""
    def step(s: dict, row: dict):
        t = row[second]
        if t >= s["end"]:
            s["end"], s["n"] = t + seconds, 0
        s["n"] += 1
        ok = s["n"] <= limit
        return s["n"], ok, 0 if ok else s["end"] - t

    return {"window_count": "long", "allowed": "boolean", "retry_after": "long"}, lambda: {"end": -(1 << 62), "n": 0}, step


def first_hit_window(events: DataFrame, key: str, second: str, seconds: int, limit: int) -> DataFrame:
    return fold(events, key, [second, "event_id"], *first_hit(second, seconds, limit))


def sessions(second: str, idle: int, absolute: int) -> tuple[dict, Callable, Callable]:
    """(outputs, start, step) of the session number of each event: a session ends after an idle gap, and at its absolute age
    however busy it is."""
    def step(s: dict, row: dict):
        t = row[second]
        if s["begin"] is None or t - s["last"] >= idle or t - s["begin"] >= absolute:
            s["begin"], s["n"] = t, s["n"] + 1
        s["last"] = t
        return (s["n"],)

    return {"session": "long"}, lambda: {"begin": None, "last": 0, "n": 0}, step


def capped_sessions(events: DataFrame, key: str, second: str, idle: int, absolute: int) -> DataFrame:
    return fold(events, key, [second, "event_id"], *sessions(second, idle, absolute))


def quota(second: str, op: str, request: str, budget: int, keep: int = 86_400) -> tuple[dict, Callable, Callable]:
    """(outputs, start, step) of reserve, finish and release against a daily budget. A request id seen within ``keep`` seconds gives its old answer
    again and uses nothing; release returns what a reservation took, finish keeps it. result: granted, refused, repeated,
    released, finished or unknown; remaining: of the day's budget."""
    def step(s: dict, row: dict):
        t, what, rid = row[second], row[op], row[request]
        if t // 86_400 != s["day"]:
            s["day"], s["used"] = t // 86_400, 0
        while s["old"] and s["old"][0][0] <= t - keep:  # receipts in the order of their times; only those that are due are looked at
            at, old = s["old"].popleft()
            if s["seen"].get(old, (None,))[0] == at:
                del s["seen"][old]
        if what == "reserve":
            if rid in s["seen"]:
                result = "repeated"
            elif s["used"] >= budget:
                result = "refused"
            else:
                s["used"] += 1
                s["seen"][rid] = (t, "reserved")
                s["old"].append((t, rid))
                result = "granted"
        elif s["seen"].get(rid, (0, ""))[1] == "reserved":
            s["seen"][rid] = (t, what)
            s["old"].append((t, rid))
            result = "finished" if what == "finish" else "released"
            s["used"] -= what == "release"
        else:
            result = "unknown"
        return result, budget - s["used"]

    return {"result": "string", "remaining": "long"}, lambda: {"day": None, "used": 0, "seen": {}, "old": deque()}, step


def quota_receipts(requests: DataFrame, key: str, second: str, op: str, request: str, budget: int, keep: int = 86_400) -> DataFrame:
    return fold(requests, key, [second, "event_id"], *quota(second, op, request, budget, keep))


def versioned_updates(changes: DataFrame, key: str, expected: str) -> DataFrame:
    """Optimistic updates: a change applies if it names the current version, which then rises by one."""
    def step(s: dict, row: dict):
        ok = row[expected] == s["v"]
        s["v"] += ok
        return ok, s["v"]

    return fold(changes, key, ["event_id"], {"applied": "boolean", "version": "long"}, lambda: {"v": 0}, step)


def idempotent_create(requests: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """First record of each key; how many requests repeated it and how many conflict with it."""
    first = requests.groupBy(key).agg(F.min_by(digest, order).alias("_first"))
    return requests.join(first, key).groupBy(key).agg(
        F.first("_first").alias("digest"), (F.count_if(F.col(digest) == F.col("_first")) - 1).alias("repeats"), F.count_if(F.col(digest) != F.col("_first")).alias("conflicts")
    )
