"""Limits, quotas and sessions as streams: the same steps as the ordered folds, with the state of each key kept by the engine
and forgotten after a time without events.

Within a micro-batch a key's rows are put in order; across batches the stream must bring them in order, as a log does. Time
is that of the events, so a replay gives what the stream gave; rows later than the watermark are left out."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(events: DataFrame, key: str, order: list[str], outputs: dict[str, str], start: Callable[[], dict], step: Callable[[dict, dict], tuple], ttl_seconds: int, *, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """events with the outputs (name: type) that step(state, row) gives; a key without events for ttl_seconds starts anew."""
    events = events.withWatermark(ts, late)
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), *(f"{n} {t}" for n, t in outputs.items())])
    names = list(outputs)

    def run(_, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        own = pickle.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        found = [step(own, row) for row in rows.to_dict("records")]
        for i, name in enumerate(names):
            rows[name] = [f[i] for f in found]
        state.update((pickle.dumps(own),))
        end = int(rows[ts].max().timestamp() * 1000) + 1000 * ttl_seconds
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield rows

    return events.groupBy(key).applyInPandasWithState(run, types, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def run_append(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Runs a stream in append mode over what there is now into a table in the folder, and reads that back."""
    where = f"{folder}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
