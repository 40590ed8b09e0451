"""Keyed state in batch: histories, limits, quotas, sessions and event-sourced records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: counts are read as at most this.
COUNT_CAP = 1_000_000


def history(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """First and last time and capped count of each key; combined before the shuffle."""
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.least(F.count(F.lit(1)), F.lit(COUNT_CAP)).alias("seen_count"))


def sliding_hits(events: DataFrame, key: str, seconds: int, capacity: int, ts: str = "ts") -> DataFrame:
    """Hits of the key in the trailing window, the row's own included, and whether it is within capacity."""
    window = Window.partitionBy(key).orderBy(F.col(ts).cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(window)).withColumn("allowed", F.col("hits") <= capacity)


def exact_limit(events: DataFrame, key: str, seconds: int, capacity: int, ts: str = "ts") -> DataFrame:
    """Like sliding_hits, but refused hits are not recorded, so each decision depends on the earlier ones: a fold over the
    key's rows in order that holds at most ``capacity`` times."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, event_id long, allowed boolean"

    def fold(batches):
        import pyarrow as pa

        current, kept = None, []
        for batch in batches:
            keys, times, ids = (batch.column(i).to_pylist() for i in range(3))
            allowed = []
            for k, t in zip(keys, times, strict=True):
                if k != current:
                    current, kept = k, []
                kept = [x for x in kept if x > t - seconds]
                allowed.append(len(kept) < capacity)
                if allowed[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(allowed, pa.bool_())], names=[key, "event_id", "allowed"])

    rows = events.select(key, F.col(ts).cast("long").alias("t"), "event_id").repartition(key).sortWithinPartitions(key, "t", "event_id")
    return rows.mapInArrow(fold, schema)


def daily_quota(events: DataFrame, key: str, budget: int, ts: str = "ts") -> DataFrame:
    """Use, refusals and what remains of each key's budget on each day."""
    per = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    used = F.least(F.col("requests"), F.lit(budget).cast("long"))
    return per.select(key, "day", "requests", used.alias("used"), (F.col("requests") - used).alias("refused"), (F.lit(budget) - used).alias("remaining"))


def idle_sessions(events: DataFrame, key: str, idle_seconds: int, ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap of idle_seconds: key, session number, start, end, events."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    fresh = F.coalesce((F.col(ts).cast("double") - F.lag(ts).over(order).cast("double")) >= idle_seconds, F.lit(True))
    rows = events.withColumn("_fresh", fresh.cast("int")).withColumn("session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events"))


def latest_fields(events: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """For each key the latest value of each field that is not null: one aggregation, no sort."""
    place = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, F.when(c.isNotNull(), place)).alias(name) for name, c in fields.items()])


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of at most 100 rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(max(1, min(100, limit)))
