"""Held readings of a feed in order of event time, in whatever order rows arrive.

``run_held_in_order`` keeps the readings of a station and bucket of time as the state
of a windowed aggregate until the watermark has passed the bucket's end. Then the
trigger judges them with ``stream.held_readings``, which carries each station's last
two readings on. Nothing of it runs in Python, and state is what the delay and a
bucket hold.

``held_in_order`` gives the same rows as a stream, by keyed state and timers. Each row
passes twice through Python one by one, so it is for feeds of few rows. Its first step
keeps a station and bucket until a timer fires behind the watermark, then puts the
readings in order and judges them. The second sees, of each bucket, the first and last
two readings of a station and settles the first two by what the buckets before left.
All other rows pass through it in lanes, so no station's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantlens.sources import tables
from plantlens.streaming import stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READING = "event_id string, ts timestamp, v double"
JUDGED = "event_id string, station_id string, bucket long, n long, edge boolean, v double, held boolean"
HELD = "event_id string, station_id string, held boolean"
LANES = 64
#: Lists of readings that a station's bucket is kept in, each of an equal span of time.
SLICES = 96
#: Bucket of rows without ts. Keys that are numbers may not be null: beside a null, Arrow
#: hands the others of a batch to Python as floating-point numbers, which are other keys.
NO_TIME = -(1 << 40)


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The readings of one station and bucket by ts and event_id (nulls last), with their
    place n, whether they are among the first or last two (edge), and held, which the
    first two do not know yet."""
    rows = rows.sort_values(["ts", "event_id"], na_position="last", ignore_index=True)
    n = pd.Series(range(len(rows)), dtype="int64")
    same = (rows.v == rows.v.shift(1)) & (rows.v == rows.v.shift(2))  # NaN equals nothing
    return rows.assign(n=n, edge=(n < 2) | (n >= len(rows) - 2), held=same.astype(object).where(n >= 2, None))


def settle(edges: pd.DataFrame, last: tuple[float | None, float | None]) -> tuple[list[bool], tuple[float | None, float | None]]:
    """held of the edges of a station, which are in order of bucket and n, and the
    last two readings, as ``last`` holds those of the buckets before."""
    held, (one, two) = [], last
    for v, known in zip(edges.v.tolist(), edges.held.tolist()):
        held.append(v == one == two if known is None or pd.isna(known) else bool(known))
        one, two = v, one
    return held, (one, two)


class BucketsOfStations(StatefulProcessor):
    """Keyed by station and bucket. A bucket is judged once, when the watermark is past it."""

    def __init__(self, bucket_s: int):
        self.bucket_ms = bucket_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", READING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket = int(key[1])
        for part in rows:
            if bucket == NO_TIME:  # no place in time: never held
                yield self._named(key, part.assign(n=0, edge=False, held=False))
            else:
                self.readings.appendList(list(part[["event_id", "ts", "v"]].itertuples(index=False, name=None)))
        if bucket != NO_TIME:
            self.handle.registerTimer((bucket + 1) * self.bucket_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(list(self.readings.get()), columns=["event_id", "ts", "v"])
        self.readings.clear()
        yield self._named(key, in_order(rows.astype({"v": "float64"})))

    def _named(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(station_id=key[0], bucket=int(key[1]))[["event_id", "station_id", "bucket", "n", "edge", "v", "held"]]

    def close(self) -> None:
        pass


class EdgesOfStations(StatefulProcessor):
    """Keyed by station and lane. Lane 0 has the edges; a trigger brings all buckets that
    have ended, so the order within the trigger continues that of the triggers before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "one double, two double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] != 0:
            for part in rows:
                yield part[["event_id", "station_id", "held"]]
            return
        edges = pd.concat(list(rows)).sort_values(["bucket", "n"], ignore_index=True)
        held, last = settle(edges, self.last.get() if self.last.exists() else (None, None))
        self.last.update(last)
        yield edges.assign(held=held)[["event_id", "station_id", "held"]]

    def close(self) -> None:
        pass


def held_in_order(feed: DataFrame, delay: str = "1 day", bucket_s: int = 3600) -> DataFrame:
    """event_id, station_id and held: is it the third identical reading in a row of its
    station, by ts and event_id, in whatever order the rows arrive?

    A row is judged when the watermark (the greatest ts less ``delay``) is past the end of
    its bucket of ``bucket_s`` seconds; until then it is state. Rows behind the watermark
    are dropped, as the query's progress counts. Null readings and NaN are held by
    nothing and break a run; rows without ts are never held; rows without a station are a
    station of their own; repeated rows count each. To be run with RocksDB.
    """
    feed = feed.withWatermark("ts", delay).select("event_id", "station_id", "ts", F.col("feature_dim_mm").cast("double").alias("v"))
    keyed = feed.withColumn("bucket", F.coalesce(F.floor(F.unix_micros("ts") / F.lit(1_000_000 * bucket_s)), F.lit(NO_TIME)))
    judged = keyed.groupBy("station_id", "bucket").transformWithStateInPandas(BucketsOfStations(bucket_s), JUDGED, "append", "EventTime")
    lane = F.when(F.col("edge"), 0).otherwise(1 + F.pmod(F.xxhash64("event_id"), F.lit(LANES)))
    return judged.withColumn("lane", lane.cast("int")).groupBy("station_id", "lane").transformWithStateInPandas(EdgesOfStations(), HELD, "append", "None")


def released(feed: DataFrame, delay: str, bucket_s: int) -> DataFrame:
    """The readings of a feed when the watermark (the greatest ts less ``delay``) is past
    the end of their bucket of ``bucket_s`` seconds; until then they are state, in SLICES
    lists a station and bucket. Rows without ts come at once."""
    row = ["event_id", "station_id", "ts", F.col("feature_dim_mm").cast("double").alias("feature_dim_mm")]
    slice_us = F.lit(max(1, 1_000_000 * bucket_s // SLICES))
    known = feed.filter("ts is not null").select(*row).withWatermark("ts", delay)
    lists = known.groupBy("station_id", F.window("ts", f"{bucket_s} seconds"), F.floor(F.unix_micros("ts") / slice_us)).agg(F.collect_list(F.struct("event_id", "ts", "feature_dim_mm")).alias("rows"))
    ended = lists.select("station_id", F.explode("rows").alias("r")).select("r.event_id", "station_id", "r.ts", "r.feature_dim_mm")
    return ended.union(feed.filter("ts is null").select(*row))


def run_held_in_order(feed: DataFrame, path: str, delay: str = "1 day", bucket_s: int = 3600, name: str | None = None) -> DataFrame:
    """Runs a feed to its present end and reads all rows that it has judged so far: the rows
    of held_in_order, with the same meaning. What lies within the delay stays state for the
    next run. Rows of a bucket that has been judged are dropped; the query's progress counts
    those of one station and slice that come in one task as one, and input rows twice, as
    those without ts go by a branch of their own. Every trigger writes its
    rows and the stations' last readings under its number, so one that is run again
    replaces what it wrote."""
    spark = feed.sparkSession
    schema = feed.select("event_id", "station_id", "ts", F.col("feature_dim_mm").cast("double")).schema

    def trigger(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/released")  # state may be read once
        new = spark.read.schema(schema).parquet(f"{path}/released")
        before = spark.read.schema(stream.LAST).parquet(f"{path}/last/{number - 1}") if number else spark.createDataFrame([], stream.LAST)
        held, after = stream.held_readings(new.filter("ts is not null"), before)
        untimed = new.filter("ts is null").select("event_id", "station_id", F.lit(False).alias("held"))
        held.union(untimed).write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")
        after.write.mode("overwrite").parquet(f"{path}/last/{number}")

    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before_run = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        stream.to_end(released(feed, delay, bucket_s).writeStream.foreachBatch(trigger).outputMode("append"), f"{path}/state", name)
    finally:
        conf.set(key, before_run)
    return tables.optional_source(spark, f"{path}/rows", HELD).drop("trigger")
