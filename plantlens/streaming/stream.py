"""Station operators on a feed. Each has a batch twin in ``operators``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from plantlens import policy as P
from plantlens.functions.scalar import failed
from plantlens.operators import spc
from plantlens.sources import tables


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """A feed of Parquet files with ``ts`` as an instant: watermarks need one.
    Test tables hold it without a zone; the session's zone is to be UTC."""
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeated ids that arrive within the watermark; state is bounded by it."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_fpy(feed: DataFrame, width: str, start: str = "0 seconds", delay: str = "1 day") -> DataFrame:
    """n, fails and fpy a station and window; rows past the watermark are dropped
    and counted in the query's progress (numRowsDroppedByWatermark)."""
    looks = feed.filter("inspection_pass = 1").withWatermark("ts", delay)
    per = looks.groupBy("station_id", F.window("ts", width, width, start)).agg(F.count("*").alias("n"), F.sum(failed()).alias("fails"))
    return per.select("station_id", F.col("window.start").alias("start"), "n", "fails", (1 - F.col("fails") / F.col("n")).alias("fpy"))


def daily_fpy(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    return windowed_fpy(feed, "1 day", delay=delay)


def shift_fpy(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    return windowed_fpy(feed, "8 hours", "6 hours", delay)


def freeze_limits(daily: DataFrame, root: str, policy: P.Policy = P.BUILT_IN) -> dict:
    """Publishes the baseline of each station's first subgroups, and the day that it
    is frozen through, as the mart ``limits``."""
    n = policy.days("baseline_days")
    first = spc.subgroup_rank(daily).filter(F.col("subgroup") <= n)
    through = first.groupBy("station_id").agg(F.max("d").alias("frozen_through"))
    return tables.publish_mart(spc.baseline_pbar(daily, n).join(through, "station_id"), root, "limits", "freeze")


def run_phase2(feed: DataFrame, limits_root: str, path: str, policy: P.Policy = P.BUILT_IN, delay: str = "1 day") -> DataFrame:
    """Scores a feed's days against stored limits while the feed runs: a join of the
    stream with a static table. Every trigger reads the last published limits anew,
    judges the days that it has updated, if they are later than the limits are frozen
    through, and writes them under its number; of each day the row of the last trigger
    holds. Days of stations without limits are not judged."""
    spark = feed.sparkSession
    days = daily_fpy(feed, delay)

    def trigger(rows: DataFrame, number: int) -> None:
        limits = tables.open_mart(spark, limits_root, "limits")
        new = rows.select("station_id", F.to_date("start").alias("d"), "n", "fails", (F.col("fails") / F.col("n")).alias("defect_rate"))
        judged = spc.phase2_score(new, limits, policy["sigma"]).filter(F.col("d") > F.col("frozen_through"))
        judged.drop("frozen_through").write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")

    to_end(days.writeStream.foreachBatch(trigger).outputMode("update"), f"{path}/state")
    schema = "station_id string, d date, n long, fails long, defect_rate double, pbar double, ucl double, lcl double, out_of_control boolean, trigger long"
    return _last_rows(tables.optional_source(spark, f"{path}/rows", schema), ["station_id", "d"])


LAST = "station_id string, last struct<v: double>, prev struct<v: double>"


def held_readings(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """event_id, station_id and held: is it the third identical reading in a row,
    in order of ts and event_id? Second, the last two readings of each station
    (LAST), as ``before`` holds those from earlier rows.

    Readings are compared within a station and day. What the days before carry
    in is found over one row a station and day, so no task holds a station.
    """
    rows = rows.select("event_id", "station_id", "ts", F.struct(F.col("feature_dim_mm").alias("v")).alias("v"), F.to_date("ts").alias("_b"))
    day = W.partitionBy("station_id", "_b").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    near = rows.withColumns({"_n": F.row_number().over(day), "_1": F.lag("v", 1).over(day), "_2": F.lag("v", 2).over(day), "_next": F.lead("v", 1).over(day)})
    ends = near.filter("_next is null").select("station_id", "_b", F.lit(1).alias("_new"), F.col("v").alias("last"), F.col("_1").alias("prev"))
    ends = ends.union(before.select("station_id", F.lit(None).cast("date"), F.lit(0), "last", "prev"))
    days = W.partitionBy("station_id").orderBy("_new", F.asc_nulls_last("_b"))
    carried = ends.withColumns({"_c1": F.lag("last", 1).over(days), "_c2": F.coalesce(F.lag("prev", 1).over(days), F.lag("last", 2).over(days)), "_after": F.lead("last", 1).over(days)})
    after = carried.filter("_after is null").select("station_id", "last", F.coalesce("prev", "_c1").alias("prev"))
    into = carried.filter("_new = 1").select(F.col("station_id").alias("_s"), F.col("_b").alias("_d"), "_c1", "_c2")
    joined = near.join(into, F.col("station_id").eqNullSafe(F.col("_s")) & F.col("_b").eqNullSafe(F.col("_d")))
    one = F.coalesce("_1", "_c1")
    two = F.coalesce("_2", F.when(F.col("_n") == 1, F.col("_c2")).when(F.col("_n") == 2, F.col("_c1")))
    same = (F.col("v.v") == one["v"]) & (F.col("v.v") == two["v"]) & ~F.isnan("v.v")
    return joined.select("event_id", "station_id", F.coalesce(same, F.lit(False)).alias("held")), after


def run_held_readings(feed: DataFrame, path: str) -> DataFrame:
    """Runs held_readings on a feed to its present end and reads the rows. Every
    trigger writes its rows and the stations' last readings under its number,
    so one that is run again replaces what it wrote."""
    spark = feed.sparkSession

    def trigger(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(LAST).parquet(f"{path}/last/{number - 1}") if number else spark.createDataFrame([], LAST)
        held, after = held_readings(rows, before)
        held.write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")
        after.write.mode("overwrite").parquet(f"{path}/last/{number}")

    to_end(feed.writeStream.foreachBatch(trigger), f"{path}/state")
    return tables.optional_source(spark, f"{path}/rows", "event_id string, station_id string, held boolean").drop("trigger")


def to_end(writer: DataStreamWriter, state: str, name: str | None = None) -> None:
    query = (writer.queryName(name) if name else writer).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


def run_appended(result: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Runs a feed to its present end and reads the rows that it appended, from
    Parquet files beside the state."""
    to_end(result.writeStream.format("parquet").option("path", f"{path}/rows").outputMode("append"), f"{path}/state", name)
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/rows")


def run_updated(result: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The same for a result that updates its rows. Every trigger writes what it
    has updated under its number, so one that is run again replaces what it
    wrote; of each key the row of the last trigger holds."""

    def trigger(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")

    to_end(result.writeStream.foreachBatch(trigger).outputMode("update"), f"{path}/state")
    schema = T.StructType([*result.schema.fields, T.StructField("trigger", T.LongType())])
    return _last_rows(tables.optional_source(result.sparkSession, f"{path}/rows", schema), keys)


def _last_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the last trigger."""
    names = [c for c in rows.columns if c != "trigger"]
    rest = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("_r"))
    return last.select(*[c if c in keys else F.col(f"_r.{c}") for c in names])


PROGRESS = "query string, run string, trigger long, input_rows long, dropped_rows long, state_rows long, watermark string"


class ProgressTable(StreamingQueryListener):
    """Writes a row of every trigger of the named queries to a folder: rows read,
    rows dropped because they were behind the watermark, rows of state, watermark.
    ``with ProgressTable(spark, path, names) as t: ...`` listens; ``t.rows()`` reads."""

    def __init__(self, spark: SparkSession, path: str, names: Sequence[str]):
        self.spark, self.path, self.names = spark, path, set(names)

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name not in self.names:
            return
        row = {
            "query": p.name, "run": str(p.runId), "trigger": p.batchId, "input_rows": p.numInputRows, "dropped_rows": sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
            "state_rows": sum(o.numRowsTotal for o in p.stateOperators), "watermark": p.eventTime.get("watermark"),
        }
        tables.write_small(self.spark, f"{self.path}/{p.runId}-{p.batchId}-{uuid.uuid4().hex}.json", json.dumps(row))

    def rows(self) -> DataFrame:
        """One row a trigger; a trigger that ran again counts with its last run."""
        return tables.optional_source(self.spark, self.path, PROGRESS, "json")
