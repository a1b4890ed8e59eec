"""Four source systems on one grain: conform, join, reconcile, report.

Rows that fail to match are kept and flagged. Range and interval predicates have
an equi-key form here; the literal forms exist for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P
from plantlens.functions.scalar import canonical_serial, failed, production_day, ratio, shift_code, shift_key, sql_round


def crosswalk(df: DataFrame, mapping: DataFrame, key: str, to: str) -> DataFrame:
    """Adds ``to``: the canonical key of a source key, null where there is none."""
    return df.join(F.broadcast(mapping.withColumnRenamed("canonical", to)), df[key] == F.col("source_key"), "left").drop("source_key")  # policy-sized


def us_date(c: str) -> Column:
    """A date as text, month first; null where it is none."""
    return F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("date")


def whole(c: str) -> Column:
    return F.col(c).try_cast("long")


def given(df: DataFrame, name: str, cast: Callable[[str], Column] = F.col) -> Column:
    """A column that a source may lack."""
    found = {c.lower(): c for c in df.columns}
    return cast(found[name.lower()]) if name.lower() in found else cast("_none")


#: for each extract the columns that a cast may reject
TYPED: dict[str, dict[str, Callable[[str], Column]]] = {
    "erp_work_orders": {"SCHED_START_DT": us_date, "SCHED_END_DT": us_date, "QTY_ORDERED": whole},
    "mes_shift_log": {"units_completed": whole, "units_started": whole, "downtime_min": whole},
    "qms_ncr": {"OPENED_DT": us_date, "CLOSED_DT": us_date},
}
#: for each extract the columns whose codes a crosswalk maps
CODED = {
    "erp_work_orders": {"PROD_LINE": "dim_line", "ITEM_NO": "dim_item"},
    "mes_shift_log": {"work_center": "dim_work_center"},
    "qms_ncr": {"DEFECT_CATEGORY": "dim_category"},
}


def with_reasons(df: DataFrame, extract: str, dims: dict[str, DataFrame]) -> DataFrame:
    """Adds reasons: what of a row's values is no date, no number, or a code that
    no crosswalk knows, as ``kind:column``. Blank and missing values are none of
    these. The crosswalks are policy tables of a checked size."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    out, tests = df, []
    for c, cast in TYPED[extract].items():
        if c in df.columns:
            kind = "date" if cast is us_date else "number"
            tests.append(F.when(~blank(c) & cast(c).isNull(), f"{kind}:{c}"))
    for i, (c, name) in enumerate(CODED[extract].items()):
        if c in df.columns:
            known = dims[name].select(F.col("source_key").alias(f"_key{i}")).distinct()
            out = out.join(F.broadcast(known), F.col(c) == F.col(f"_key{i}"), "left")
            tests.append(F.when(~blank(c) & F.col(f"_key{i}").isNull(), f"code:{c}"))
    return out.select(*df.columns, F.array_compact(F.array(*tests)).alias("reasons"))


def quarantine(df: DataFrame, extract: str, dims: dict[str, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """The rows that conform, and those that do not beside their reasons. One pass
    writes both, parted by a flag, and both are read from there."""
    flagged = with_reasons(df, extract, dims).withColumn("clean", F.size("reasons") == 0)
    flagged.write.mode("overwrite").partitionBy("clean").parquet(path)
    kinds = flagged.schema
    rows = df.sparkSession.read.schema(kinds).parquet(path)
    return rows.filter("clean").select(*df.columns), rows.filter("not clean").drop("clean")


def reject_counts(rejects: DataFrame, extract: str) -> DataFrame:
    """extract, reason and rows; a row of several reasons counts for each."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy(F.lit(extract).alias("extract"), "reason").agg(F.count("*").alias("rows"))


def conform_erp(erp: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Dates that are none become null; ``quarantine`` keeps such rows apart."""
    out = crosswalk(crosswalk(erp, dims["dim_line"], "PROD_LINE", "line_id"), dims["dim_item"], "ITEM_NO", "part_number")
    date = us_date
    return out.select(F.col("WORK_ORDER_NO").alias("work_order_no"), F.col("ITEM_NO").alias("item_no"), "part_number", "line_id", F.col("PROD_LINE").alias("prod_line"), date("SCHED_START_DT").alias("sched_start"), date("SCHED_END_DT").alias("sched_end"))


def conform_mes(mes: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    wo = F.when(F.trim("wo_no") != "", F.concat(F.lit("WO-"), F.trim("wo_no")))
    out = crosswalk(mes.withColumn("_none", F.lit(None).cast("string")), dims["dim_work_center"], "work_center", "station_id")
    return out.select("shift_id", "work_center", "station_id", "shift_code", "shift_start_ts", "shift_end_ts", wo.alias("mes_work_order_no"), whole("units_completed").alias("units_completed"), given(mes, "units_started", whole).alias("units_started"), given(mes, "downtime_min", whole).alias("downtime_min"), F.to_date("shift_start_ts").alias("prod_day"))


def conform_qms(qms: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    out = crosswalk(qms.withColumn("_none", F.lit(None).cast("string")), dims["dim_category"], "DEFECT_CATEGORY", "defect_code_qms")
    return out.select(F.col("NCR_NO").alias("ncr_no"), canonical_serial(F.col("SERIAL_NO")).alias("serial_key"), F.col("DEFECT_CATEGORY").alias("defect_category"), "defect_code_qms", given(qms, "SEVERITY").cast("string").alias("severity"), F.col("DISPOSITION").alias("disposition"), given(qms, "OPENED_DT", us_date).alias("opened_date"))


def with_keys(looks: DataFrame) -> DataFrame:
    """Adds date, prod_day, shift_code, shift_id and serial_key."""
    day, code = production_day(F.col("ts")), shift_code(F.col("ts"))
    return (
        looks.withColumn("date", F.to_date("ts")).withColumn("prod_day", day).withColumn("shift_code", code)
        .withColumn("shift_id", shift_key(day, code)).withColumn("serial_key", canonical_serial(F.col("serial_number")))
    )


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: list[str], bucket: Callable[[Column], Column] = F.to_date, parts: int | None = None) -> DataFrame:
    """Every left row with the latest right row of its key at or before it.

    Time is cut into buckets. Within a key and bucket both sides are united and
    the last right row seen is carried forward; what earlier buckets carry in is
    found over one row a key and bucket, and stands in front of the bucket. So no
    task holds the whole time line of a key, and a hot key is split by a finer
    ``bucket``. A right row of the same time counts as before; of several the
    last in order of all values. Rows with a null key or time match nothing, and
    lie anywhere in the shuffle. ``parts``: of shuffles, where the session's are too few.
    """
    deal = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    name, kind = left.columns, right.select(F.struct(*values)).schema[0].dataType
    at = lambda df, c: df.withColumn("_t", F.col(c)).withColumn("_b", bucket(F.col(c)))
    known = F.col("_t").isNotNull() & F.col(by).isNotNull()
    l, r = at(left, left_on), at(right, right_on).filter(known)  # noqa: E741
    last = r.groupBy(by, "_b").agg(F.max(F.struct("_t", F.struct(*values).alias("v"))).alias("m")).select(by, "_b", F.col("m.v").alias("_v"))
    spans = deal(l.filter(known).select(by, "_b"), by, "_b").distinct().withColumn("_v", F.lit(None).cast(kind))
    every = deal(last.unionByName(spans), by).groupBy(by, "_b").agg(F.max("_v").alias("_v"))
    before = W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select(by, "_b", F.last("_v", ignorenulls=True).over(before).alias("_v")).filter("_v is not null")

    time = l.schema["_t"].dataType
    blank = [F.col(by) if c == by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in name]
    spot = F.when(~known, F.pmod(F.xxhash64(*[c for c, k in left.dtypes if "map<" not in k]), F.lit(1024)))
    no_spot = F.lit(None).cast("long").alias("_spot")
    rows = l.select(*name, "_t", "_b", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), spot.alias("_spot"))
    marks = r.select(*blank, "_t", "_b", F.lit(0).alias("_side"), F.struct(*values).alias("_v"), no_spot)
    front = carried.select(*blank, F.lit(None).cast(time).alias("_t"), "_b", F.lit(0).alias("_side"), "_v", no_spot)
    order = W.partitionBy(by, "_b", "_spot").orderBy(F.asc_nulls_first("_t"), "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    seen = deal(rows.union(marks).union(front), by, "_b", "_spot").withColumn("_m", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    got = seen.withColumn("_m", F.when(known, F.col("_m")))
    return got.select(*name, *[F.col(f"_m.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, by: str, on: str, start: str, end: str) -> DataFrame:
    """Left outer join on a closed range; the key is the equi-part."""
    a, b = left.alias("a"), right.alias("b")
    cond = (F.col(f"a.{by}") == F.col(f"b.{by}")) & F.col(f"a.{on}").between(F.col(f"b.{start}"), F.col(f"b.{end}"))
    return a.join(b, cond, "left").select("a.*", *[F.col(f"b.{c}") for c in right.columns if c != by])


def range_join_by_day(left: DataFrame, right: DataFrame, by: str, on: str, start: str, end: str) -> DataFrame:
    """The same for dates, when the ranges are no small table: each range
    becomes its days, and the join an equi-join on key and day."""
    days = right.filter(F.col(start) <= F.col(end)).withColumn("_day", F.explode(F.sequence(start, end)))
    a, b = left.alias("a"), days.alias("b")
    cond = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{on}") == F.col("b._day"))
    return a.join(b, cond, "left").select("a.*", *[F.col(f"b.{c}") for c in right.columns if c != by])


def asof_bounded(left: DataFrame, erp: DataFrame) -> DataFrame:
    """As-of on the schedule's start; past its end there is no work order."""
    got = asof_join(left, erp, "line_id", "date", "sched_start", ["sched_start", "sched_end", "work_order_no", "item_no"])
    inside = F.coalesce(F.col("date") <= F.col("sched_end"), F.lit(False))
    return got.withColumns({c: F.when(inside, F.col(c)) for c in ("work_order_no", "item_no")}).withColumn("has_work_order", inside)


def interval_join(mes: DataFrame, looks: DataFrame) -> DataFrame:
    """Shifts with the events inside their half-open interval, counted."""
    a, b = mes.alias("a"), looks.alias("b")
    cond = (F.col("a.station_id") == F.col("b.station_id")) & (F.col("b.ts") >= F.col("a.shift_start_ts")) & (F.col("b.ts") < F.col("a.shift_end_ts"))
    return a.join(b, cond, "left").groupBy("a.station_id", "a.shift_id").agg(F.count("b.event_id").alias("events"))


def derived_key_join(mes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same counts by equality on the shift that a time lies in."""
    counts = keyed.groupBy("station_id", "shift_id").agg(F.count("*").alias("events"))
    return mes.select("station_id", "shift_id").join(counts, ["station_id", "shift_id"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def serial_join(keyed: DataFrame, qms: DataFrame) -> DataFrame:
    """Events with their NCRs; one serial may have several. An event without a
    serial has a key of its own in the join, so that they are no hot key."""
    ncrs = qms.filter("serial_key is not null").select(F.col("serial_key").alias("_serial"), "ncr_no", "defect_code_qms", "disposition")
    key = F.coalesce("serial_key", F.concat(F.lit("\0"), "event_id"))
    return keyed.join(ncrs, key == F.col("_serial"), "left").drop("_serial")


def join_all(keyed: DataFrame, erp: DataFrame, mes: DataFrame, qms: DataFrame) -> DataFrame:
    """Event-grain fact with the context of all systems, from looks with keys; the
    range of a work order is joined by its days, so that a line is no hot key."""
    ranged = range_join_by_day(keyed, erp.select("line_id", "sched_start", "sched_end", "work_order_no", "item_no"), "line_id", "date", "sched_start", "sched_end")
    shifts = mes.select("station_id", "shift_id", "units_completed", "mes_work_order_no")
    joined = ranged.join(shifts, ["station_id", "shift_id"], "left")
    return serial_join(joined, qms).withColumn("has_work_order", F.col("work_order_no").isNotNull()).withColumn("has_mes_shift", F.col("units_completed").isNotNull())


def wo_station_day(fact: DataFrame) -> DataFrame:
    per = fact.groupBy("station_id", "date").agg(
        F.min("line_id").alias("line_id"),
        F.count("*").alias("n_first_pass"),
        F.sum(failed()).alias("n_fail"),
        F.min("work_order_no").alias("work_order_no"),
        F.min("item_no").alias("item_no"),
        F.count("ncr_no").alias("ncr_count"),
        F.count(F.when(F.col("disposition") == "SCRAP", 1)).alias("ncr_scrap"),
    )
    return per.withColumn("has_work_order", F.col("work_order_no").isNotNull())


def wo_progress(days: DataFrame) -> DataFrame:
    """Day number and running units in each work order; null without one."""
    order = W.partitionBy("work_order_no", "station_id").orderBy("date")
    has = F.col("has_work_order")
    return days.withColumn("wo_day_seq", F.when(has, F.row_number().over(order))).withColumn("wo_cum_units", F.when(has, F.sum("n_first_pass").over(order.rowsBetween(W.unboundedPreceding, 0))))


def shift_counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("station_id", "prod_day", "shift_code", "shift_id").agg(F.count("*").alias("inspection_events"))


def reconcile(keyed: DataFrame, mes: DataFrame, tolerance: float = P.BUILT_IN["tolerance_pct"]) -> DataFrame:
    """Shifts that the floor produced against shifts that were logged. Shifts
    only in the log keep null prod_day and shift_code."""
    log = mes.select("station_id", "shift_id", F.col("units_completed").alias("mes_units_completed"), F.col("mes_work_order_no").alias("work_order_no"), "downtime_min")
    both = shift_counts(keyed).join(log, ["station_id", "shift_id"], "full")
    n, done = F.coalesce("inspection_events", F.lit(0)), F.col("mes_units_completed")
    raw = F.when((n > 0) & done.isNotNull(), F.try_divide((done - n) * F.lit(100.0).cast("double"), n.cast("double")))
    return both.select(
        "station_id", "shift_id", "prod_day", "shift_code", "work_order_no", n.alias("inspection_events"), "mes_units_completed", "downtime_min",
        sql_round(raw).alias("qty_variance_pct"), done.isNotNull().alias("shift_present"), F.coalesce(F.abs(raw) > tolerance, F.lit(False)).alias("variance_flag"),
    )


def variance_shifts(rec: DataFrame, most: int = 5) -> DataFrame:
    """The flagged shifts of the greatest variance, either way."""
    far = F.abs("qty_variance_pct")
    flagged = rec.filter("variance_flag").orderBy(far.desc(), "station_id", "shift_id").limit(most)
    return flagged.select("station_id", "shift_id", "inspection_events", "mes_units_completed", "qty_variance_pct")


def orphan_ncrs(qms: DataFrame, keyed: DataFrame) -> DataFrame:
    return qms.join(keyed.select("serial_key").distinct(), "serial_key", "left_anti")


def booked_after_close(mes: DataFrame, erp: DataFrame) -> DataFrame:
    ends = erp.select(F.col("work_order_no").alias("mes_work_order_no"), "sched_end")
    return mes.join(ends, "mes_work_order_no").filter(F.col("prod_day") > F.col("sched_end"))


def _crosswalked(erp: DataFrame, mes: DataFrame, qms: DataFrame) -> DataFrame:
    """key, value and mapped of every row of the conformed extracts."""
    one = lambda df, key, source, canonical: df.select(F.lit(key).alias("key"), F.col(source).alias("value"), F.col(canonical).isNotNull().alias("mapped"))
    return (
        one(erp, "line", "prod_line", "line_id")
        .unionByName(one(mes, "work_center", "work_center", "station_id"))
        .unionByName(one(erp, "item_no", "item_no", "part_number"))
        .unionByName(one(qms, "defect_category", "defect_category", "defect_code_qms"))
    )


def crosswalk_coverage(erp: DataFrame, mes: DataFrame, qms: DataFrame) -> DataFrame:
    """Of each key the rows that its crosswalk maps, those that it does not, and
    how many values these hold; ``crosswalk_unmapped`` lists them. A key whose
    extract is empty has no row."""
    n = lambda c: F.sum(c.cast("long"))
    rows = _crosswalked(erp, mes, qms)
    return rows.groupBy("key").agg(n(F.col("mapped")).alias("mapped"), n(~F.col("mapped")).alias("unmapped"), F.countDistinct(F.when(~F.col("mapped"), F.col("value"))).alias("unmapped_values"))


def crosswalk_unmapped(erp: DataFrame, mes: DataFrame, qms: DataFrame) -> DataFrame:
    """key, value and rows of what no crosswalk maps."""
    return _crosswalked(erp, mes, qms).filter("not mapped").groupBy("key", "value").agg(F.count("*").alias("rows"))


def integrity_report(fact: DataFrame, mes: DataFrame, erp: DataFrame, qms: DataFrame, rec: DataFrame, keyed: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    broken = ~F.col("has_work_order") | ~F.col("has_mes_shift") | F.col("serial_key").isNull()
    conflict = F.col("defect_code_qms").isNotNull() & (F.col("defect_code_qms") != F.coalesce("defect_code", F.lit("")))
    parts = [
        fact.agg(
            F.count("*").alias("events"),
            n(~F.col("has_work_order")).alias("without_work_order"),
            n(~F.col("has_mes_shift")).alias("without_shift"),
            n(F.col("serial_key").isNull()).alias("without_serial"),
            n(conflict).alias("taxonomy_conflicts"),
            F.round(100 * ratio(n(F.col("date") != F.col("prod_day")), F.count("*")), 2).alias("other_day_pct"),
            F.round(1 - ratio(n(broken), F.count("*")), 4).alias("integrity_score"),
        ),
        orphan_ncrs(qms, keyed).agg(F.count("*").alias("orphan_ncrs")),
        rec.agg(n(~F.col("shift_present")).alias("shifts_missing"), n(F.col("variance_flag")).alias("variance_shifts")),
        booked_after_close(mes, erp).agg(F.count("*").alias("booked_after_close")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out


def orphan_register(fact: DataFrame, qms: DataFrame, keyed: DataFrame) -> DataFrame:
    """(kind, ref) of every event and NCR that failed to match, an event once a kind."""
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("has_work_order"), "event_without_work_order"), F.when(~F.col("has_mes_shift"), "event_without_mes_shift"), F.when(F.col("serial_key").isNull(), "event_no_serial")
        )
    )
    events = fact.select(F.explode(kinds).alias("kind"), F.col("event_id").alias("ref")).distinct()
    return events.unionByName(orphan_ncrs(qms, keyed).select(F.lit("ncr_without_inspection_event").alias("kind"), F.col("ncr_no").alias("ref")))


def orphan_days(fact: DataFrame) -> DataFrame:
    return fact.filter("not has_work_order").select("line_id", "date").distinct()
