"""The registered queries. Each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P
from plantlens.functions import scalar
from plantlens.operators import condition, coverage, findings, integrate, quality, spc
from plantlens.plans.marts import Plant
from plantlens.sources import tables
from plantlens.streaming import keyed, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types that two engines agree on: long, double of six digits, text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "date" or kind.startswith("timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def query(f: Callable[[Plant], DataFrame]) -> Callable[[Plant], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(Plant(spark, sf_dir)))
    return f


DAY = ["station_id", "d", "n", "fails"]
EVENT = ["event_id", "station_id", "vision_result", "defect_code", "inspection_pass", "feature_dim_mm"]


# ---- sources and sinks ----------------------------------------------------
def _as_csv(p: Plant, name: str) -> str:
    path = tables.scratch_path(p.spark, name)
    df = p.source(name)
    times = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind.startswith("timestamp")}  # to the microsecond
    df.withColumns(times).write.option("header", True).csv(path)
    return path


@query
def scan_events(p):
    return tables.scan_events(p.spark, _as_csv(p, "inspections")).groupBy("station_id").agg(F.count("*").alias("n"), F.sum("cycle_time_s").alias("cycle_s"), F.max("ts").alias("latest"))


@query
def bronze_text_scan(p):
    path = _as_csv(p, "qms_ncr")
    return tables.scan_text(p.spark, path, ["NCR_NO", "SERIAL_NO", "DEFECT_CATEGORY", "DISPOSITION"])


@query
def scan_mixed(p):
    return tables.scan_mixed(p.spark, _as_csv(p, "mes_shift_log")).select("shift_id", "work_center", "wo_no", "units_completed")


@query
def scan_tolerant(p):
    """Every 50th line of the landed events has text for its reading."""
    path = tables.scratch_path(p.spark, "tolerant")
    bad = p.raw.withColumn("feature_dim_mm", F.when(F.col("event_id").endswith("50"), "oops").otherwise(F.col("feature_dim_mm").cast("string")))
    bad.write.option("header", True).csv(path)
    return tables.scan_tolerant(p.spark, path).groupBy("station_id").agg(F.count("*").alias("n"), F.count(tables.CORRUPT).alias("corrupt"), F.count("feature_dim_mm").alias("readings"), F.count("serial_number").alias("serials"))


@query
def optional_source(p):
    here = tables.optional_source(p.spark, f"{p.sf_dir}/events.parquet", "event_id long")
    gone = tables.optional_source(p.spark, f"{p.sf_dir}/no_such_extract.parquet", "event_id long")
    one = lambda df, k: df.agg(F.lit(k).alias("extract"), F.count("*").alias("n"))
    return one(here, "events").unionByName(one(gone, "no_such_extract"))


@query
def source_sanity(p):
    return tables.source_sanity(p.raw)


@query
def mart_write(p):
    path = tables.scratch_path(p.spark, "mart")
    mart = spc.rolling_fpy(spc.pchart(p.daily))
    tables.write_mart(mart, path, [*DAY, "rolling_fpy", "ucl"], ["station_id"])
    return p.spark.read.parquet(path).groupBy("station_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("fails").alias("fails"))


@query
def report_write(p):
    path = tables.scratch_path(p.spark, "report")
    tables.write_report({"quality": quality.score(p.raw, p.policy), "sources": tables.source_sanity(p.raw)}, path)
    return p.spark.read.schema("quality struct<n_rows long, offending long, dq_score double>, sources struct<n_rows long, n_keys long>").json(path).select("quality.n_rows", "quality.offending", "quality.dq_score", "sources.n_keys")


# ---- yield and control charts ---------------------------------------------
@query
def dedupe_first(p):
    return p.events.select(*EVENT)


@query
def first_pass(p):
    return p.looks.select(*EVENT)


@query
def daily_fpy(p):
    return p.daily


@query
def rolling_fpy(p):
    return spc.rolling_fpy(p.daily).select("station_id", "d", "fpy", "rolling_fpy")


@query
def subgroup_rank(p):
    return spc.subgroup_rank(p.daily).select("station_id", "d", "subgroup")


@query
def baseline_pbar(p):
    return spc.baseline_pbar(p.daily)


@query
def limits_join(p):
    return spc.limits_join(p.daily, spc.baseline_pbar(p.daily)).select(*DAY, "pbar")


@query
def pchart_limits(p):
    return spc.pchart(p.daily).select(*DAY, "pbar", "ucl", "lcl", "out_of_control")


@query
def station_avg_window(p):
    return spc.station_average(p.daily).select(*DAY, "station_avg")


@query
def tuned_before(p):
    """A correlated subquery a row; kept to compare with the window form."""
    return p.spark.sql(
        "WITH day AS (SELECT station_id, to_date(ts) d, avg(IF(vision_result = 'FAIL', 1.0D, 0.0D)) p FROM {looks} GROUP BY 1, 2) "
        "SELECT station_id, d, p, (SELECT avg(IF(vision_result = 'FAIL', 1.0D, 0.0D)) FROM {looks} e WHERE e.station_id = day.station_id) station_avg FROM day",
        looks=p.looks,
    )


@query
def tuned_after(p):
    return spc.station_average(p.daily).select("station_id", "d", F.col("defect_rate").alias("p"), "station_avg")


@query
def phase2_score(p):
    """Days after the baseline against limits frozen on it."""
    later = spc.subgroup_rank(p.daily).filter(F.col("subgroup") > p.policy.days("baseline_days"))
    return spc.phase2_score(later, spc.baseline_pbar(p.daily)).select(*DAY, "ucl", "lcl", "out_of_control")


# ---- capability, scorecard, triage ----------------------------------------
@query
def cpk(p):
    return spc.capability(p.looks, p.policy).select("station_id", "cpk", "readings")


@query
def cpk_recent(p):
    return spc.capability(p.looks, p.policy).select("station_id", "cpk_recent")


@query
def recent_window(p):
    return spc.recent_window(p.looks).groupBy("station_id").agg(F.count("*").alias("n"), F.min(F.to_date("ts")).alias("first_day"))


@query
def recent_profile(p):
    return spc.recent_profile(p.raw, p.daily, p.policy)


@query
def valid_cutoff(p):
    """Start of the recent window where it ends with the last valid reading, beside
    that of all first looks, and the readings since."""
    valid = spc.valid_readings(spc.first_pass(p.raw), p.policy)
    late = spc.recent_window(valid, p.policy.days("recent_days")).groupBy("start").agg(F.count("*").alias("readings"))
    return late.join(F.broadcast(spc.recent_start(p.looks, p.policy.days("recent_days")).toDF("start_of_looks")), F.lit(True))  # one row each


@query
def daily_dim_mean(p):
    return spc.daily_readings(p.looks, p.policy).select("station_id", "d", "mean_dim", "readings")


CARD = ["station_id", "line_id", "n", "fails", "fpy_overall", "rolling_latest", "violations", "first_violation", "cpk", "cpk_recent", "status"]


@query
def station_scorecard(p):
    return spc.scorecard(p.looks, p.policy).select(*CARD)


@query
def scorecard_assemble(p):
    """Stations without a valid reading stay."""
    return p.looks.groupBy("station_id").agg(F.count("*").alias("n")).join(spc.capability(p.looks).select("station_id", "cpk"), "station_id", "left")


@query
def status_rule(p):
    return spc.scorecard(p.looks, p.policy).select("station_id", "violations", "status")


@query
def spc_alerts(p):
    return spc.scorecard(p.looks, p.policy).filter("violations > 0").select("station_id", "violations", "first_violation")


@query
def capability_alerts(p):
    return spc.scorecard(p.looks, p.policy).filter(F.col("cpk_recent") < p.policy["cpk_min"]).select("station_id", "cpk_recent")


@query
def pareto(p):
    return spc.pareto(p.looks)


@query
def cum_share(p):
    return spc.pareto(p.looks).select("defect_code", "cum_pct")


@query
def top_defects(p):
    return spc.pareto(p.looks).orderBy("place").limit(5).select("defect_code", "fails")


@query
def fleet_kpis(p):
    return spc.fleet_kpis(p.looks, p.policy)


@query
def dim_trend(p):
    return spc.dim_trend(p.looks, p.policy)


@query
def defect_trend(p):
    return spc.defect_trend(p.daily)


@query
def triage_pattern(p):
    return spc.triage(p.looks, p.policy).select("station_id", "pattern", "severity", "violations", "drift")


@query
def dq_triage(p):
    return quality.score(p.raw, p.policy).select("dq_score", F.when(F.col("dq_score") < 0.99, "medium").otherwise("none").alias("severity"))


# ---- data quality ---------------------------------------------------------
def _rule(name: str, *kinds: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Plant(spark, sf_dir)
        events = quality.with_duplicates(p.raw) if "unique" in kinds else p.raw
        return plain(quality.violations(events, quality.compiled(p.policy.of_kind(*kinds))))

    QUERIES[name] = run


for _name, _kinds in {"dq_required": ["required"], "dq_unique": ["unique"], "dq_allowed": ["allowed"], "dq_range": ["range"], "dq_consistency": ["absent_when", "present_when"]}.items():
    _rule(_name, *_kinds)


@query
def duplicate_flag(p):
    return quality.with_duplicates(p.raw).select("event_id", "is_duplicate")


@query
def violations_union(p):
    return quality.all_violations(p.raw, p.policy)


@query
def dq_score(p):
    return quality.score(p.raw, p.policy)


@query
def dq_by_rule(p):
    return quality.by_rule(quality.all_violations(p.raw, p.policy))


@query
def dq_validate(p):
    """One scan and one shuffle of the events; what follows reads the judged keys."""
    _, _, rep = quality.validate(p.raw, p.policy)
    return rep


@query
def dq_clean_and_rules(p):
    """Violations by rule, and the clean rows, of one pass."""
    keys = p.mart("judged", lambda: quality.judged_keys(p.raw, p.policy))
    clean = quality.clean_rows(keys, p.raw.columns).groupBy("station_id").agg(F.count("*").alias("n"))
    return quality.rule_counts(keys).toDF("name", "n").unionByName(clean.select(F.coalesce("station_id", F.lit("-")).alias("name"), "n"))


@query
def frozen_gauge(p):
    """Over readings of two digits, so that repeats occur."""
    return spc.frozen_gauge(p.looks.withColumn("feature_dim_mm", F.round("feature_dim_mm", 1))).select("event_id", "station_id", "held")


@query
def last5_slope_drift(p):
    return spc.last5_slope(p.looks, p.policy).select("event_id", "station_id", "slope", "drift")


# ---- integration ----------------------------------------------------------
@query
def canonical_serial(p):
    return p.keyed.select("event_id", "serial_key")


@query
def production_day(p):
    return p.keyed.select("event_id", "prod_day", (F.col("date") != F.col("prod_day")).alias("other_day"))


@query
def shift_code(p):
    return p.keyed.select("event_id", "shift_code", "shift_id")


@query
def sql_round(p):
    v = (F.col("n") - 8).cast("double") / 16
    return p.daily.select("station_id", "d", scalar.sql_round(v).alias("rounded"))


@query
def crosswalk_map(p):
    return p.qms.select("ncr_no", "defect_category", "defect_code_qms")


@query
def asof_join(p):
    return integrate.asof_join(p.keyed.select("event_id", "line_id", "date"), p.erp, "line_id", "date", "sched_start", ["sched_start", "work_order_no"]).select("event_id", "work_order_no")


@query
def asof_bounded(p):
    return integrate.asof_bounded(p.keyed.select("event_id", "line_id", "date"), p.erp).select("event_id", "work_order_no", "has_work_order")


@query
def range_join(p):
    return integrate.range_join(p.keyed.select("event_id", "line_id", "date"), p.erp, "line_id", "date", "sched_start", "sched_end").select("event_id", "work_order_no")


@query
def range_join_by_day(p):
    return integrate.range_join_by_day(p.keyed.select("event_id", "line_id", "date"), p.erp, "line_id", "date", "sched_start", "sched_end").select("event_id", "work_order_no")


def _order_ranges(p: Plant) -> tuple[DataFrame, DataFrame, int]:
    """Ship dates of line items, each customer's orders as ranges of dates, and parts
    of a shuffle that grow in number with the line items."""
    read = lambda t: p.spark.read.parquet(f"{p.sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start"))
    parts = tables.parts_by_size(read("lineitem"))
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(parts, "l_orderkey")
    items = read("lineitem").repartition(parts, "l_orderkey").join(owners, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey", F.to_date("l_shipdate").alias("ship"))
    nxt = F.lead("start").over(W.partitionBy("o_custkey").orderBy("start", "o_orderkey"))
    return items, orders.withColumn("end", F.date_sub(F.coalesce(nxt, F.to_date(F.lit("2030-01-01"))), 1)), parts


@query
def asof_volume(p):
    """The customer's latest order on or before each line item's ship date."""
    items, orders, parts = _order_ranges(p)
    got = integrate.asof_join(items, orders, "o_custkey", "ship", "start", ["o_orderkey"], parts=parts)
    return got.groupBy("o_custkey").agg(F.count("*").alias("items"), F.count("o_orderkey").alias("matched"), F.sum("o_orderkey").alias("key_sum"))


@query
def range_volume(p):
    """Line items by the customer's order whose range holds the ship date."""
    items, orders, _ = _order_ranges(p)
    got = integrate.range_join(items, orders.select("o_custkey", "o_orderkey", "start", "end"), "o_custkey", "ship", "start", "end")
    return got.groupBy("o_custkey").agg(F.count("*").alias("items"), F.count("o_orderkey").alias("matched"), F.sum("o_orderkey").alias("key_sum"))


@query
def interval_join(p):
    return integrate.interval_join(p.mes, p.looks)


@query
def derived_key_join(p):
    return integrate.derived_key_join(p.mes, p.keyed)


@query
def normalized_key_join(p):
    return integrate.serial_join(p.keyed, p.qms).select("event_id", "ncr_no")


@query
def full_outer_recon(p):
    return p.reconciled.select("station_id", "shift_id", "prod_day", "shift_code", "inspection_events", "shift_present")


@query
def qty_variance(p):
    return p.reconciled.select("station_id", "shift_id", "mes_units_completed", "qty_variance_pct", "variance_flag")


@query
def variance_shifts(p):
    """The five shifts whose logged units differ most from the inspected ones."""
    return integrate.variance_shifts(p.reconciled)


@query
def shift_counts(p):
    return integrate.shift_counts(p.keyed)


@query
def orphans_anti(p):
    return integrate.orphan_ncrs(p.qms, p.keyed).select("ncr_no", "serial_key")


@query
def booked_after_close(p):
    return integrate.booked_after_close(p.mes, p.erp).select("station_id", "shift_id", "mes_work_order_no")


@query
def wo_station_day(p):
    return integrate.wo_station_day(p.fact)


@query
def wo_progress(p):
    return integrate.wo_progress(integrate.wo_station_day(p.fact)).select("station_id", "date", "work_order_no", "wo_day_seq", "wo_cum_units")


@query
def crosswalk_coverage(p):
    return integrate.crosswalk_coverage(p.erp_mart, p.mes_mart, p.qms_mart)


@query
def crosswalk_unmapped(p):
    return integrate.crosswalk_unmapped(p.erp, p.mes, p.qms)


@query
def quarantine_counts(p):
    """What the landed extracts hold that is no date, no number or no known code.
    Some work orders have text for their end, some shifts for their units."""
    spoil = {"erp_work_orders": ("SCHED_END_DT", F.col("WORK_ORDER_NO").endswith("3")), "mes_shift_log": ("units_completed", F.col("shift_id").endswith("5-B"))}
    out = None
    for name in integrate.TYPED:
        rows = p.source(name)
        if name in spoil:
            column, where = spoil[name]
            rows = rows.withColumn(column, F.when(where, "n/a").otherwise(F.col(column).cast("string")))
        clean, rejects = integrate.quarantine(rows, name, p.dims, tables.scratch_path(p.spark, name))
        counts = integrate.reject_counts(rejects, name).unionByName(clean.agg(F.lit(name).alias("extract"), F.lit("clean").alias("reason"), F.count("*").alias("rows")))
        out = counts if out is None else out.unionByName(counts)
    return out


@query
def integrity_report(p):
    rec = integrate.reconcile(p.keyed_mart, p.mes_mart, p.policy["tolerance_pct"])
    return integrate.integrity_report(p.fact_of_marts, p.mes_mart, p.erp_mart, p.qms_mart, rec, p.keyed_mart)


@query
def orphan_register(p):
    return integrate.orphan_register(p.fact_of_marts, p.qms_mart, p.keyed_mart)


@query
def orphan_days(p):
    return integrate.orphan_days(p.fact)


# ---- coverage and cost ----------------------------------------------------
@query
def observed_modes(p):
    return p.observed


@query
def ncr_by_mode(p):
    return p.ncr


@query
def coverage_state(p):
    return p.cov


@query
def coverage_cross(p):
    return p.cov.groupBy("line_id", "state").agg(F.count("*").alias("cells"), F.sum("detections").alias("detections"))


@query
def coverage_matrix(p):
    """Mode by station: detections, or -1 where the station lost the mode."""
    lost = p.cond.filter("condition = 'ALERT'").select("station_id", "mode", F.lit(True).alias("lost"))
    cells = p.cov.join(lost, ["station_id", "mode"], "left").withColumn("v", F.when(F.col("lost"), -1).otherwise(F.col("detections")))
    stations = sorted(r.station_id for r in P.bounded_rows(p.dim("dim_position"), "dim_position"))
    return cells.groupBy("mode").pivot("station_id", stations).agg(F.first("v"))


@query
def mode_gap(p):
    return coverage.mode_gaps(p.cov)


@query
def coverage_kpis(p):
    return coverage.coverage_kpis(p.cov, p.econ)


@query
def effective_coverage(p):
    return coverage.effective_coverage(p.cond)


@query
def mode_label(p):
    return coverage.mode_labels(p.observed, p.dim("dim_mode"), p.dim("dim_basis"))


def _with_seen(p: Plant, df: DataFrame) -> DataFrame:
    return df.join(p.observed_mart, ["station_id", "mode"], "left").withColumn("detections", F.coalesce("detections", F.lit(0)))


@query
def discovery_point(p):
    return _with_seen(p, p.points.select("station_id", "mode", "found_kind", "found_at"))


@query
def false_reject_cost(p):
    """Of the fails seen at each station, were they all false."""
    cost = p.dim("dim_position").select("station_id", coverage.false_reject_cost(p.policy).alias("unit_vu"))
    return p.observed.groupBy("station_id").agg(F.sum("detections").alias("fails")).join(cost, "station_id").withColumn("total_vu", F.col("fails") * F.col("unit_vu"))


@query
def escape_cost(p):
    return _with_seen(p, p.points.select("station_id", "mode", coverage.escape_cost(p.policy).alias("unit_vu"), "found_kind")).withColumn("exposed_vu", F.col("detections") * F.col("unit_vu"))


@query
def exchange_rate(p):
    return _with_seen(p, p.econ)


@query
def cost_sensitivity(p):
    """Over all combinations, with the cheapest and dearest cost of all fails."""
    totals = p.swept.join(p.observed_mart, ["station_id", "mode"]).groupBy("combo_id").agg(F.sum(F.col("fr") * F.col("detections")).alias("vu"))
    span = totals.agg(F.min("vu").alias("least_vu"), F.max("vu").alias("most_vu"))
    return coverage.sensitivity(p.swept).join(F.broadcast(span), F.lit(True))  # one row each


@query
def sweep_cross(p):
    return p.swept.join(p.observed_mart, ["station_id", "mode"]).groupBy("combo_id", "line_id").agg(F.sum(F.col("fr") * F.col("detections")).alias("false_reject_vu"), F.sum(F.col("rate") * F.col("detections")).alias("weighted_rate"))


@query
def monotone_check(p):
    fails = p.looks.groupBy("line_id").agg(F.sum(scalar.failed()).alias("fails"))
    return coverage.monotone(p.swept).join(fails, "line_id")


@query
def event_cost_rollup(p):
    return coverage.event_costs(p.looks, p.econ)


@query
def position_walk(p):
    first = F.broadcast(p.dim("dim_position").agg(F.min("line_id").alias("line_id")))  # one row
    return _with_seen(p, p.econ.filter(F.col("mode") == P.COMMON_MODE).join(first, "line_id").select("position", "station_id", "mode", "exchange_rate", "found_at"))


@query
def exposed_modes(p):
    return _with_seen(p, p.econ.filter("not backstop").select("station_id", "mode", "exchange_rate"))


# ---- condition ------------------------------------------------------------
VERDICTS = ["station_id", "production_day", "imaging_ok", "measurement_ok", "fixture_ok", "eoat_ok", "tooling_ok", "selftest_ok"]


@query
def selftest_verdicts(p):
    return p.judged.select(*VERDICTS)


@query
def failing_sets(p):
    return condition.failing_sets(p.judged, p.policy).select("station_id", "production_day", "failing_sets")


@query
def gates(p):
    """Checks that each detected mode asks for."""
    need = condition.gates(p.dim("dim_mode"), p.dim("dim_gate"))
    return p.observed.groupBy("mode").agg(F.sum("detections").alias("detections")).join(need, "mode", "left")


@query
def longest_run(p):
    bad = p.judged.select("station_id", "production_day", (~F.col("selftest_ok")).alias("bad"))
    return condition.longest_run(bad, ["station_id"], "production_day", "bad")


@query
def latest_row(p):
    return condition.latest_rows(p.selftest).select("station_id", "production_day", "units_processed", "datamatrix_grade")


@query
def station_condition(p):
    return p.cond.drop("combo_id")


@query
def condition_sensitivity(p):
    return condition.selective(p.cond_swept)


@query
def wear_rate(p):
    return condition.wear_rates(p.wear_long).select("station_id", "measure", "points", (F.col("rate") * 1000).alias("rate_per_1k"))


@query
def wear_accel(p):
    r = condition.wear_rates(p.wear_long)
    return r.select("station_id", "measure", (F.col("rate_1") * 1000).alias("first_per_1k"), (F.col("rate_2") * 1000).alias("second_per_1k"), F.round(F.when(F.col("rate_1") > 0, F.try_divide("rate_2", "rate_1")), 3).alias("ratio"))


@query
def wear_trend(p):
    return p.wear


@query
def fleet_selftest(p):
    return condition.fleet(p.judged, p.cond, p.policy)


@query
def fleet_series(p):
    """Each station's days: readings that are trended and the verdicts of the day."""
    return condition.day_series(p.judged, p.policy)


# ---- findings and extent --------------------------------------------------
@query
def f_unassigned_mode(p):
    return findings.unassigned_modes(p.cov, p.ncr_mart)


@query
def f_declared_silent(p):
    return findings.declared_silent(p.cov)


@query
def f_no_backstop(p):
    return findings.no_backstop(p.econ).join(p.observed.groupBy("mode").agg(F.sum("detections").alias("detections")), "mode", "left")


@query
def f_late_first_look(p):
    return findings.late_first_look(p.cov)


@query
def f_position_driver(p):
    seen = p.observed.filter(F.col("mode") == P.COMMON_MODE).agg(F.sum("detections").alias("detections"))
    return findings.position_driver(coverage.sensitivity(p.swept), p.econ).join(F.broadcast(seen), F.lit(True))  # one row each


@query
def f_coverage_lost(p):
    return p.lost


@query
def f_coverage_lost_card(p):
    """Stations that lost coverage, beside what their scorecard says and who is to react."""
    card = spc.scorecard(p.looks, p.policy).select("station_id", "fpy_overall", "violations", "cpk_recent", "status")
    named = p.lost.withColumn("check_name", findings.check_of_cause(policy=p.policy))
    plans = findings.reaction_plans(named, p.dim("dim_reaction")).select("station_id", "modes_lost", "longest_run", "first_day_below", "check_name", "owner", "escalate_days")
    return plans.join(card, "station_id", "left")


@query
def f_transient(p):
    return findings.transient(p.cond)


@query
def f_trending(p):
    return findings.trending(p.wear, p.policy["trend_days"]).select("station_id", "measure", "units_to_limit", "days_to_limit", "accelerating")


@query
def f_selective(p):
    return findings.selective_finding(condition.selective(p.cond_swept)).select("e1_holds", "e1_of", "e2_holds", "e2_of", "severity")


@query
def findings_union(p):
    return p.findings


@query
def check_for_cause(p):
    return p.cond.select("station_id", "mode", "cause", findings.check_of_cause(policy=p.policy).alias("check_name"))


@query
def reaction_plan(p):
    plans = findings.reaction_plans(p.cond_findings, p.dim("dim_reaction"))
    return plans.select("finding_id", "station_id", "check_name", "owner", "escalate_days", F.size("containment").alias("steps"), F.element_at("containment", 1).alias("first_step"))


@query
def asset_peers(p):
    return findings.asset_peers(p.cond_findings, p.dim("dim_asset"), p.dim("dim_propagation"))


@query
def limit_fraction(p):
    return p.fractions


@query
def peer_rank(p):
    return findings.peer_rank(p.fractions).select("check_name", "place", "station_id", "state")


@query
def finding_peers(p):
    """For each finding on a station: all other stations on the same check, the worst first."""
    return findings.ranked_peers(p.cond_findings, p.fractions)


@query
def look_across_scope(p):
    """Findings on stations with their extent and the units made since they began."""
    scope = findings.containment(p.cond, p.selftest_mart)
    return p.extent.filter("station_id <> '-'").select("finding_id", "station_id", "mode", "verdict", "n_affected").join(scope, "station_id", "left")


@query
def look_across_rows(p):
    """Findings on stations, one row each: what carries them, their peers in order, who is next, and what to contain."""
    shared = findings.asset_peers(p.cond_findings, p.dim("dim_asset"), p.dim("dim_propagation"))
    rows = findings.scoped_findings(shared, findings.ranked_peers(p.cond_findings, p.fractions), findings.containment(p.cond, p.selftest_mart))
    ranked = F.array_join(F.transform("peers", lambda x: F.concat_ws(":", x["station_id"], x["state"])), " ")
    exposed = F.array_join(F.transform(F.filter("peers", lambda x: x["exposed"]), lambda x: x["station_id"]), " ")
    return rows.select(
        "finding_id", "station_id", "mode", "check_name", "kind", "asset_id", "n_peers", ranked.alias("ranked"), exposed.alias("exposed"),
        F.col("next_up.station_id").alias("next_station"), F.col("next_up.state").alias("next_state"), F.col("next_up.fraction").alias("next_fraction"), "from_day", "to_day", "units",
    )


@query
def containment_units(p):
    return findings.containment(p.cond, p.selftest_mart)


@query
def look_across(p):
    return p.extent


@query
def verdict_counts(p):
    return p.extent.groupBy("verdict").agg(F.count("*").alias("findings"))


@query
def report_foldback(p):
    return findings.fold_back(p.findings, p.extent)


# ---- feeds ----------------------------------------------------------------
def _feed(p: Plant) -> DataFrame:
    """The events as a feed of files."""
    path = tables.scratch_path(p.spark, "feed")
    p.raw.write.parquet(path)
    return stream.read_stream(p.spark, path, tables.EVENT_SCHEMA)


def _updated(p: Plant, result: DataFrame) -> DataFrame:
    return stream.run_updated(result, tables.scratch_path(p.spark, "feed-rows"), ["station_id", "start"])


DELAY = "3 days"


def _deliveries(p: Plant, rows: DataFrame, late_every: int = 0, parts: int = 6, days_late: Column | None = None) -> list[DataFrame]:
    """The rows in the order in which files of them arrive: by equal spans of days.
    Of ``late_every`` ids one comes two deliveries late; a row may be ``days_late``."""
    span = rows.agg(F.min(F.to_date("ts")).alias("_from"), F.max(F.to_date("ts")).alias("_to"))
    width = F.ceil((F.datediff("_to", "_from") + 1) / parts)
    late = F.when(F.right("event_id", F.lit(2)).cast("int") % late_every == 0, 2).otherwise(0) if late_every else F.lit(0)
    placed = rows.join(F.broadcast(span), F.lit(True)).withColumn("_part", F.floor((F.datediff("ts", "_from") + (F.lit(0) if days_late is None else days_late)) / width) + late)  # one row
    path = tables.scratch_path(p.spark, "deliveries")
    placed.drop("_from", "_to").write.partitionBy("_part").parquet(path)
    return [tables.optional_source(p.spark, f"{path}/_part={i}", tables.EVENT_SCHEMA) for i in range(parts + 2)]


def _over_deliveries(p: Plant, deliveries: list[DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream to its end after each delivery; it goes on where it stopped."""
    path = tables.scratch_path(p.spark, "feed")
    out = None
    for rows in deliveries:
        rows.write.mode("append").parquet(path)
        out = run(stream.read_stream(p.spark, path, tables.EVENT_SCHEMA))
    return out


@query
def stream_dedupe(p):
    path = tables.scratch_path(p.spark, "feed-rows")
    return _over_deliveries(p, _deliveries(p, p.raw), lambda feed: stream.run_appended(stream.dedupe(feed, DELAY).select("event_id", "station_id"), path))


@query
def stream_late_rows(p):
    """Rows that come behind the watermark, counted by the stream itself."""
    path = tables.scratch_path(p.spark, "feed-rows")
    with stream.ProgressTable(p.spark, f"{path}/progress", ["late-rows"]) as seen:
        kept = _over_deliveries(p, _deliveries(p, p.raw, 40), lambda feed: stream.run_appended(stream.dedupe(feed, DELAY).select("event_id"), path, "late-rows"))
    sums = seen.rows().agg(F.sum("input_rows").alias("input_rows"), F.sum("dropped_rows").alias("dropped_rows"))
    return sums.join(F.broadcast(kept.agg(F.count("*").alias("kept_rows"))), F.lit(True))  # one row each


@query
def stream_daily_fpy(p):
    return _updated(p, stream.daily_fpy(_feed(p), DELAY))


@query
def stream_shift_fpy(p):
    return _updated(p, stream.shift_fpy(_feed(p), DELAY))


@query
def stream_phase2(p):
    """Limits are frozen on the first days and stored; then the feed arrives in
    deliveries, and its later days, each id once, are judged as it runs."""
    root, path = tables.scratch_path(p.spark, "limits"), tables.scratch_path(p.spark, "judged-days")
    stream.freeze_limits(p.daily, root, p.policy)
    judged = _over_deliveries(p, _deliveries(p, p.events), lambda feed: stream.run_phase2(feed, root, path, p.policy, DELAY))
    return judged.select(*DAY, "ucl", "lcl", "out_of_control")


@query
def stream_frozen_gauge(p):
    """On first looks of two digits, each id once, in one trigger."""
    path = tables.scratch_path(p.spark, "gauge")
    p.looks.withColumn("feature_dim_mm", F.round("feature_dim_mm", 1)).write.parquet(path)
    return stream.run_held_readings(stream.read_stream(p.spark, path, tables.EVENT_SCHEMA), tables.scratch_path(p.spark, "gauge-rows"))


@query
def stream_held_in_order(p):
    """The same in order of event time, where rows come up to two days late, so that neighbours
    arrive in different triggers; what lies within the delay is not judged yet."""
    rows = p.looks.withColumn("feature_dim_mm", F.round("feature_dim_mm", 1))
    path = tables.scratch_path(p.spark, "held-rows")
    arrive = _deliveries(p, rows, parts=3, days_late=F.pmod(F.xxhash64("event_id"), F.lit(3)))
    return _over_deliveries(p, arrive, lambda feed: keyed.run_held_in_order(feed, path, DELAY, 86_400))
