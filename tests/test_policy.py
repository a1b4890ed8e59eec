"""Policies read from tables, rejected rows, and definitions by hand."""

import datetime as dt

import pytest

from plantlens import policy as P
from plantlens.operators import condition, coverage, findings, integrate, quality, spc
from plantlens.plans.marts import Plant
from plantlens.sources import tables
from tests.test_quality_and_joins import event

DAY = dt.datetime(2025, 5, 5, 8)


def dim(spark, name, rows):
    return spark.createDataFrame(rows, P.DIMS[name][0])


@pytest.fixture(scope="module")
def other(spark):
    """A plant with narrower limits, its own rules, one tooling set and one sweep."""
    return {
        "dim_setting": dim(spark, "dim_setting", [("lsl", 9.0), ("usl", 11.0), ("cpk_min", 2.0), ("physical_margin_mm", 1.0), ("baseline_days", 2.0), ("alert_days", 1.0), ("rework_fraction", 0.5), ("fixed_handling", 1.0), ("grade_min", 3.0)]),
        "dim_rule": dim(
            spark, "dim_rule",
            [("need part", "required", "part_number", None, None, None, None, None), ("known line", "allowed", "line_id", ["L1"], None, None, None, None), ("not slow", "range", "cycle_time_s", None, None, 50.0, None, None), ("code on fail", "present_when", "defect_code", None, None, None, "vision_result", "FAIL")],
        ),
        "dim_measure": dim(spark, "dim_measure", [("nest", "nest_wear_mm", 0.5, True, "Nest wear")]),
        "dim_sweep": dim(spark, "dim_sweep", [("cost", "rework_fraction", None, 0.1), ("cost", "rework_fraction", None, 0.9), ("selftest", "nest", "nest_wear_mm", 0.2)]),
    }


def test_built_in_policy_is_the_plan():
    assert (P.BUILT_IN["lsl"], P.BUILT_IN.days("baseline_days"), P.BUILT_IN.tooling_sets) == (24.8, 21, ["fixture", "eoat"])
    assert len(P.BUILT_IN.rules) == 11 and P.BUILT_IN.sweep("selftest")["locator"] == [0.1, 0.15, 0.2]


def test_other_rules_give_other_violations(spark, other):
    policy = P.compile_policy(other)
    rows = [
        event(0, ts=DAY, line_id="L1", cycle_time_s=10.0, vision_result="PASS"),
        event(1, ts=DAY, line_id="L2", cycle_time_s=51.0, vision_result="PASS", defect_code="X"),
        event(2, ts=DAY, line_id="L1", cycle_time_s=50.0, vision_result="FAIL", defect_code=None, part_number="\t  "),
        event(2, ts=DAY, line_id="L1", cycle_time_s=None, vision_result="FAIL", defect_code="X"),
    ]
    df = spark.createDataFrame(rows, tables.EVENT_SCHEMA)
    want = [("E1", "known line"), ("E1", "not slow"), ("E2", "code on fail"), ("E2", "need part")]
    assert sorted(map(tuple, quality.all_violations(df, policy).collect())) == want
    clean, found, report = quality.validate(df, policy)
    assert sorted(map(tuple, found.collect())) == want
    (r,) = report.collect()
    assert (r.n_rows, r.clean_rows, r.offending, r.violations, r.dq_score) == (4, 3, 2, 4, 0.5)
    assert clean.columns == df.columns and clean.count() == 3


def test_judged_keys_equal_the_plain_rules(spark, sf_dir):
    p = Plant(spark, sf_dir)
    rows = p.raw.unionByName(p.raw.limit(3).selectExpr("* except (event_id)", "cast(null as string) as event_id").select(p.raw.columns))
    _, found, report = quality.validate(rows)
    assert sorted(map(str, found.collect())) == sorted(map(str, quality.all_violations(rows).collect()))
    assert sorted(map(tuple, quality.rule_counts(quality.judged_keys(rows)).collect())) == sorted(map(tuple, quality.by_rule(quality.all_violations(rows)).collect()))
    assert report.collect()[0].n_rows == rows.count()


def test_other_limits_give_other_verdicts(spark, other):
    policy = P.compile_policy(other)
    rows = [event(i, ts=DAY + dt.timedelta(days=i % 4), line_id="L1", station_id="X1", feature_dim_mm=10.0 + 0.1 * (i % 3) + (40 if i == 7 else 0)) for i in range(12)]
    looks = spark.createDataFrame(rows, tables.EVENT_SCHEMA)
    assert spc.capability(looks, policy).collect()[0].readings == 11
    assert spc.capability(looks).count() == 0  # the built-in plan takes none of them
    assert spc.scorecard(looks, policy).collect()[0].status == "OK"
    strict = P.compile_policy({**other, "dim_setting": dim(spark, "dim_setting", [("lsl", 9.9), ("usl", 10.3), ("cpk_min", 2.0), ("physical_margin_mm", 1.0)])})
    assert spc.scorecard(looks, strict).collect()[0].status == "ALERT"


def test_side_of_the_nearer_limit(spark):
    rows = [event(i, ts=DAY + dt.timedelta(days=i), station_id="X1", feature_dim_mm=25.15 - 0.001 * i) for i in range(30)]
    (r,) = spc.dim_trend(spark.createDataFrame(rows, tables.EVENT_SCHEMA)).collect()
    assert r.drift < 0 and r.side == "upper"


def test_recent_profile_by_hand(spark):
    """The window ends with the last valid reading; daily rates count alike."""
    rows = [event(i, ts=DAY + dt.timedelta(days=i), station_id="X1", feature_dim_mm=25.0 + i / 100, vision_result="FAIL" if i == 0 else "PASS") for i in range(3)]
    rows += [event(9, ts=DAY + dt.timedelta(days=60), station_id="X1", feature_dim_mm=-999.0, vision_result="FAIL")]
    events = spark.createDataFrame(rows, tables.EVENT_SCHEMA)
    (r,) = spc.recent_profile(events, spc.daily_fpy(spc.first_pass(events))).collect()
    assert (round(r.recent_mean, 4), round(r.recent_sd, 4), r.recent_rate) == (25.01, 0.01, 0.5)


def selftest(spark, days):
    """station, day, grade and nest wear."""
    rows = [(s, d, 100.0, 1.0, g, 0.0, 0.0, w, 10 * i, "L1") for i, (s, d, g, w) in enumerate(days)]
    return spark.createDataFrame(rows, "station_id string, production_day string, ref_brightness_pct double, ref_sharpness_score double, datamatrix_grade double, ref_bias_mm double, ref_repeatability_mm double, nest_wear_mm double, units_processed long, line_id string")


def test_other_tooling_sets_and_swept_limits(spark, other):
    policy = P.compile_policy(other)
    rows = selftest(spark, [("X1", "d1", 3.0, 0.1), ("X1", "d2", 2.9, 0.3), ("X1", "d3", 3.5, 0.6)])
    judged = condition.verdicts(condition.with_policy_limits(rows, policy), policy)
    assert [(r.imaging_ok, r.nest_ok, r.selftest_ok) for r in judged.orderBy("production_day").collect()] == [(True, True, True), (False, True, False), (True, False, False)]
    swept = condition.verdicts(rows.crossJoin(coverage.sweep(spark, policy.sweep("selftest"))), policy)
    assert [r.nest_ok for r in swept.orderBy("production_day").collect()] == [True, False, False]
    modes = dim(spark, "dim_mode", [("BENT", "Bent", "F1", "geometry")])
    cond = condition.station_condition(judged, dim(spark, "dim_assignment", [("X1", "BENT")]), modes, dim(spark, "dim_gate", [("tooling", "geometry")]), policy)
    (r,) = condition.fleet(judged, cond, policy).collect()
    assert (r.worst, r.cause, r.sets_out, r.days_out, r.first_out, r.tooling_ok, r.imaging_ok, r.modes_lost) == ("ALERT", "tooling/nest", "nest", 1, "d3", False, True, "BENT")
    assert [x.check_name for x in cond.select(findings.check_of_cause(policy=policy).alias("check_name")).collect()] == ["nest"]
    assert {x.check_name: x.state for x in findings.limit_fractions(condition.latest_rows(rows), policy).collect()}["nest"] == "BREACHED"


def test_fleet_takes_the_worst_run_and_its_cause(spark):
    """A mode lost for long and another whose tooling failed for a day: the sets are those of the first."""
    cond = spark.createDataFrame(
        [("X1", "A", "imaging", 4, "d1", "ALERT", False), ("X1", "B", "tooling/fixture", 1, "d2", "WATCH", True), ("X2", "A", "-", 0, None, "OK", True)],
        "station_id string, mode string, cause string, longest_run long, first_day_below string, condition string, effective boolean",
    )
    judged = spark.createDataFrame([("X1", "d1", False, True, True), ("X1", "d2", True, True, False), ("X2", "d1", True, True, True)], "station_id string, production_day string, imaging_ok boolean, measurement_ok boolean, tooling_ok boolean")
    got = {r.station_id: (r.days, r.worst, r.sets_out, r.days_out, r.first_out, r.imaging_ok, r.tooling_ok, r.modes_lost) for r in condition.fleet(judged, cond).collect()}
    assert got == {"X1": (2, "ALERT", "", 4, "d1", True, False, "A"), "X2": (1, "OK", "", 0, None, True, True, "")}


def test_other_costs(spark, other):
    policy = P.compile_policy(other)
    points = spark.createDataFrame([("L1", "X1", 1, "BENT", 2.0, "customer", "CUSTOMER", None)], "line_id string, station_id string, position long, mode string, value_vu double, found_kind string, found_at string, next_value double")
    assert coverage.economics(points, policy).collect()[0].false_reject_cost_vu == 2.0
    swept = coverage.cost_sweep(points, coverage.sweep(spark, policy.sweep("cost")), policy)
    assert sorted(round(r.fr, 3) for r in swept.collect()) == [1.2, 2.8]


def test_policy_tables_are_checked(spark, other):
    with pytest.raises(ValueError):
        P.compile_policy({"dim_setting": dim(spark, "dim_setting", [("no such limit", 1.0)])})
    with pytest.raises(ValueError):
        P.compile_policy({"dim_setting": dim(spark, "dim_setting", [("lsl", None)])})
    with pytest.raises(ValueError):
        P.compile_policy({"dim_rule": dim(spark, "dim_rule", [("r", "odd kind", "c", None, None, None, None, None)])})
    with pytest.raises(ValueError):
        Plant(spark, "/none", dims={"dim_line": spark.range(P.MOST_ROWS + 1).selectExpr("cast(id as string) source_key", "'x' canonical")})


DIMS = {"dim_line": [("LN", "L1")], "dim_item": [("77", "PN")], "dim_work_center": [("CELL", "X1")], "dim_category": [("FORM", "BENT")]}


def test_rejected_rows_go_to_quarantine(spark, tmp_path):
    dims = {k: dim(spark, k, v) for k, v in DIMS.items()}
    rows = [("W1", "77", "LN", "05/05/2025", "05/06/2025", "8"), ("W2", "77", "??", "2025-05-05", "soon", "x"), ("W3", None, "LN", "", None, None), ("W4", "78", "LN", "13/45/2025", "05/06/2025", "1")]
    erp = spark.createDataFrame(rows, "WORK_ORDER_NO string, ITEM_NO string, PROD_LINE string, SCHED_START_DT string, SCHED_END_DT string, QTY_ORDERED string")
    clean, rejects = integrate.quarantine(erp, "erp_work_orders", dims, str(tmp_path / "erp"))
    assert sorted(r.WORK_ORDER_NO for r in clean.collect()) == ["W1", "W3"] and clean.columns == erp.columns
    got = {r.WORK_ORDER_NO: sorted(r.reasons) for r in rejects.collect()}
    assert got == {"W2": ["code:PROD_LINE", "date:SCHED_END_DT", "date:SCHED_START_DT", "number:QTY_ORDERED"], "W4": ["code:ITEM_NO", "date:SCHED_START_DT"]}
    counts = {r.reason: r.rows for r in integrate.reject_counts(rejects, "erp_work_orders").collect()}
    assert counts["date:SCHED_START_DT"] == 2 and sum(counts.values()) == 6
    conformed = integrate.conform_erp(erp, dims).collect()  # dirty dates stop no job
    assert sum(r.sched_start is None for r in conformed) == 3


def test_severity_opened_date_and_downtime(spark):
    dims = {k: dim(spark, k, v) for k, v in DIMS.items()}
    qms = spark.createDataFrame([("N1", "sn-1", "FORM", "2", "SCRAP", "05/07/2025")], "NCR_NO string, SERIAL_NO string, DEFECT_CATEGORY string, SEVERITY string, DISPOSITION string, OPENED_DT string")
    (r,) = integrate.conform_qms(qms, dims).collect()
    assert (r.severity, r.opened_date, r.defect_code_qms) == ("2", dt.date(2025, 5, 7), "BENT")
    (r,) = integrate.conform_qms(qms.drop("SEVERITY", "OPENED_DT"), dims).collect()
    assert (r.severity, r.opened_date) == (None, None)
    mes = spark.createDataFrame([("S-A", "CELL", "A", DAY, DAY, "7", 5, "12")], "shift_id string, work_center string, shift_code string, shift_start_ts timestamp_ntz, shift_end_ts timestamp_ntz, wo_no string, units_completed long, downtime_min string")
    (r,) = integrate.conform_mes(mes, dims).collect()
    assert (r.downtime_min, r.units_started, r.mes_work_order_no) == (12, None, "WO-7")


def test_crosswalk_report_has_the_line(spark, sf_dir):
    p = Plant(spark, sf_dir)
    assert {r.key for r in integrate.crosswalk_coverage(p.erp, p.mes, p.qms).collect()} == {"line", "item_no", "work_center", "defect_category"}
    kinds = {r.kind for r in integrate.orphan_register(p.fact, p.qms, p.keyed).select("kind").distinct().collect()}
    assert "event_no_serial" in kinds and kinds <= {"event_without_work_order", "event_without_mes_shift", "event_no_serial", "ncr_without_inspection_event"}


def test_integrity_scans_each_extract_once(spark, sf_dir, monkeypatch):
    from plantlens import queries

    asked = []
    real = Plant.source
    monkeypatch.setattr(Plant, "source", lambda self, name: asked.append(name) or real(self, name))
    df = queries.QUERIES["integrity_report"](spark, sf_dir)
    assert sorted(asked) == ["erp_work_orders", "inspections", "mes_shift_log", "qms_ncr"]
    assert "events.parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_scoped_findings_nest_their_peers(spark):
    """Peers go by severity, then nearness to the limit, then name; sharing the asset is told apart from being near."""
    shared = spark.createDataFrame(
        [("F", "S1", "-", "fixture", "cell", "C1", "S3;S4", 2), ("F", "S2", "-", "other", "cell", "C2", "", 0)],
        "finding_id string, station_id string, mode string, check_name string, kind string, asset_id string, peer_stations string, n_peers long",
    )
    fractions = spark.createDataFrame([("S1", "fixture", 2.0, "BREACHED"), ("S2", "fixture", 0.7, "APPROACHING"), ("S3", "fixture", 0.1, "OK"), ("S4", "fixture", 0.7, "APPROACHING")], "station_id string, check_name string, fraction double, state string")
    scope = spark.createDataFrame([("S1", "2025-05-01", "2025-05-09", 40)], "station_id string, from_day string, to_day string, units long")
    rows = {r.station_id: r for r in findings.scoped_findings(shared, findings.ranked_peers(shared, fractions), scope).collect()}
    assert [tuple(x) for x in rows["S1"].peers] == [(1, "S2", "APPROACHING", 0.7, False), (2, "S4", "APPROACHING", 0.7, True), (3, "S3", "OK", 0.1, True)]
    assert rows["S1"].next_up.station_id == "S2" and rows["S1"].units == 40
    assert rows["S2"].peers == [] and rows["S2"].next_up is None and rows["S2"].units is None
