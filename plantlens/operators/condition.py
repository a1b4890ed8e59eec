"""Can each station still see what it was assigned to see?

Self-test rows are judged against limits that are columns, so one plan serves
the policy's limits and every combination of a sweep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P

def with_policy_limits(selftest: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    return selftest.withColumns({k: F.lit(v) for k, v in policy.selftest_limits.items()}).withColumn("combo_id", F.lit("policy"))


def verdicts(rows: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """imaging_ok, measurement_ok, one for each tooling set, tooling_ok and
    selftest_ok; a value on its limit passes, a null fails. Limits that rows do not
    carry as columns are the policy's."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    limit = lambda name, own: c(name) if name in rows.columns else F.lit(own)
    own = policy.selftest_limits
    bright = c("ref_brightness_pct").between(policy["brightness_min"], policy["brightness_max"])
    out = rows.withColumn("imaging_ok", ok(bright & (c("ref_sharpness_score") >= limit("sharpness", own["sharpness"])) & (c("datamatrix_grade") >= limit("grade", own["grade"]))))
    out = out.withColumn("measurement_ok", ok((c("ref_bias_mm") <= limit("bias", own["bias"])) & (c("ref_repeatability_mm") <= policy["repeatability_max"])))
    tooling = F.lit(True)
    for s in policy.tooling_sets:
        cond = F.lit(True)
        for m in (m for m in policy.measures if m.tooling_set == s):
            cond = cond & (c(m.measure) <= limit(policy.swept_limits.get(m.measure, ""), m.limit_mm))
        out = out.withColumn(f"{s}_ok", ok(cond))
        tooling = tooling & c(f"{s}_ok")
    return out.withColumn("tooling_ok", tooling).withColumn("selftest_ok", c("imaging_ok") & c("measurement_ok") & tooling)


def failing_sets(judged: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(~F.col(f"{s}_ok"), F.lit(s)) for s in policy.tooling_sets]))
    return judged.withColumn("failing_sets", F.array_join(names, ","))


def gates(modes: DataFrame, gate: DataFrame) -> DataFrame:
    """mode and one flag a check that must pass for its inspection."""
    per = modes.join(gate, "basis").groupBy("mode", "basis")
    return per.agg(*[F.max(F.col("check_name") == k).alias(f"needs_{k}") for k in ("imaging", "measurement", "tooling")])


def longest_run(flags: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Longest run of true flags over consecutive records, by islands: within a
    run, the record's number less its number among the true ones is constant."""
    w = W.partitionBy(*keys).orderBy(order)
    hits = flags.withColumn("_rn", F.row_number().over(w)).filter(flag)
    island = F.col("_rn") - F.row_number().over(W.partitionBy(*keys).orderBy("_rn"))
    return hits.withColumn("_i", island).groupBy(*keys, "_i").agg(F.count("*").alias("run")).groupBy(*keys).agg(F.max("run").alias("longest_run"))


def station_condition(judged: DataFrame, assignment: DataFrame, modes: DataFrame, gate: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """Per combination, station and declared mode: days below, longest run,
    first day, cause over all days, condition, and the last day's readings."""
    need = gates(modes, gate)
    keys = ["combo_id", "station_id", "mode"]
    per_mode = judged.join(F.broadcast(assignment.join(need, "mode")), "station_id")  # policy-sized
    bad = lambda k: F.col(f"needs_{k}") & ~F.col(f"{k}_ok")
    flagged = per_mode.withColumn("bad", bad("imaging") | bad("measurement") | bad("tooling"))
    ever = lambda k, ok: F.when(F.max(F.col(f"needs_{k}") & ~F.col(ok)), F.lit(f"tooling/{ok[:-3]}" if k == "tooling" else k))
    cause = F.concat_ws(" + ", ever("imaging", "imaging_ok"), ever("measurement", "measurement_ok"), *[ever("tooling", f"{s}_ok") for s in policy.tooling_sets])
    per = flagged.groupBy(*keys, "basis", "line_id").agg(
        F.sum(F.col("bad").cast("long")).alias("days_below"),
        F.min(F.when(F.col("bad"), F.col("production_day"))).alias("first_day_below"),
        cause.alias("cause"),
        *[F.max_by(c, "production_day").alias(c) for c in ("datamatrix_grade", "ref_sharpness_score", "ref_repeatability_mm", "locator_wear_mm") if c in judged.columns],
    )
    run = F.coalesce("longest_run", F.lit(0))
    condition = F.when(run >= policy["alert_days"], "ALERT").when(run >= 1, "WATCH").otherwise("OK")
    out = per.join(longest_run(flagged, keys, "production_day", "bad"), keys, "left")
    return out.withColumn("longest_run", run).withColumn("cause", F.when(F.col("cause") == "", "-").otherwise(F.col("cause"))).withColumn("condition", condition).withColumn("effective", F.col("condition") != "ALERT")


def selective(conditions: DataFrame) -> DataFrame:
    """Over all combinations: does a failed imaging check cost appearance only
    (E1), a mechanical one geometry only (E2)? Combinations in which nothing
    fails are excluded and counted."""
    img, mech = F.col("cause").contains("imaging"), F.col("cause").rlike("measurement|tooling")
    look, geo = F.col("basis").startswith("appearance"), F.col("basis") == "geometry"
    alert = F.col("condition") == "ALERT"
    some = lambda c: F.max(alert & c)
    per = conditions.groupBy("combo_id").agg(
        some(img).alias("e1_on"), (some(img & look) & ~some(img & geo)).alias("e1"), some(mech).alias("e2_on"), (some(mech & geo) & ~some(mech & look)).alias("e2")
    )
    n = lambda c: F.sum(c.cast("long"))
    out = [F.count("*").alias("combos")]
    for e in ("e1", "e2"):
        on, hold = n(F.col(f"{e}_on")), n(F.col(f"{e}_on") & F.col(e))
        out += [hold.alias(f"{e}_holds"), on.alias(f"{e}_of"), (F.count("*") - on).alias(f"{e}_vacuous"), ((on > 0) & (hold == on)).alias(f"{e}_robust")]
    return per.agg(*out)


def unpivot_wear(selftest: DataFrame, measures: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """One row for each trended measure of a station-day."""
    names = policy.trended
    long = selftest.unpivot(["station_id", "production_day", "units_processed"], names, "measure", "wear")
    return long.join(F.broadcast(measures.filter("trended")), "measure")  # policy-sized


def wear_rates(long: DataFrame) -> DataFrame:
    """Slopes over all days and over each half, per station and measure."""
    keys = ["station_id", "tooling_set", "measure", "measure_name", "limit_mm"]
    w = W.partitionBy("station_id", "measure")
    ranked = long.withColumn("rn", F.row_number().over(w.orderBy("production_day"))).withColumn("cnt", F.count("*").over(w))
    first = F.col("rn") <= F.floor(F.col("cnt") / 2)
    y, x = F.col("wear"), F.col("units_processed").cast("double")
    slope = lambda c: F.regr_slope(F.when(c, y), F.when(c, x))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.regr_slope(y, x).alias("rate"),
        slope(first).alias("rate_1"),
        slope(~first).alias("rate_2"),
        F.max_by("wear", "production_day").alias("latest"),
        F.min_by("wear", "production_day").alias("earliest"),
        (F.max("units_processed") - F.min("units_processed")).alias("units"),
    )


def wear_trend(long: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """Straight extrapolation of wear to its limit, where a trend was seen."""
    r = wear_rates(long).filter(F.col("points") >= policy["min_points"])
    rise, left = F.col("latest") - F.col("earliest"), F.col("limit_mm") - F.col("latest")
    trend = F.coalesce((rise >= policy["min_rise"] * F.col("limit_mm")) & (F.col("rate") > 1e-12), F.lit(False))
    accel = F.when(F.col("rate_1") > 0, F.try_divide("rate_2", "rate_1"))
    to_limit = F.when(trend & (left > 0), F.try_divide(left, F.col("rate")))
    per_day = F.try_divide(F.col("units").cast("double"), (F.col("points") - 1).cast("double"))
    return r.select(
        "station_id", "tooling_set", "measure", "measure_name", F.round("latest", 5).alias("latest_mm"), "limit_mm", F.round(left, 5).alias("margin_mm"), (F.col("latest") <= F.col("limit_mm")).alias("within_limit"),
        F.round(F.col("rate") * 1000, 5).alias("rate_per_1k"), trend.alias("trend"), F.round(accel, 2).alias("acceleration"), F.coalesce(trend & (accel >= policy["acceleration"]), F.lit(False)).alias("accelerating"),
        F.round(to_limit, 0).cast("long").alias("units_to_limit"), F.round(F.try_divide(to_limit, per_day), 0).cast("long").alias("days_to_limit"), F.lit(P.PROJECTION_LABEL).alias("projection_label"),
    )


def latest_rows(selftest: DataFrame) -> DataFrame:
    rest = [c for c in selftest.columns if c != "station_id"]
    return selftest.groupBy("station_id").agg(F.max(F.struct("production_day", *[c for c in rest if c != "production_day"])).alias("r")).select("station_id", "r.*")


def day_series(judged: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """One row a station, day and trended measure: its value, and whether the
    day passed each step."""
    names = ["datamatrix_grade", "ref_repeatability_mm", *policy.trended]
    steps = ["imaging_ok", "measurement_ok", "tooling_ok"]
    return judged.unpivot(["station_id", "production_day", *steps], names, "measure", "value").withColumn("value", F.round("value", 5))


def fleet(judged: DataFrame, cond: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """Per station: the worst condition by severity; of the mode with the longest
    run (the first by name of several) its run, first day, cause and the tooling sets
    of that cause; whether the last day passed each step; and the modes lost."""
    rank = F.when(F.col("condition") == "ALERT", 3).when(F.col("condition") == "WATCH", 2).otherwise(1)
    names = F.element_at(F.array(F.lit("OK"), F.lit("WATCH"), F.lit("ALERT")), F.max(rank))
    worst = F.max_by(F.struct("cause", "longest_run", "first_day_below"), F.struct("longest_run", (-F.col("_place")).alias("p")))
    placed = cond.withColumn("_place", F.row_number().over(W.partitionBy("station_id").orderBy("mode")))  # the modes of a station's plan
    lost = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("effective"), F.col("mode")))), ";")
    per = placed.groupBy("station_id").agg(names.alias("worst"), worst.alias("w"), lost.alias("modes_lost"))
    steps = ["imaging_ok", "measurement_ok", "tooling_ok"]
    days = judged.groupBy("station_id").agg(F.count("*").alias("days"), *[F.max_by(c, "production_day").alias(c) for c in steps])
    sets = F.array_join(F.array_compact(F.array(*[F.when(F.col("w.cause").contains(f"tooling/{s}"), s) for s in policy.tooling_sets])), ",")
    return days.join(per, "station_id").select(
        "station_id", "days", "worst", F.col("w.cause").alias("cause"), sets.alias("sets_out"), F.col("w.longest_run").alias("days_out"), F.col("w.first_day_below").alias("first_out"), *steps, "modes_lost"
    )
