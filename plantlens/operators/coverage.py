"""Does the inspection plan cover what happens, and what does an error cost?

Policy tables are joined to event-grain results by key; a sweep of assumptions
is a table of combinations joined to them, not a loop of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P


def observed_modes(looks: DataFrame) -> DataFrame:
    return looks.filter((F.col("vision_result") == "FAIL") & F.col("defect_code").isNotNull()).groupBy("station_id", F.col("defect_code").alias("mode")).agg(F.count("*").alias("detections"))


def ncr_by_mode(qms: DataFrame, categories: DataFrame) -> DataFrame:
    """NCRs by mode; categories without a mode are counted by themselves. The
    category is trimmed and upper-cased before the lookup."""
    named = qms.withColumn("category", F.upper(F.trim("DEFECT_CATEGORY")))
    mapped = named.join(F.broadcast(categories), named["category"] == F.col("source_key"), "left")  # policy-sized
    return mapped.groupBy(F.col("canonical").alias("mode"), F.when(F.col("canonical").isNull(), F.col("category")).alias("unmapped_category")).agg(F.count("*").alias("ncrs"))


def coverage_states(observed: DataFrame, position: DataFrame, assignment: DataFrame, modes: DataFrame) -> DataFrame:
    """One row for each station and mode, of the plan or seen."""
    seen = modes.select("mode").union(observed.select("mode")).distinct()
    stations = position.agg(F.collect_list(F.struct("line_id", "station_id", "position")).alias("at"))
    # one row of the policy's stations; what modes the data hold is not bounded
    grid = seen.join(F.broadcast(stations), F.lit(True)).select("mode", F.explode("at").alias("at")).select("at.*", "mode")
    n = F.coalesce("detections", F.lit(0))
    declared = F.coalesce("declared", F.lit(False))
    state = F.when(declared & (n > 0), "COVERED").when(declared, "DECLARED_SILENT").when(n > 0, "UNDECLARED_DETECTED").otherwise("NOT_APPLICABLE")
    return (
        grid.join(assignment.withColumn("declared", F.lit(True)), ["station_id", "mode"], "left")
        .join(observed, ["station_id", "mode"], "left")
        .join(modes.select("mode", F.col("feature_ref").isNotNull().alias("specified")), "mode", "left")
        .select("line_id", "station_id", "position", "mode", declared.alias("declared"), n.alias("detections"), state.alias("state"), F.coalesce("specified", F.lit(False)).alias("specified"))
    )


def discovery_points(position: DataFrame, assignment: DataFrame, final: DataFrame) -> DataFrame:
    """Where a unit with a mode is caught if a station lets it pass: the first
    later station of the line that looks for it, else final test, else nobody."""
    here = position.join(assignment, "station_id").select("line_id", "station_id", "position", "mode", "value_vu")
    later = here.select("line_id", "mode", F.col("station_id").alias("next_station"), F.col("position").alias("next_position"), F.col("value_vu").alias("next_value"))
    after = here.join(later, ["line_id", "mode"], "left").withColumn("ok", F.col("next_position") > F.col("position"))
    nxt = F.min(F.when(F.col("ok"), F.struct("next_position", "next_station", "next_value")))
    got = after.groupBy("line_id", "station_id", "position", "mode", "value_vu").agg(nxt.alias("nx"))
    tested = got.join(final.withColumn("at_final", F.lit(True)), "mode", "left")
    kind = F.when(F.col("nx").isNotNull(), "station").when(F.col("at_final"), "final_test").otherwise("customer")
    where = F.coalesce("nx.next_station", F.when(F.col("at_final"), "FINAL-TEST").otherwise("CUSTOMER"))
    return tested.select("line_id", "station_id", "position", "mode", "value_vu", kind.alias("found_kind"), where.alias("found_at"), F.col("nx.next_value").alias("next_value"))


def false_reject_cost(policy: P.Policy = P.BUILT_IN, fraction: Column | None = None, handling: Column | None = None) -> Column:
    return F.col("value_vu") * (F.lit(policy["rework_fraction"]) if fraction is None else fraction) + (F.lit(policy["fixed_handling"]) if handling is None else handling)


def escape_cost(policy: P.Policy = P.BUILT_IN, final_penalty: Column | None = None, customer_penalty: Column | None = None) -> Column:
    fp = F.lit(policy["final_penalty"]) if final_penalty is None else final_penalty
    cp = F.lit(policy["customer_penalty"]) if customer_penalty is None else customer_penalty
    final = F.lit(policy["value_at_final"] * policy["teardown"])
    return F.when(F.col("found_kind") == "station", F.col("next_value") * policy["teardown"]).when(F.col("found_kind") == "final_test", final + fp).otherwise(final + cp)


def economics(points: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    fr, esc = false_reject_cost(policy), escape_cost(policy)
    return points.select(
        "line_id", "station_id", "position", "mode", F.round(fr, 4).alias("false_reject_cost_vu"), F.round(esc, 4).alias("escape_cost_vu"),
        "found_at", "found_kind", F.round(esc / fr, 3).alias("exchange_rate"), (F.col("found_kind") != "customer").alias("backstop"),
    )


def sweep(spark: SparkSession, ranges: dict[str, list[float]]) -> DataFrame:
    """One row for each combination, with combo_id."""
    out = spark.range(1).drop("id")
    for name, values in ranges.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out.withColumn("combo_id", F.concat_ws("|", *ranges))


def cost_sweep(points: DataFrame, combos: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """Costs and rate of each station and mode under each combination. A cost that the
    sweep leaves out is the policy's."""
    swept = lambda c: F.col(c) if c in combos.columns else None
    every = points.join(F.broadcast(combos), F.lit(True))  # the sweep of the policy
    fr = false_reject_cost(policy, swept("rework_fraction"), swept("fixed_handling"))
    return every.select("combo_id", "line_id", "station_id", "position", "mode", fr.alias("fr"), (escape_cost(policy, swept("final_penalty"), swept("customer_penalty")) / fr).alias("rate"))


def monotone(swept: DataFrame, mode: str = P.COMMON_MODE) -> DataFrame:
    """Per combination and line: do costs strictly rise, rates strictly fall?"""
    order = W.partitionBy("combo_id", "line_id").orderBy("position")
    steps = swept.filter(F.col("mode") == mode).withColumn("up", F.col("fr") > F.lag("fr").over(order)).withColumn("down", F.col("rate") < F.lag("rate").over(order))
    return steps.groupBy("combo_id", "line_id").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("c1"), F.coalesce(F.bool_and("down"), F.lit(True)).alias("c2"))


def sensitivity(swept: DataFrame) -> DataFrame:
    per = monotone(swept).groupBy("combo_id").agg(F.bool_and("c1").alias("c1"), F.bool_and("c2").alias("c2"))
    n = lambda c: F.sum(F.col(c).cast("long"))
    return per.agg(F.count("*").alias("combos"), n("c1").alias("c1_holds"), n("c2").alias("c2_holds"), (n("c1") == F.count("*")).alias("c1_robust"), (n("c2") == F.count("*")).alias("c2_robust"))


def mode_labels(df: DataFrame, modes: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds mode_label, 'Label (CODE)' or the code, and basis_name."""
    named = modes.join(bases, "basis", "left").select("mode", "label", "basis_name")
    return df.join(F.broadcast(named), "mode", "left").withColumn("mode_label", F.coalesce(F.format_string("%s (%s)", "label", "mode"), "mode")).drop("label")  # policy-sized


def mode_gaps(cov: DataFrame) -> DataFrame:
    """Modes seen but not declared, declared but not seen, declared without a
    specification, and both declared and seen: kind, mode."""
    seen, declared, specified = (cov.filter(c).select("mode").distinct() for c in ("detections > 0", "declared", "specified"))
    kinds = {"observed_not_declared": seen.subtract(declared), "declared_not_observed": declared.subtract(seen), "declared_not_specified": declared.subtract(specified), "declared_and_observed": declared.intersect(seen)}
    out = None
    for k, df in kinds.items():
        df = df.select(F.lit(k).alias("kind"), "mode")
        out = df if out is None else out.unionByName(df)
    return out


def coverage_kpis(cov: DataFrame, econ: DataFrame) -> DataFrame:
    declared, seen = F.col("declared"), F.col("detections") > 0
    sets = cov.agg(
        F.sum(declared.cast("long")).alias("declared_cells"),
        F.sum((F.col("state") == "COVERED").cast("long")).alias("covered_cells"),
        F.collect_set(F.when(declared, F.col("mode"))).alias("d"),
        F.collect_set(F.when(seen, F.col("mode"))).alias("o"),
        F.collect_set(F.when(F.col("specified"), F.col("mode"))).alias("s"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    rates = econ.agg(F.min("exchange_rate").alias("rate_min"), F.max("exchange_rate").alias("rate_max"))
    return sets.join(F.broadcast(rates), F.lit(True)).select(  # one row each
        "declared_cells", "covered_cells", F.round(F.try_divide(F.col("covered_cells").cast("double"), F.col("declared_cells").cast("double")), 4).alias("coverage_rate"),
        joined(F.array_except("o", "d")).alias("observed_not_declared"), joined(F.array_except("d", "o")).alias("declared_not_observed"),
        joined(F.array_except("d", "s")).alias("declared_not_specified"), joined(F.array_intersect("d", "o")).alias("declared_and_observed"), "rate_min", "rate_max",
    )


def effective_coverage(cond: DataFrame) -> DataFrame:
    """Declared pairs of station and mode, those that the station's condition
    leaves, their share, and the modes and stations that lose some."""
    lost = ~F.col("effective")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(lost, F.col(c)))), ",")
    left = F.sum(F.col("effective").cast("long"))
    return cond.agg(
        F.count("*").alias("declared_pairs"), F.coalesce(left, F.lit(0)).alias("effective_pairs"), F.round(F.try_divide(left.cast("double"), F.count("*").cast("double")), 4).alias("effective_rate"),
        names("mode").alias("modes_losing"), names("station_id").alias("stations_losing"),
    )


def event_costs(looks: DataFrame, econ: DataFrame) -> DataFrame:
    """Exposure of first-look fails by line, mode and day."""
    fails = looks.filter((F.col("vision_result") == "FAIL") & F.col("defect_code").isNotNull()).groupBy("station_id", F.col("defect_code").alias("mode"), F.to_date("ts").alias("d")).agg(F.count("*").alias("fails"))
    return fails.join(econ, ["station_id", "mode"]).groupBy("line_id", "mode", "d").agg(
        F.sum("fails").alias("fails"), F.sum(F.col("fails") * F.col("false_reject_cost_vu")).alias("false_reject_vu"), F.sum(F.col("fails") * F.col("escape_cost_vu")).alias("escape_vu")
    )
