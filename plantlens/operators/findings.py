"""Findings, and where else each one already exists.

A finding is a row (finding_id, severity, station_id, mode, evidence...); all
kinds are united into one table with null for what a kind does not carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P


def unassigned_modes(cov: DataFrame, ncr: DataFrame) -> DataFrame:
    """Modes that stations detect and no station is assigned to."""
    seen = cov.filter("state = 'UNDECLARED_DETECTED'").groupBy("mode").agg(F.countDistinct("station_id").alias("stations"), F.sum("detections").alias("detections"))
    counts = ncr.filter("mode is not null").groupBy("mode").agg(F.sum("ncrs").alias("ncrs"))
    return seen.join(cov.filter("declared").select("mode").distinct(), "mode", "left_anti").join(counts, "mode", "left").withColumn("ncrs", F.coalesce("ncrs", F.lit(0)))


def declared_silent(cov: DataFrame) -> DataFrame:
    per = cov.groupBy("mode").agg(F.sum("detections").alias("detections"), F.sum(F.col("declared").cast("long")).alias("stations"))
    return per.filter("detections = 0 and stations > 0").select("mode", "stations")


def no_backstop(econ: DataFrame) -> DataFrame:
    worst = F.max(F.struct("exchange_rate", "position", "station_id"))
    return econ.filter("not backstop").groupBy("mode").agg(worst.alias("w")).select("mode", "w.station_id", "w.position", "w.exchange_rate")


def late_first_look(cov: DataFrame) -> DataFrame:
    per = cov.groupBy("mode").agg(F.min(F.when(F.col("declared"), F.col("position"))).alias("first_position"), F.sum("detections").alias("detections"))
    return per.filter("first_position > 1 and detections > 0")


def position_driver(sens: DataFrame, econ: DataFrame, mode: str = P.COMMON_MODE) -> DataFrame:
    """The first line's walk, where rates do not always fall along the line."""
    first = econ.filter(F.col("mode") == mode)
    line = first.agg(F.min("line_id").alias("line_id"))
    walk = first.join(F.broadcast(line), "line_id").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("position", "station_id", "exchange_rate"))).alias("steps"))
    text = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["station_id"], s["exchange_rate"].cast("decimal(12,3)"))), " ")
    return walk.join(F.broadcast(sens.filter("not c2_robust")), F.lit(True)).select("line_id", text.alias("walk"), "c1_holds", "c2_holds", "combos")  # one row each


def coverage_lost(cond: DataFrame, cov: DataFrame, econ: DataFrame) -> DataFrame:
    """Per station on alert: the modes it has lost, the worst of them, those
    without a backstop and those never detected there."""
    open_ = econ.filter("not backstop").select("mode").distinct().withColumn("open", F.lit(True))
    lost = cond.filter("condition = 'ALERT'").join(open_, "mode", "left").join(cov.select("station_id", "mode", "detections"), ["station_id", "mode"], "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    worst = F.max_by("cause", F.struct("longest_run", "mode"))
    return lost.groupBy("station_id").agg(
        names(F.col("mode")).alias("modes_lost"), F.max("longest_run").alias("longest_run"), worst.alias("cause"), F.min("first_day_below").alias("first_day_below"),
        names(F.when(F.col("open"), F.col("mode"))).alias("exposed"), names(F.when(F.coalesce("detections", F.lit(0)) == 0, F.col("mode"))).alias("never_detected"),
    )


def transient(cond: DataFrame) -> DataFrame:
    watch = cond.filter("condition = 'WATCH'").groupBy("station_id").agg(F.max("longest_run").alias("longest_run"), F.max("days_below").alias("days_below"))
    return watch.join(cond.filter("condition = 'ALERT'").select("station_id").distinct(), "station_id", "left_anti")


def trending(wear: DataFrame, days: float = P.BUILT_IN["trend_days"]) -> DataFrame:
    return wear.filter(F.col("trend") & F.col("within_limit") & (F.col("days_to_limit") <= days))


def selective_finding(sel: DataFrame) -> DataFrame:
    return sel.withColumn("severity", F.when(F.col("e1_robust"), "insight").otherwise("open_question"))


def check_of_cause(cause: str = "cause", policy: P.Policy = P.BUILT_IN):
    """The most specific attribution wins: a tooling set, the last of the policy's
    first, then imaging, then measurement."""
    c = F.col(cause)
    found = F.lit(None).cast("string")
    for s in policy.tooling_sets:
        found = F.when(c.contains(f"tooling/{s}"), s).otherwise(found)
    return F.coalesce(found, F.when(c.contains("imaging"), "imaging").otherwise("measurement"))


def reaction_plans(df: DataFrame, reactions: DataFrame, check: str = "check_name") -> DataFrame:
    """Adds the owner, days until escalation and what to contain."""
    return df.join(F.broadcast(reactions.withColumnRenamed("check_name", check)), check, "left")  # policy-sized


def asset_peers(df: DataFrame, assets: DataFrame, propagation: DataFrame) -> DataFrame:
    """For (station_id, check_name): kind and id of the asset that carries the
    fault, and the other stations that share it."""
    mine = df.join(propagation, "check_name").join(assets, ["station_id", "kind"], "left")
    other = assets.select(F.col("station_id").alias("peer"), "kind", "asset_id")
    keys = [c for c in mine.columns]
    both = mine.join(other, ["kind", "asset_id"], "left").withColumn("peer", F.when(F.col("peer") != F.col("station_id"), F.col("peer")))
    return both.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("peer")), ";").alias("peer_stations"), F.countDistinct("peer").alias("n_peers"))


def limit_fractions(latest: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """How near each station is to the limit of each check's first trended
    measure: BREACHED, APPROACHING from the policy's fraction on, or OK."""
    spec = {"imaging": ("datamatrix_grade", policy["grade_min"], False), "measurement": ("ref_repeatability_mm", policy["repeatability_max"], True)}
    for m in policy.measures:
        if m.trended:
            spec.setdefault(m.tooling_set, (m.measure, m.limit_mm, True))
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(m).alias("value"), F.lit(limit).alias("limit_value"), F.lit(above).alias("above_bad")) for k, (m, limit, above) in spec.items()])
    long = latest.select("station_id", F.explode(rows).alias("x")).select("station_id", "x.*")
    v, limit = F.col("value"), F.col("limit_value")
    frac = F.when(F.col("above_bad"), F.try_divide(v, limit)).otherwise(F.try_divide(limit, v))
    breached = F.when(F.col("above_bad"), v > limit).otherwise(v < limit)
    state = F.when(breached, "BREACHED").when(frac >= policy["approaching"], "APPROACHING").otherwise("OK")
    return long.select("station_id", "check_name", F.round("value", 5).alias("value"), "limit_value", F.round(frac, 3).alias("fraction"), state.alias("state"))


def peer_rank(fractions: DataFrame) -> DataFrame:
    severity = F.when(F.col("state") == "BREACHED", 0).when(F.col("state") == "APPROACHING", 1).otherwise(2)
    return fractions.withColumn("place", F.row_number().over(W.partitionBy("check_name").orderBy(severity, F.desc("fraction"), "station_id")))


def ranked_peers(found: DataFrame, fractions: DataFrame) -> DataFrame:
    """The other stations on the check of each finding, in order of how near
    they are to its limit: finding_id, station_id, check_name, place, peer, state, fraction."""
    others = fractions.select("check_name", F.col("station_id").alias("peer"), "state", "fraction")
    both = found.select("finding_id", "station_id", "check_name").join(others, "check_name").filter(F.col("peer") != F.col("station_id"))
    severity = F.when(F.col("state") == "BREACHED", 0).when(F.col("state") == "APPROACHING", 1).otherwise(2)
    order = W.partitionBy("finding_id", "station_id", "check_name").orderBy(severity, F.desc("fraction"), "peer")
    return both.withColumn("place", F.row_number().over(order))


def scoped_findings(shared: DataFrame, ranked: DataFrame, scope: DataFrame) -> DataFrame:
    """One row a finding on a station, with all that is needed to act on it: the asset
    that carries the fault (``shared``, as asset_peers), ``peers``, the other stations on
    the same check (place, station_id, state, fraction, exposed) with the worst first,
    ``next_up``, the first of them that is not OK, and the window and units of ``scope``.
    A peer is exposed if it shares the asset. Findings on a check that nobody
    trends have no peers; those without a window have nulls there."""
    key = ["finding_id", "station_id", "check_name"]
    with_asset = ranked.join(shared.select(*key, F.split("peer_stations", ";").alias("_shared")), key)
    exposed = F.coalesce(F.array_contains("_shared", F.col("peer")), F.lit(False))
    peer = F.struct("place", F.col("peer").alias("station_id"), "state", "fraction", exposed.alias("exposed"))
    nested = with_asset.groupBy(*key).agg(F.array_sort(F.collect_list(peer)).alias("peers"))  # a plant's stations at the most
    out = shared.join(nested, key, "left").join(scope, "station_id", "left")
    none = F.array().cast("array<struct<place:int,station_id:string,state:string,fraction:double,exposed:boolean>>")
    return out.withColumn("peers", F.coalesce("peers", none)).withColumn("next_up", F.get(F.filter("peers", lambda x: x["state"] != "OK"), F.lit(0)))


def containment(cond: DataFrame, selftest: DataFrame) -> DataFrame:
    """Units made since a station's first day below, of its first declared mode
    that is not OK."""
    first = cond.filter("condition <> 'OK'").groupBy("station_id").agg(F.min_by("first_day_below", "mode").alias("first_out"))
    days = selftest.join(first, "station_id").filter(F.col("production_day") >= F.col("first_out"))
    return days.groupBy("station_id").agg(
        F.min("production_day").alias("from_day"), F.max("production_day").alias("to_day"), (F.max_by("units_processed", "production_day") - F.min_by("units_processed", "production_day")).alias("units")
    )


def look_across(cov: DataFrame, cond_findings: DataFrame, plan_findings: DataFrame, stations: DataFrame, assets: DataFrame, propagation: DataFrame) -> DataFrame:
    """The extent of each finding: SYSTEMIC at all stations, SHARED_ASSET at
    several, else LOCAL.

    plan_findings: finding_id, mode; cond_findings: finding_id, station_id,
    mode, check_name; stations: one row with n_stations."""
    seen = F.when(F.col("finding_id") == "UNASSIGNED_MODE", F.col("state") == "UNDECLARED_DETECTED").otherwise(F.col("declared"))
    at = plan_findings.join(cov.select("mode", "station_id", "state", "declared"), "mode").filter(seen)
    plan = at.groupBy("finding_id", "mode").agg(F.countDistinct("station_id").alias("n_affected"), F.array_join(F.array_sort(F.collect_set("station_id")), ";").alias("peer_stations"))
    plan = plan.join(F.broadcast(stations), F.lit(True))  # one row
    verdict = F.when(F.col("n_affected") >= F.col("n_stations"), "SYSTEMIC").when(F.col("n_affected") > 1, "SHARED_ASSET").otherwise("LOCAL")
    plan = plan.select("finding_id", F.lit("-").alias("station_id"), "mode", verdict.alias("verdict"), F.lit("control plan").alias("kind"), F.lit("-").alias("asset_id"), "peer_stations", "n_affected")
    peers = asset_peers(cond_findings, assets, propagation)
    cond = peers.select("finding_id", "station_id", "mode", F.when(F.col("n_peers") > 0, "SHARED_ASSET").otherwise("LOCAL").alias("verdict"), "kind", "asset_id", "peer_stations", (F.col("n_peers") + 1).alias("n_affected"))
    return plan.unionByName(cond)


def fold_back(findings: DataFrame, extent: DataFrame) -> DataFrame:
    """Each finding with the verdict of its key; of several the first in order."""
    keys = ["finding_id", "station_id", "mode"]
    first = extent.groupBy(*keys).agg(F.min(F.struct("verdict", "peer_stations", "n_affected")).alias("v"))
    return findings.join(first, keys, "left").select(*findings.columns, "v.verdict", "v.peer_stations", "v.n_affected")
