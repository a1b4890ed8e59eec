"""The marts of one plant, each a lazy DataFrame built once from the sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens import policy as P
from plantlens.operators import condition, coverage, findings, integrate, quality, spc
from plantlens.sources.adapters import extract
from plantlens.sources.tables import manifests, open_mart, publish_mart, scratch_path


class Plant:
    """``sources`` are landed extracts by name (``landed`` reads a folder of
    them); what is not among them is derived from the events table of ``sf_dir``.
    ``dims`` are policy tables by name (``policy.read_dims`` reads a folder of
    them) in place of those of the built-in policy; scalar limits, rules and sweeps
    among them are compiled (``policy``). ``stored`` are marts by name that an
    earlier run published (``stored_marts``): they are read, not derived again.
    Tables of the policy that are joined are broadcast, so their size is checked."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, sources: Mapping[str, DataFrame] | None = None, dims: Mapping[str, DataFrame] | None = None, stored: Mapping[str, DataFrame] | None = None
    ):
        self.spark, self.sf_dir = spark, sf_dir
        self.sources, self.own_dims, self.stored = dict(sources or {}), dict(dims or {}), dict(stored or {})
        for name, df in self.own_dims.items():
            if name not in P.COMPILED:
                P.bounded_rows(df, name)
        self.policy = P.compile_policy(self.own_dims)

    def source(self, name: str) -> DataFrame:
        return self.sources[name] if name in self.sources else extract(self.spark, self.sf_dir, name)

    def dim(self, name: str) -> DataFrame:
        return self.own_dims[name] if name in self.own_dims else P.dim(self.spark, name)

    def mart(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is written once and read by all that follows, so that its
        sources are read once; or the stored one of that name."""
        if name in self.stored:
            return self.stored[name]
        df, path = make(), scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def observed_mart(self) -> DataFrame:
        return self.mart("observed", lambda: self.observed)

    @cached_property
    def ncr_mart(self) -> DataFrame:
        return self.mart("ncr", lambda: self.ncr)

    @cached_property
    def selftest_mart(self) -> DataFrame:
        return self.mart("selftest", lambda: self.selftest)

    @cached_property
    def scorecard_mart(self) -> DataFrame:
        return self.mart("scorecard", lambda: spc.scorecard(self.looks, self.policy))

    @cached_property
    def keyed_mart(self) -> DataFrame:
        return self.mart("keyed", lambda: self.keyed)

    @cached_property
    def erp_mart(self) -> DataFrame:
        return self.mart("erp", lambda: self.erp)

    @cached_property
    def mes_mart(self) -> DataFrame:
        return self.mart("mes", lambda: self.mes)

    @cached_property
    def qms_mart(self) -> DataFrame:
        return self.mart("qms", lambda: self.qms)

    @cached_property
    def fact_of_marts(self) -> DataFrame:
        """The fact over conformed tables that are written once: every extract is
        scanned once, however many counts follow."""
        return integrate.join_all(self.keyed_mart, self.erp_mart, self.mes_mart, self.qms_mart)

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        return {k: self.dim(k) for k in P.DIMS}

    @cached_property
    def raw(self) -> DataFrame:
        return self.source("inspections")

    @cached_property
    def events(self) -> DataFrame:
        return spc.dedupe_first(self.raw)

    @cached_property
    def looks(self) -> DataFrame:
        return spc.first_pass(self.events)

    @cached_property
    def daily(self) -> DataFrame:
        return spc.daily_fpy(self.looks)

    @cached_property
    def erp(self) -> DataFrame:
        return integrate.conform_erp(self.source("erp_work_orders"), self.dims)

    @cached_property
    def mes(self) -> DataFrame:
        return integrate.conform_mes(self.source("mes_shift_log"), self.dims)

    @cached_property
    def qms(self) -> DataFrame:
        return integrate.conform_qms(self.source("qms_ncr"), self.dims)

    @cached_property
    def keyed(self) -> DataFrame:
        return integrate.with_keys(self.looks)

    @cached_property
    def fact(self) -> DataFrame:
        return integrate.join_all(self.keyed, self.erp, self.mes, self.qms)

    @cached_property
    def reconciled(self) -> DataFrame:
        return integrate.reconcile(self.keyed, self.mes, self.policy["tolerance_pct"])

    @cached_property
    def observed(self) -> DataFrame:
        return coverage.observed_modes(self.looks)

    @cached_property
    def ncr(self) -> DataFrame:
        return coverage.ncr_by_mode(self.source("qms_ncr"), self.dim("dim_category"))

    @cached_property
    def cov(self) -> DataFrame:
        return coverage.coverage_states(self.observed_mart, self.dim("dim_position"), self.dim("dim_assignment"), self.dim("dim_mode").toDF("mode", "label", "feature_ref", "basis"))

    @cached_property
    def points(self) -> DataFrame:
        return coverage.discovery_points(self.dim("dim_position"), self.dim("dim_assignment"), self.dim("dim_final"))

    @cached_property
    def econ(self) -> DataFrame:
        return coverage.economics(self.points, self.policy)

    @cached_property
    def swept(self) -> DataFrame:
        return coverage.cost_sweep(self.points, coverage.sweep(self.spark, self.policy.sweep("cost")), self.policy)

    @cached_property
    def selftest(self) -> DataFrame:
        return self.source("station_selftest")

    @cached_property
    def judged(self) -> DataFrame:
        return condition.verdicts(condition.with_policy_limits(self.selftest_mart, self.policy), self.policy)

    def conditions(self, judged: DataFrame) -> DataFrame:
        return condition.station_condition(judged, self.dim("dim_assignment"), self.dim("dim_mode"), self.dim("dim_gate"), self.policy)

    @cached_property
    def cond(self) -> DataFrame:
        return self.conditions(self.judged)

    @cached_property
    def cond_swept(self) -> DataFrame:
        combos = coverage.sweep(self.spark, self.policy.sweep("selftest"))
        every = self.selftest_mart.join(F.broadcast(combos), F.lit(True))  # the sweep of the policy
        return self.conditions(condition.verdicts(every, self.policy))

    @cached_property
    def wear_long(self) -> DataFrame:
        return condition.unpivot_wear(self.selftest_mart, self.dim("dim_measure"), self.policy)

    @cached_property
    def wear(self) -> DataFrame:
        return condition.wear_trend(self.wear_long, self.policy)

    @cached_property
    def fractions(self) -> DataFrame:
        return findings.limit_fractions(condition.latest_rows(self.selftest_mart), self.policy)

    @cached_property
    def lost(self) -> DataFrame:
        return findings.coverage_lost(self.cond, self.cov, self.econ)

    @cached_property
    def plan_findings(self) -> DataFrame:
        kind = lambda df, k: df.select(F.lit(k).alias("finding_id"), "mode")
        return (
            kind(findings.unassigned_modes(self.cov, self.ncr_mart), "UNASSIGNED_MODE")
            .unionByName(kind(findings.declared_silent(self.cov), "DECLARED_SILENT"))
            .unionByName(kind(findings.late_first_look(self.cov), "LATE_FIRST_LOOK"))
        )

    @cached_property
    def cond_findings(self) -> DataFrame:
        lost = self.lost.select(F.lit("CONDITION_COVERAGE_LOST").alias("finding_id"), "station_id", F.col("modes_lost").alias("mode"), findings.check_of_cause(policy=self.policy).alias("check_name"))
        trend = findings.trending(self.wear, self.policy["trend_days"]).select(F.lit("TOOLING_TRENDING_TO_LIMIT").alias("finding_id"), "station_id", F.lit("-").alias("mode"), F.col("tooling_set").alias("check_name"))
        return lost.unionByName(trend)

    @cached_property
    def extent(self) -> DataFrame:
        stations = self.selftest_mart.agg(F.countDistinct("station_id").alias("n_stations"))
        return findings.look_across(self.cov, self.cond_findings, self.plan_findings, stations, self.dim("dim_asset"), self.dim("dim_propagation"))

    @cached_property
    def findings(self) -> DataFrame:
        """All kinds of finding in one table."""
        f = findings
        lit = F.lit

        def rows(df: DataFrame, kind: str, severity, station=None, mode=None, evidence=None) -> DataFrame:
            return df.select(lit(kind).alias("finding_id"), (lit(severity) if isinstance(severity, str) else severity).alias("severity"), (lit("-") if station is None else station).alias("station_id"), (lit("-") if mode is None else mode).alias("mode"), evidence.cast("long").alias("evidence"))

        c = F.col
        sel = f.selective_finding(condition.selective(self.cond_swept))
        sens = coverage.sensitivity(self.swept)
        parts = [
            rows(f.unassigned_modes(self.cov, self.ncr_mart), "UNASSIGNED_MODE", "high", mode=c("mode"), evidence=c("detections")),
            rows(f.declared_silent(self.cov), "DECLARED_SILENT", "open_question", mode=c("mode"), evidence=c("stations")),
            rows(f.no_backstop(self.econ), "NO_BACKSTOP", "high", mode=c("mode"), evidence=c("position")),
            rows(f.late_first_look(self.cov), "LATE_FIRST_LOOK", "medium", mode=c("mode"), evidence=c("first_position")),
            rows(f.position_driver(sens, self.econ), "POSITION_IS_NOT_THE_DRIVER", "insight", mode=lit(P.COMMON_MODE), evidence=c("c2_holds")),
            rows(self.lost, "CONDITION_COVERAGE_LOST", "high", c("station_id"), c("modes_lost"), c("longest_run")),
            rows(f.transient(self.cond), "CONDITION_TRANSIENT", "watch", c("station_id"), None, c("longest_run")),
            rows(f.trending(self.wear, self.policy["trend_days"]), "TOOLING_TRENDING_TO_LIMIT", "watch", c("station_id"), None, c("days_to_limit")),
            rows(sel, "CONDITION_LOSS_IS_SELECTIVE", c("severity"), None, None, c("e1_holds")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


#: marts that findings are built from, with the stage that publishes each
MARTS = {"observed": "coverage", "ncr": "coverage", "selftest": "selftest", "scorecard": "core"}


def publish_marts(plant: Plant, root: str) -> dict[str, dict]:
    """Publishes a version of every mart that findings are built from."""
    return {name: publish_mart(getattr(plant, f"{name}_mart"), root, name, stage) for name, stage in MARTS.items()}


def stored_marts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The last complete version of each mart that a folder holds."""
    return {name: open_mart(spark, root, name) for name in MARTS if manifests(spark, root, name)}
