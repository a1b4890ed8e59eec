"""Policy: what the plan asks of stations, and small dimension tables of it.

Each dimension is a list of rows with a schema; it becomes a DataFrame for joins
(``dim``) or a list of SQL values (``values_sql``). All of them are a few rows
for each station, defect mode or measure of the policy.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: control plan -------------------------------------------
LSL, USL, CPK_MIN = 24.8, 25.2, 1.33
PHYSICAL_MARGIN_MM = 5.0
SIGMA, ROLLING_DAYS, BASELINE_DAYS, RECENT_DAYS = 3, 7, 21, 14
REQUIRED = ["event_id", "ts", "station_id", "serial_number", "vision_result"]
ALLOWED = {"vision_result": ["PASS", "FAIL"]}
RANGES = {"feature_dim_mm": (20.0, 30.0), "cycle_time_s": (1.0, 600.0)}
MODES = [
    ("DIM-OOS", "Dimensional out of spec", "F1", "geometry"),
    ("SLD-BRDG", "Solder bridging", None, "appearance_high_contrast"),
    ("CMP-MISS", "Missing component", None, "appearance_high_contrast"),
    ("SRF-SCR", "Surface scratch", None, "appearance_low_contrast"),
    ("LBL-ERR", "Label / marking error", None, "appearance_high_contrast"),
    ("SEAL-GAP", "Seal gap at bond line", None, "appearance_low_contrast"),
]
BASIS_NAMES = {"geometry": "dimensional measurement", "appearance_high_contrast": "high-contrast visual", "appearance_low_contrast": "low-contrast visual"}
DETECTS = {1: ["DIM-OOS"], 2: ["DIM-OOS", "SLD-BRDG", "CMP-MISS"], 3: ["DIM-OOS", "SLD-BRDG", "CMP-MISS", "SRF-SCR", "SEAL-GAP"]}
FINAL_TEST = ["DIM-OOS", "CMP-MISS", "SEAL-GAP"]
# ---- fixed values: lines and costs ----------------------------------------
LINES = {"LINE-A": ["S1", "S2", "S3"], "LINE-B": ["S4", "S5", "S6"], "LINE-C": ["S7", "S8", "S9"]}
VALUE_AT = {1: 1.0, 2: 2.6, 3: 4.2}
VALUE_AT_FINAL = 6.0
REWORK_FRACTION, FIXED_HANDLING = 0.35, 0.20
TEARDOWN, FINAL_PENALTY, CUSTOMER_PENALTY = 1.0, 1.5, 12.0
COST_SWEEP = {"rework_fraction": [0.15, 0.35, 0.60], "fixed_handling": [0.05, 0.20, 0.50], "final_penalty": [0.5, 1.5, 3.0], "customer_penalty": [3.0, 12.0, 40.0]}
COMMON_MODE = "DIM-OOS"
# ---- fixed values: crosswalk ----------------------------------------------
LINE_KEYS = {"LN_A": "LINE-A", "LN_B": "LINE-B", "LN_C": "LINE-C"}
WORK_CENTERS = {f"WC-0{i}": f"S{i}" for i in range(1, 10)}
ITEMS = {"1000-C": "PN-1000"}
CATEGORIES = {"SOLDER": "SLD-BRDG", "MISSING COMPONENT": "CMP-MISS", "SURFACE FINISH": "SRF-SCR", "DIMENSIONAL": "DIM-OOS", "LABELING": "LBL-ERR"}
TOLERANCE_PCT = 5.0
# ---- fixed values: self-test ----------------------------------------------
BRIGHTNESS = (92.0, 108.0)
SHARPNESS_MIN, GRADE_MIN, BIAS_MAX, REPEATABILITY_MAX = 0.85, 2.0, 0.010, 0.015
#: tooling set, measure, greatest value, trended, name
TOOLING = [
    ("fixture", "locator_wear_mm", 0.150, True, "Locator wear"),
    ("fixture", "clamp_offset_mm", 0.080, False, "Clamp position offset"),
    ("eoat", "gripper_pad_wear_mm", 0.250, True, "Gripper pad wear"),
    ("eoat", "tcp_offset_mm", 0.120, True, "Tool centre point offset"),
    ("eoat", "jaw_parallelism_mm", 0.060, False, "Jaw parallelism"),
]
GATES = [
    ("imaging", "appearance_high_contrast"),
    ("imaging", "appearance_low_contrast"),
    ("measurement", "geometry"),
    ("tooling", "geometry"),
]
MIN_POINTS, MIN_RISE, ACCELERATION, TREND_DAYS = 20, 0.05, 1.25, 120
ALERT_DAYS, APPROACHING = 3, 0.60
SELFTEST_SWEEP = {"grade": [1.5, 2.0, 2.5], "sharpness": [0.80, 0.85, 0.90], "bias": [0.006, 0.010, 0.015], "locator": [0.100, 0.150, 0.200]}
ASSETS = {1: ("1", "ILL-100", "FIX-STD-A"), 2: ("1", "ILL-100", "FIX-STD-A"), 3: ("2", "ILL-220", "FIX-STD-B")}
PROPAGATES = {"imaging": "illuminator", "measurement": "robot", "fixture": "fixture_design", "eoat": "robot"}
#: check, owner, days until escalation, what to contain first
REACTIONS = [
    ("imaging", "Manufacturing Engineering", 1, ["Treat the affected visual inspections at this station as UNVERIFIED, not as passing", "Hold units processed since the first failed self-test"]),
    ("measurement", "Manufacturing Engineering", 1, ["Treat dimensional results from this station as UNVERIFIED", "Quarantine units measured since the first failed self-test"]),
    ("fixture", "Maintenance / Tooling", 3, ["Stop releasing dimensional results from this cell until the fixture is verified"]),
    ("eoat", "Controls / Robotics", 2, ["Stop releasing dimensional results from this cell until the gripper is verified"]),
    ("trend", "Maintenance / Tooling", 14, ["None required while the measurement remains inside its limit"]),
]
PROJECTION_LABEL = "Linear extrapolation of measured wear to the tolerance limit. Not a failure prediction."
# ---------------------------------------------------------------------------

POSITIONS = [(line, s, p, VALUE_AT[p]) for line, stations in LINES.items() for p, s in enumerate(stations, 1)]

#: scalar limits, counts of days and cost parameters, by name
SETTINGS = {
    "lsl": LSL, "usl": USL, "cpk_min": CPK_MIN, "physical_margin_mm": PHYSICAL_MARGIN_MM, "sigma": SIGMA, "rolling_days": ROLLING_DAYS, "baseline_days": BASELINE_DAYS, "recent_days": RECENT_DAYS,
    "drift_mm": 0.03, "tolerance_pct": TOLERANCE_PCT, "value_at_final": VALUE_AT_FINAL, "rework_fraction": REWORK_FRACTION, "fixed_handling": FIXED_HANDLING, "teardown": TEARDOWN,
    "final_penalty": FINAL_PENALTY, "customer_penalty": CUSTOMER_PENALTY, "brightness_min": BRIGHTNESS[0], "brightness_max": BRIGHTNESS[1], "sharpness_min": SHARPNESS_MIN, "grade_min": GRADE_MIN,
    "bias_max": BIAS_MAX, "repeatability_max": REPEATABILITY_MAX, "min_points": MIN_POINTS, "min_rise": MIN_RISE, "acceleration": ACCELERATION, "trend_days": TREND_DAYS, "alert_days": ALERT_DAYS, "approaching": APPROACHING,
}
#: rule, kind, column, allowed values, least and greatest value, and the column and value that it depends on
RULES = [
    *[(f"required:{c}", "required", c, None, None, None, None, None) for c in REQUIRED],
    ("unique:event_id", "unique", "event_id", None, None, None, None, None),
    *[(f"allowed:{c}", "allowed", c, v, None, None, None, None) for c, v in ALLOWED.items()],
    *[(f"range:{c}", "range", c, None, low, high, None, None) for c, (low, high) in RANGES.items()],
    ("consistency:C1", "absent_when", "defect_code", None, None, None, "vision_result", "PASS"),
    ("consistency:C2", "present_when", "defect_code", None, None, None, "vision_result", "FAIL"),
]
#: sweep, parameter, the tooling measure whose limit it is (else a setting of that sense), value
SWEEPS = [
    *[("cost", k, None, v) for k, values in COST_SWEEP.items() for v in values],
    *[("selftest", k, "locator_wear_mm" if k == "locator" else None, v) for k, values in SELFTEST_SWEEP.items() for v in values],
]
#: Rows of one policy table at the most; a longer one is no policy, and is refused before it is broadcast.
MOST_ROWS = 10_000

DIMS: dict[str, tuple[str, list[tuple]]] = {
    "dim_setting": ("name string, value double", [(k, float(v)) for k, v in SETTINGS.items()]),
    "dim_rule": ("rule string, kind string, column string, allowed array<string>, low double, high double, when_column string, when_value string", RULES),
    "dim_sweep": ("sweep string, parameter string, measure string, value double", SWEEPS),
    "dim_mode": ("mode string, label string, feature_ref string, basis string", MODES),
    "dim_position": ("line_id string, station_id string, position long, value_vu double", POSITIONS),
    "dim_assignment": ("station_id string, mode string", [(s, m) for _, s, p, _ in POSITIONS for m in DETECTS[p]]),
    "dim_final": ("mode string", [(m,) for m in FINAL_TEST]),
    "dim_line": ("source_key string, canonical string", [*LINE_KEYS.items()]),
    "dim_work_center": ("source_key string, canonical string", [*WORK_CENTERS.items()]),
    "dim_item": ("source_key string, canonical string", [*ITEMS.items()]),
    "dim_category": ("source_key string, canonical string", [*CATEGORIES.items()]),
    "dim_gate": ("check_name string, basis string", GATES),
    "dim_basis": ("basis string, basis_name string", [*BASIS_NAMES.items()]),
    "dim_measure": ("tooling_set string, measure string, limit_mm double, trended boolean, measure_name string", TOOLING),
    "dim_asset": (
        "station_id string, kind string, asset_id string",
        [(s, k, a) for line, s, p, _ in POSITIONS for k, a in zip(("robot", "illuminator", "fixture_design"), (f"ROB-{line[-1]}{ASSETS[p][0]}", *ASSETS[p][1:]))],
    ),
    "dim_propagation": ("check_name string, kind string", [*PROPAGATES.items()]),
    "dim_reaction": ("check_name string, owner string, escalate_days long, containment array<string>", REACTIONS),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = DIMS[name]
    return spark.createDataFrame(rows, schema)


def read_dims(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The policy tables that a folder holds as JSON lines, ``<name>.json``; the
    others stay those of the built-in policy. Read with their schema: a row
    that does not fit it is an error."""
    jvm = spark._jvm
    found = {}
    for name, (schema, _) in DIMS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}.json")
    return found


@dataclass(frozen=True)
class Rule:
    rule: str
    kind: str
    column: str
    allowed: list[str] | None = None
    low: float | None = None
    high: float | None = None
    when_column: str | None = None
    when_value: str | None = None


@dataclass(frozen=True)
class Measure:
    tooling_set: str
    measure: str
    limit_mm: float
    trended: bool
    measure_name: str


@dataclass(frozen=True)
class Policy:
    """What operators need on the driver to build one expression a pass: scalar
    settings (``policy["lsl"]``), rules, tooling measures and sweeps. Policy
    tables that are joined stay DataFrames."""

    settings: Mapping[str, float]
    rules: tuple[Rule, ...]
    measures: tuple[Measure, ...]
    sweeps: tuple[tuple[str, str, str | None, float], ...]

    def __getitem__(self, name: str) -> float:
        return self.settings[name]

    def days(self, name: str) -> int:
        return int(self.settings[name])

    def of_kind(self, *kinds: str) -> list[Rule]:
        return [r for r in self.rules if r.kind in kinds]

    @property
    def tooling_sets(self) -> list[str]:
        return list(dict.fromkeys(m.tooling_set for m in self.measures))

    @property
    def trended(self) -> list[str]:
        return [m.measure for m in self.measures if m.trended]

    def sweep(self, name: str) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {}
        for sweep, parameter, _, value in self.sweeps:
            if sweep == name:
                out.setdefault(parameter, []).append(value)
        return out

    @property
    def swept_limits(self) -> dict[str, str]:
        """Parameter of the self-test sweep by the measure whose limit it is."""
        return {measure: parameter for sweep, parameter, measure, _ in self.sweeps if sweep == "selftest" and measure}

    @property
    def selftest_limits(self) -> dict[str, float]:
        """The policy's own value of every swept self-test limit."""
        own = {"grade": self["grade_min"], "sharpness": self["sharpness_min"], "bias": self["bias_max"]}
        limits = {m.measure: m.limit_mm for m in self.measures}
        return own | {parameter: limits[measure] for measure, parameter in self.swept_limits.items() if measure in limits}


COMPILED = ("dim_setting", "dim_rule", "dim_measure", "dim_sweep")


def bounded_rows(df: DataFrame, name: str, most: int = MOST_ROWS) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} rows")
    return rows


def compile_policy(dims: Mapping[str, DataFrame] | None = None) -> Policy:
    """The policy of the given tables; those that are missing, and settings that
    dim_setting does not name, are those of the built-in one. A setting without a
    value, or of an unknown name, is an error."""
    rows = {name: [tuple(r) for r in bounded_rows(dims[name], name)] if dims and name in dims else DIMS[name][1] for name in COMPILED}
    settings = dict(DIMS["dim_setting"][1]) | dict(rows["dim_setting"])
    strange = [k for k, v in settings.items() if k not in SETTINGS or v is None]
    if strange:
        raise ValueError(f"settings without a sense or a value: {strange}")
    kinds = {"required", "unique", "allowed", "range", "absent_when", "present_when"}
    rules = tuple(Rule(*r) for r in rows["dim_rule"])
    if any(r.kind not in kinds for r in rules):
        raise ValueError(f"kinds of rules are {sorted(kinds)}")
    return Policy(settings, rules, tuple(Measure(*r) for r in rows["dim_measure"]), tuple(rows["dim_sweep"]))


BUILT_IN = compile_policy()


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"


def values_sql(name: str) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    schema, rows = DIMS[name]
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"
