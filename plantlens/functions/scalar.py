"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT_START_HOUR = 6


def failed(result: str = "vision_result") -> Column:
    return (F.col(result) == "FAIL").cast("int")


def canonical_serial(c: Column) -> Column:
    """Upper case, without the SN- prefix, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.upper(c), "^SN-", ""))


def production_day(ts: Column) -> Column:
    """The date on which the shift of ``ts`` started."""
    return F.to_date(ts - F.expr(f"INTERVAL {SHIFT_START_HOUR} HOURS"))


def shift_code(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "C").when(h < 14, "A").when(h < 22, "B").otherwise("C")


def shift_key(day: Column, code: Column) -> Column:
    return F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), code)


def sql_round(c: Column, digits: int = 3) -> Column:
    """Half away from zero."""
    return F.round(c, digits)


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def in_spec_range(c: Column, lsl: float, usl: float, margin: float) -> Column:
    """Physically possible readings; false for null."""
    return F.coalesce(c.between(lsl - margin, usl + margin), F.lit(False))
