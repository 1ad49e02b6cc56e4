"""Risk scores, decisions and keys of findings as column expressions, in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MATURITY = {"none": 0.0, "poc": 0.4, "functional": 0.7, "weaponized": 0.9, "in_the_wild": 1.0}
REACH = {"affected": 1.0, "unknown": 0.3, "not_affected": 0.0}
CRITICALITY = {"crown_jewel": 1.5, "high": 1.2, "normal": 0.9, "low": 0.5}
SLA_HOURS = {"ACT": 48, "ATTEND": 336, "TRACK": 720, "DEFER": 2160}


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def lookup(col: Column, table: dict[str, float], default: float | None = None) -> Column:
    out = F.lit(None).cast("float") if default is None else f32(default)
    for k, v in table.items():
        out = F.when(col == k, f32(v)).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, f32(low)), f32(high))


def exposure_factor(internet_facing: Column, compensating: Column) -> Column:
    e = F.when(internet_facing, f32(1.4)).otherwise(f32(0.8))
    return clamp(F.when(compensating, e * f32(0.5)).otherwise(e), 0.2, 1.5)


def to_risk(raw: Column) -> Column:
    """0 to 100, halves away from zero."""
    return F.round(f32(100.0) * clamp(raw, 0.0, 1.0)).cast("int")


def vulnerability_explain(cvss: Column, epss: Column, maturity: Column, vex: Column, internet_facing: Column, compensating: Column, criticality: Column, reach: Column | None = None) -> Column:
    return F.struct(
        clamp(F.coalesce(cvss, f32(0.0)) / f32(10.0), 0.0, 1.0).cast("float").alias("sev"),
        clamp(F.greatest(F.coalesce(epss, f32(0.0)), lookup(maturity, MATURITY, 0.0)), 0.0, 1.0).alias("likelihood"),
        exposure_factor(internet_facing, compensating).alias("exposure"),
        lookup(criticality, CRITICALITY).alias("crit"),
        (lookup(vex, REACH) if reach is None else reach).alias("reach"),
    )


def vulnerability_risk(e: Column) -> Column:
    return to_risk(e["sev"] * (f32(0.4) + f32(0.6) * e["likelihood"]) * e["exposure"] * e["crit"] * e["reach"])


def policy_explain(weight: Column, internet_facing: Column, compensating: Column, criticality: Column) -> Column:
    return F.struct(clamp(weight, 0.0, 1.0).alias("sev"), f32(1.0).alias("likelihood"), exposure_factor(internet_facing, compensating).alias("exposure"), lookup(criticality, CRITICALITY).alias("crit"), f32(1.0).alias("reach"))


def policy_risk(e: Column) -> Column:
    return to_risk(e["sev"] * e["exposure"] * e["crit"])


def decision(risk: Column, kev: Column | None = None, in_scope: Column | None = None, reach: Column | None = None) -> Column:
    act = risk >= 70
    if kev is not None:
        act = act | (kev & in_scope & (reach > 0))
    return F.when(act, "ACT").when(risk >= 40, "ATTEND").when(risk >= 20, "TRACK").otherwise("DEFER")


def sla_hours(made: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in SLA_HOURS.items():
        out = F.when(made == k, v).otherwise(out)
    return out


def upgraded_reach(vex: Column, runtime: Column) -> Column:
    """A library seen loaded raises an unknown reach to 1; nothing lowers it."""
    return F.when(F.coalesce(runtime, F.lit(False)) & (vex == "unknown"), f32(1.0)).otherwise(lookup(vex, REACH))


def initial_status(vex: Column) -> Column:
    return F.when(vex == "not_affected", "suppressed").otherwise("open")


def finding_id(asset: Column, vuln: Column, component: Column, location: Column) -> Column:
    return F.concat(asset, F.lit("|"), vuln, F.lit("|"), component, F.lit("|"), location)
