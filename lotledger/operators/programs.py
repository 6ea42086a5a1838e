"""Housing programmes of parcels: option rows, bonus area, conversion, unit mix, market rents, merged rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import affordable_units, js_round, round34
from ..functions.zoning import uap_zone

# Options by programme: set-aside, average income, income bands and their shares of the affordable units.
OPTIONS = {
    "MIH": [
        ("Option 1", 0.25, 60, [(40, 10), (60, 50), (80, 40)]), ("Option 2", 0.30, 80, [(60, 20), (80, 40), (100, 40)]),
        ("Option 3 (Deep Affordability)", 0.20, 40, [(30, 40), (40, 40), (50, 20)]), ("Option 4 (Workforce)", 0.30, 115, [(80, 20), (115, 50), (130, 30)]),
    ],
    "421-a": [
        ("Option A (Homeownership)", 0.25, 130, [(100, 30), (130, 70)]), ("Option B (Rental)", 0.25, 130, [(100, 30), (130, 40), (165, 30)]),
        ("Option C (Enhanced Affordability)", 0.30, 60, [(40, 30), (60, 40), (80, 30)]),
    ],
}
DEEP_AREA, DEEP_SHARE, SET_ASIDE, DEEP_SET_ASIDE, MIN_PREEXISTING = 10_000, 0.20, 0.25, 0.05, 0.50
CONFLICTING = ["421-a", "485-x", "J-51"]
# Weights of unit types (studio, 1, 2 and 3 bedrooms) by kind of place; market rents and areas by borough.
UNIT_TYPES = ["Studio", "1BR", "2BR", "3BR"]
MIXES = {"dense": [0.30, 0.35, 0.25, 0.10], "family": [0.10, 0.20, 0.40, 0.30], "middle": [0.20, 0.30, 0.30, 0.20], "even": [0.25, 0.30, 0.25, 0.20]}
MARKET = {
    "1": ([3200, 4100, 5500, 7200], [450, 650, 950, 1250]), "2": ([1600, 1900, 2300, 2700], [400, 600, 850, 1100]), "3": ([2500, 3200, 4000, 5000], [425, 625, 900, 1200]),
    "4": ([1800, 2300, 2900, 3500], [425, 625, 875, 1150]), "5": ([1400, 1700, 2100, 2600], [450, 650, 950, 1250]),
}
DEFAULT_MARKET, SPREAD, LEAST_WEIGHT = "3", 0.15, 0.10


def projected_units(area: Column) -> Column:
    """Units that an area makes room for (du_factor)."""
    return F.when(area <= 0, 0).otherwise(round34(area / F.col("du_factor")))


def option_bands(df: DataFrame, program: str) -> DataFrame:
    """A row for each parcel of a capacity table, option of the programme and income band. 421-a has expired, so
    nothing is eligible for it; the options are a dozen rows and broadcast."""
    rows = [(n, s, a, ami, pct) for n, s, a, bands in OPTIONS[program] for ami, pct in bands]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "option string, set_aside double, avg_ami int, max_ami int, share int"))
    out = df.withColumn("total_units", projected_units(F.col("max_res_fa"))).join(table)
    out = out.withColumns({"affordable_units": affordable_units(F.col("total_units"), F.col("set_aside")), "affordable_fa": js_round(F.col("set_aside") * F.col("max_res_fa"))})
    return out.withColumns(
        {
            "program": F.lit(program),
            "market_units": F.greatest(F.col("total_units") - F.col("affordable_units"), F.lit(0)),
            "band_units": F.ceil(F.col("affordable_units") * F.col("share") / 100).cast("int"),
            "band_fa": js_round(F.col("share") / 100 * F.col("affordable_fa")),
            "eligible": (F.col("allows_res") & (F.col("new_res_fa") > 0)) if program != "421-a" else F.lit(False),
        }
    )


def _band(ami: int, area: Column, units: Column) -> Column:
    return F.struct(F.lit(ami).alias("max_ami"), area.cast("double").alias("floor_area"), units.cast("int").alias("units"))


def uap_option(df: DataFrame, utilization_pct: float = 100.0) -> DataFrame:
    """With the affordability bonus of a capacity table: bonus_fa, units with and without it, bands, uap_eligible.
    From 10 000 square feet on, a fifth of the bonus is deeply affordable."""
    used = max(0.0, min(100.0, utilization_pct)) / 100
    has = F.coalesce(F.col("qualifying_fa") > F.col("max_res_fa"), F.lit(False))
    most = F.when(has, F.col("qualifying_fa") - F.col("max_res_fa")).otherwise(0.0)
    out = df.withColumns({"max_bonus_fa": most, "bonus_fa": js_round(most * used)})
    out = out.withColumns({"base_units": projected_units(F.col("max_res_fa")), "units_with_bonus": projected_units(F.col("max_res_fa") + F.col("bonus_fa"))})
    out = out.withColumn("bonus_units", F.greatest(F.col("units_with_bonus") - F.col("base_units"), F.lit(0)))
    area, units = F.col("bonus_fa"), F.col("bonus_units")
    deep_area, deep_units = js_round(area * DEEP_SHARE), F.greatest(F.ceil(units * DEEP_SHARE), F.lit(1))
    middle = F.ceil((units - deep_units) * 0.5)
    deep = F.array(
        _band(40, deep_area, deep_units), _band(60, js_round((area - deep_area) * 0.5), middle),
        _band(80, area - deep_area - js_round((area - deep_area) * 0.5), F.greatest(units - deep_units - middle, F.lit(0))),
    )
    plain = F.array(_band(50, js_round(area / 2), F.ceil(units * 0.5)), _band(70, area - js_round(area / 2), units - F.ceil(units * 0.5)))
    share = F.when(F.col("units_with_bonus") > 0, js_round(units / F.col("units_with_bonus") * 10000) / 100).otherwise(0.0)
    eligible = F.col("allows_res") & (F.col("max_res_fa") > 0) & uap_zone(F.col("zone_dist")) & has
    return out.withColumns({"affordable_pct": share, "deep": area >= DEEP_AREA, "bands": F.when(area >= DEEP_AREA, deep).otherwise(plain), "uap_eligible": eligible})


def program_467m(df: DataFrame, active: str = "active_programs") -> DataFrame:
    """With the 467-m set-aside of a capacity table (active: array of programmes in force): areas, units, bands,
    average income by area, share that stands already, conflicts and whether the parcel may qualify."""
    affordable, deep = js_round(F.col("max_res_fa") * SET_ASIDE), js_round(F.col("max_res_fa") * DEEP_SET_ASIDE)
    out = df.withColumns({"affordable_fa": affordable, "deep_fa": deep, "affordable_units": affordable_units(projected_units(F.col("max_res_fa")), F.lit(SET_ASIDE))})
    rest, units = F.col("affordable_fa") - F.col("deep_fa"), F.col("affordable_units")
    deep_units = F.ceil(units * (DEEP_SET_ASIDE / SET_ASIDE))
    half, half_units = js_round(rest * 0.5), F.ceil((units - deep_units) * 0.5)
    bands = F.array(_band(40, F.col("deep_fa"), deep_units), _band(80, half, half_units), _band(100, rest - half, F.greatest(units - deep_units - half_units, F.lit(0))))
    weighted = 40 * F.col("deep_fa") + 80 * half + 100 * (rest - half)
    conflicts = F.filter(active, lambda p: F.exists(F.array(*(F.lit(c.lower()) for c in CONFLICTING)), lambda c: F.contains(F.lower(p), c)))
    stands = F.when((F.col("bldg_area") > 0) & (F.col("max_buildable_sf") > 0), F.col("bldg_area") / F.col("max_buildable_sf")).otherwise(0.0)
    conversion = (F.col("bldg_area") > 0) & ~F.col("is_vacant")
    may = F.col("allows_res") & (F.col("new_res_fa") > 0) & (F.size(conflicts) == 0) & ~(conversion & (stands < MIN_PREEXISTING))
    average = F.when(F.col("affordable_fa") > 0, js_round(weighted / F.col("affordable_fa"))).otherwise(0.0)
    return out.withColumns({"bands": bands, "avg_ami": average, "is_conversion": conversion, "preexisting": stands, "conflicts": conflicts, "may_qualify": may})


def unit_mix(df: DataFrame) -> DataFrame:
    """With weights (by UNIT_TYPES, summing to 1) and recommended, the types of at least a tenth, heaviest first."""
    zone = F.upper(F.coalesce("zone_dist", F.lit("")))
    dense = (F.col("borough") == "1") | zone.rlike("^(R10|C5|C6|C1-9|C2-8)")
    family = F.col("borough").isin("2", "5") | zone.rlike("^R[3-6]")
    kind = F.when(dense, "dense").when(family, "family").when(zone.rlike("^R[789]"), "middle").otherwise("even")
    tower = F.when((F.col("resid_far") >= 6) & (F.col("num_floors") >= 15), 0.05).otherwise(0.0)
    large = F.when((F.col("lot_area") > 20000) & (F.col("resid_far") < 3), 0.05).otherwise(0.0)
    small = F.when((F.col("units_res") > 0) & (F.col("units_res") <= 10), 0.05).otherwise(0.0)
    base = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, w in MIXES.items() for x in (k, w[i]))), kind)
    raw = [base(i) + tower - large - small if i < 2 else base(i) - tower + large + small for i in range(4)]
    out = df.withColumn("_raw", F.array(*raw))
    total = F.col("_raw")[0] + F.col("_raw")[1] + F.col("_raw")[2] + F.col("_raw")[3]
    out = out.withColumn("weights", F.transform("_raw", lambda w: F.greatest(w / total, F.lit(0.0)))).drop("_raw")
    rows = F.array(*(F.struct((-F.col("weights")[i]).alias("w"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(UNIT_TYPES)))
    return out.withColumn("recommended", F.transform(F.array_sort(F.filter(rows, lambda r: -r["w"] >= LEAST_WEIGHT)), lambda r: r["t"]))


def market_rents(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """df (borough) with a row for each unit type: monthly_rent, avg_sf, min_sf, max_sf, rent_source. The stored
    estimates (borough_code, unit_type, monthly_rent, avg_sf) of the borough count, else the fallback's, else the default."""
    array = lambda b: F.array(*(F.struct(F.lit(t).alias("unit_type"), F.lit(float(r)).alias("monthly_rent"), F.lit(float(a)).alias("avg_sf")) for t, r, a in zip(UNIT_TYPES, *MARKET[b], strict=True)))
    fallback = F.create_map(*(x for b in MARKET for x in (F.lit(b), array(b))))
    row = F.struct("unit_type", F.col("monthly_rent").cast("double").alias("monthly_rent"), F.col("avg_sf").cast("double").alias("avg_sf"))
    stored = estimates.groupBy(F.col("borough_code").alias("_code")).agg(F.collect_list(row).alias("_stored"))  # a row a borough
    joined = df.join(stored, F.col("borough") == F.col("_code"), "left")
    source = F.when(F.col("_stored").isNotNull(), "stored").when(F.col("borough").isin(*MARKET), "fallback").otherwise("default")
    out = joined.select(*df.columns, source.alias("rent_source"), F.inline(F.coalesce("_stored", fallback[F.col("borough")], array(DEFAULT_MARKET))))
    return out.withColumns({"min_sf": js_round(F.col("avg_sf") * (1 - SPREAD)), "max_sf": js_round(F.col("avg_sf") * (1 + SPREAD))})


def merge_constraints(rules: DataFrame) -> DataFrame:
    """group_id, band, pct, target, min_units, programs from rules (group_id, program, min_affordable, est_units,
    band, pct): the greatest share of each band, scaled down where they exceed 1, at least a unit each, and what
    is missing to the target goes to the largest remainders, lower bands first."""
    bands = rules.groupBy("group_id", "band").agg(
        F.max("pct").alias("pct"), F.array_sort(F.collect_set("program")).alias("programs"), F.max("min_affordable").alias("_least"), F.max("est_units").alias("_units")
    )
    group = Window.partitionBy("group_id")
    bands = bands.withColumns({"_total": F.sum("pct").over(group), "target": F.ceil(F.max("_least").over(group) * F.max("_units").over(group)).cast("int")})
    bands = bands.withColumn("pct", F.when(F.col("_total") > 1, F.col("pct") / F.col("_total")).otherwise(F.col("pct")))
    bands = bands.withColumn("_floor", F.greatest(F.floor(F.col("pct") * F.col("target")), F.lit(1)))
    rest = F.col("pct") * F.col("target") - F.col("_floor")
    turn = F.row_number().over(group.orderBy(rest.desc(), "band"))
    bands = bands.withColumns({"_missing": F.col("target") - F.sum("_floor").over(group), "_turn": turn})
    return bands.select("group_id", "band", "pct", "target", (F.col("_floor") + F.when(F.col("_turn") <= F.col("_missing"), 1).otherwise(0)).cast("int").alias("min_units"), "programs")


def merge_unit_rules(rules: DataFrame) -> DataFrame:
    """group_id, unit_type, min_sf (the greatest) and share (the greatest, scaled to 1 in the group) from rules
    (group_id, program, unit_type, min_sf, share)."""
    out = rules.groupBy("group_id", "unit_type").agg(F.max("min_sf").alias("min_sf"), F.max("share").alias("share"))
    return out.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("group_id")))
