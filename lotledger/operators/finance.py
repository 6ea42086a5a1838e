"""Taxes, costs, rents, unit programmes and scenarios of parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import affordable_units, js_round, round34
from ..functions.keys import literal_map
from ..functions.zoning import DEFAULT_DU_FACTOR, zone_allows_res, zone_params

# Tax rate a dollar by class, market value a square foot by borough, share that is assessed.
TAX_RATES = {1: 0.19963, 2: 0.12439, 3: 0.12094, 4: 0.10592}
VALUE_PER_SF = {"1": 400, "2": 200, "3": 300, "4": 250, "5": 200}
ASSESSED_SHARE, FALLBACK_PER_SF, GROWTH, YEARS = 0.45, 15, 0.02, 40
# Fixed values: (program, option, years of full exemption); then two years each at 80, 60, 40, 20 and 10 percent.
SCHEDULES = [
    ("485-x", "Option A (Large)", 25), ("485-x", "Option A (Very Large)", 30), ("485-x", "Option B", 25),
    ("421-a", "Option A (Homeownership)", 18), ("421-a", "Option B (Rental)", 28), ("421-a", "Option C (Enhanced)", 28),
    ("467-m", "467-m", 25),
]
PHASE_OUT = [80, 60, 40, 20, 10]
# Options of 485-x: set-aside, average income, years, least and greatest units, income bands and their shares.
OPTIONS_485X = [
    ("Option A (Large)", 0.25, 80, 35, 100, 149, [(60, 30), (80, 40), (100, 30)]),
    ("Option A (Very Large)", 0.25, 60, 40, 150, None, [(40, 30), (60, 40), (80, 30)]),
    ("Option B", 0.20, 80, 35, 6, 99, [(60, 30), (80, 40), (100, 30)]),
]
# Greatest monthly rents of 2025 by income band, for studio, 1, 2 and 3 bedrooms.
UNIT_TYPES = ["Studio", "1BR", "2BR", "3BR"]
RENTS = {
    30: [850, 911, 1093, 1263], 40: [1134, 1215, 1458, 1685], 50: [1417, 1518, 1822, 2106], 60: [1701, 1822, 2187, 2527],
    70: [1984, 2126, 2551, 2948], 80: [2268, 2430, 2916, 3370], 90: [2552, 2733, 3281, 3791], 100: [2835, 3037, 3645, 4212],
    110: [3119, 3341, 4010, 4633], 120: [3402, 3644, 4374, 5054], 130: [3685, 3948, 4738, 5476], 165: [4678, 5011, 6014, 6950],
}


def tax_class(bldg_class: Column, units: Column) -> Column:
    c = F.upper(F.coalesce(bldg_class, F.lit("")))
    return F.when(c.rlike("^[ABS]"), 1).when(c.rlike("^[UT]"), 3).when((units >= 4) | c.rlike("^[CDR]"), 2).when(c.rlike("^[OKLEFGHIJ]"), 4).otherwise(2)


def assessed_value(df: DataFrame) -> DataFrame:
    """With tax_class, tax_rate and assessed_value of the new building (borough, bldg_class, units_res, bldg_area, new_res_fa)."""
    area = F.when(F.col("new_res_fa") > 0, F.col("new_res_fa")).otherwise(F.col("bldg_area"))
    per_foot = F.coalesce(literal_map(VALUE_PER_SF)[F.col("borough")], F.lit(VALUE_PER_SF["3"]))
    estimate = F.when(area > 0, js_round(js_round(area * per_foot) * ASSESSED_SHARE)).otherwise(0.0)
    fallback = js_round((F.col("bldg_area") + F.col("new_res_fa")) * FALLBACK_PER_SF)
    df = df.withColumn("tax_class", tax_class(F.col("bldg_class"), F.col("units_res")))
    return df.withColumns({"tax_rate": literal_map(TAX_RATES)[F.col("tax_class")], "assessed_value": F.when(estimate > 0, estimate).otherwise(fallback)})


def schedules(spark: SparkSession) -> DataFrame:
    """program, option, year, exemption_pct: a row for each year of each schedule."""
    rows = [(p, o, y + 1, 100 if y < full else PHASE_OUT[(y - full) // 2]) for p, o, full in SCHEDULES for y in range(full + 2 * len(PHASE_OUT))]
    return spark.createDataFrame(rows, "program string, option string, year int, exemption_pct int")


def _growth_tax(year: Column) -> Column:
    value = js_round(F.col("assessed_value") * F.pow(F.lit(1 + GROWTH), year - 1))
    return js_round(value * F.col("tax_rate"), 2)


def project_tax(df: DataFrame) -> DataFrame:
    """A row for each parcel, schedule of its programs (array) and year: exemption, gross and net tax, and the
    taxes without exemption, flat and growing. The schedules are some 250 rows and broadcast."""
    table = F.broadcast(schedules(df.sparkSession))
    rows = df.withColumn("_program", F.explode(F.array_distinct("programs"))).join(table, F.col("_program") == F.col("program")).drop("_program")
    exempt = js_round(F.col("assessed_value") * (F.col("exemption_pct") / 100), 2)
    rows = rows.withColumn("exemption", exempt)
    net = js_round(F.greatest(F.col("assessed_value") - F.col("exemption"), F.lit(0.0)) * F.col("tax_rate"), 2)
    return rows.withColumns({"net_tax": net, "flat_tax": js_round(F.col("assessed_value") * F.col("tax_rate"), 2), "growth_tax": _growth_tax(F.col("year"))})


def tax_savings(rows: DataFrame) -> DataFrame:
    """bbl, program, option with totals: savings against the flat and the growing tax, and in percent."""
    sums = rows.groupBy("bbl", "program", "option").agg(*(F.sum(c).alias(c) for c in ("net_tax", "flat_tax", "growth_tax")))
    real = js_round(F.col("growth_tax") - F.col("net_tax"), 2)
    out = sums.select("bbl", "program", "option", js_round(F.col("flat_tax") - F.col("net_tax"), 2).alias("total_savings"), real.alias("real_savings"), "growth_tax")
    return out.withColumn("savings_pct", F.when(F.col("growth_tax") > 0, js_round(F.col("real_savings") / F.col("growth_tax") * 100, 2)).otherwise(0.0)).drop("growth_tax")


def best_scenario(savings: DataFrame) -> DataFrame:
    return savings.groupBy("bbl").agg(F.max(F.struct("real_savings", "program", "option")).alias("b")).select("bbl", "b.*")


def tax_baseline(df: DataFrame, years: int = YEARS) -> DataFrame:
    """bbl, year, growth_tax and its running total, which lots under one key share."""
    rows = df.select("bbl", "assessed_value", "tax_rate", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year")).withColumn("growth_tax", _growth_tax(F.col("year")))
    running = Window.partitionBy("bbl").orderBy("year").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("bbl", "year", "growth_tax", F.sum("growth_tax").over(running).alias("total_tax"))


def capacity(df: DataFrame) -> DataFrame:
    """With the areas that zoning allows (lot_area, bldg_area, resid_far, comm_far, facil_far, zone_dist, land_use)."""
    z = zone_params(df)
    far = F.greatest(F.col("resid_far"), F.coalesce("standard_far", F.lit(0.0)))
    z = z.withColumns({"_res": far * F.col("lot_area"), "_max": F.greatest(far, F.col("comm_far"), F.col("facil_far")) * F.col("lot_area")})
    return z.withColumns(
        {
            "max_res_fa": js_round(F.col("_res")),
            "max_buildable_sf": js_round(F.col("_max")),
            "buildable_slack_sf": js_round(F.greatest(F.col("_max") - F.col("bldg_area"), F.lit(0.0))),
            "new_res_fa": js_round(F.greatest(F.col("_res") - F.col("bldg_area"), F.lit(0.0))),
            "is_vacant": (F.col("bldg_area") <= 0) | (F.col("land_use") == "11"),
            "allows_res": zone_allows_res(F.col("zone_dist")),
            "qualifying_fa": js_round(F.col("bonus_far") * F.col("lot_area")),
            "du_factor": F.coalesce("du_factor", F.lit(DEFAULT_DU_FACTOR)),
        }
    ).drop("_res", "_max")


def program_options(df: DataFrame) -> DataFrame:
    """A row for each parcel, option of 485-x and income band: units and floor area; applicable marks the
    option for the parcel's number of units."""
    options = [(n, s, a, y, lo, hi, ami, pct) for n, s, a, y, lo, hi, bands in OPTIONS_485X for ami, pct in bands]
    table = F.broadcast(df.sparkSession.createDataFrame(options, "option string, set_aside double, avg_ami int, benefit_years int, min_units int, max_units int, max_ami int, share int"))
    units = F.when(F.col("max_res_fa") <= 0, 0).otherwise(round34(F.col("max_res_fa") / F.col("du_factor")))
    rows = df.withColumn("total_units", units).join(table)
    affordable, area = affordable_units(F.col("total_units"), F.col("set_aside")), js_round(F.col("set_aside") * F.col("max_res_fa"))
    rows = rows.withColumns({"affordable_units": affordable, "affordable_fa": area})
    return rows.withColumns(
        {
            "band_units": F.ceil(F.col("affordable_units") * F.col("share") / 100).cast("int"),
            "band_fa": js_round(F.col("share") / 100 * F.col("affordable_fa")),
            "eligible": F.col("allows_res") & (F.col("new_res_fa") > 0) & (F.col("total_units") >= 6),
            "applicable": (F.col("total_units") >= F.col("min_units")) & F.coalesce(F.col("total_units") <= F.col("max_units"), F.lit(True)),
        }
    )


def hard_cost(df: DataFrame) -> DataFrame:
    """With hard_cost a square foot (bldg_class, zone_dist, num_floors, borough, year_built, land_use, lot_area)."""
    z, c, use = F.upper("zone_dist"), F.upper("bldg_class"), F.col("land_use")
    luxury = c.startswith("R") | z.startswith("R10")
    base = (
        F.when(luxury, 500).when(use.isin("05", "06") | c.rlike("^[OKLEFGHIJ]"), 300).when(z.startswith("C") | (z.startswith("M") & z.contains("/")), 400)
        .when(z.rlike("^R[6-9]") | use.isin("02", "03") | c.rlike("^[CD]"), 350).when(z.rlike("^R[1-5]") | (use == "01") | c.rlike("^[ABS]"), 325).otherwise(350)
    )
    floors = F.col("num_floors")
    more = (
        F.when(floors > 30, 250).when(floors > 15, 150).when(floors > 7, 75).otherwise(0) + F.when(F.col("borough") == "1", 75).otherwise(0) + F.when(luxury, 150).otherwise(0)
        + F.when((F.col("year_built") > 0) & (F.col("year_built") < 1940), 75).otherwise(0) + F.when((F.col("lot_area") > 0) & (F.col("lot_area") < 2500), 25).otherwise(0)
    )
    return df.withColumn("hard_cost", F.least(base + more, F.when(luxury, 1500).otherwise(1000)))


def land_cost(df: DataFrame) -> DataFrame:
    """With land_cost a square foot: of ppbsf, else of the sale's amount by buildable area, else 150."""
    derived = F.when((F.col("sale_price") > 0) & (F.col("max_buildable_sf") > 0), js_round(F.col("sale_price") / F.col("max_buildable_sf")))
    return df.withColumn("land_cost", F.coalesce(F.when(F.col("ppbsf") > 0, js_round(F.col("ppbsf"))), derived, F.lit(150.0)))


def rent_schedule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, ami, float(r)) for ami, rents in RENTS.items() for t, r in zip(UNIT_TYPES, rents, strict=True)], "unit_type string, ami int, max_rent double")


def rent_limit(df: DataFrame) -> DataFrame:
    """With max_rent of (unit_type, ami_band), of the nearest band if there is none, the lower of two.

    The schedule is four rows of bands; each row picks from its type's array, without a join of bands."""
    by_type = rent_schedule(df.sparkSession).groupBy(F.col("unit_type").alias("_type")).agg(F.array_sort(F.collect_list(F.struct("ami", "max_rent"))).alias("_bands"))
    joined = df.join(F.broadcast(by_type), F.col("unit_type") == F.col("_type"), "left")
    near = F.array_min(F.transform("_bands", lambda b: F.struct(F.abs(b["ami"] - F.col("ami_band")).alias("d"), b["ami"].alias("ami"), b["max_rent"].alias("r"))))
    return joined.withColumn("max_rent", near["r"]).drop("_type", "_bands")


def allocations(units: DataFrame) -> DataFrame:
    """scenario, unit_type, ami_band with count, total and average area and monthly rent, from unit records
    (scenario, unit_type, ami_band, area_sf). Bands above 0 rent at their limit, the market at that of 165."""
    sums = units.groupBy("scenario", "unit_type", "ami_band").agg(F.count("*").alias("count"), F.sum("area_sf").alias("total_sf"))
    priced = rent_limit(sums.withColumnRenamed("ami_band", "_ami").withColumn("ami_band", F.when(F.col("_ami") > 0, F.col("_ami")).otherwise(165)))
    return priced.select("scenario", "unit_type", F.col("_ami").alias("ami_band"), "count", "total_sf", (F.col("total_sf") / F.col("count")).alias("avg_sf"), F.col("max_rent").alias("monthly_rent"))


def evaluate_scenarios(alloc: DataFrame, hard: float = 350.0, soft: float = 0.25, land: float = 150.0) -> DataFrame:
    """scenario with units, affordable units, blended income, rents a year, cost, return, and market and
    affordable revenue."""
    affordable = F.col("ami_band") > 0
    rent = F.col("count") * F.col("monthly_rent")
    sums = alloc.groupBy("scenario").agg(
        F.sum("count").alias("total_units"), F.sum(F.when(affordable, F.col("count")).otherwise(0)).alias("affordable_units"), F.sum("total_sf").alias("total_sf"),
        (F.sum(rent) * 12).alias("annual_revenue"), (F.sum(F.when(affordable, rent).otherwise(0)) * 12).alias("affordable_revenue"), F.sum(F.col("ami_band") * F.col("count")).alias("_w"),
    )
    cost = F.col("total_sf") * hard * (1 + soft) + F.col("total_sf") * land
    return sums.withColumn("cost", cost).select(
        "scenario", "total_units", "affordable_units", "total_sf", "annual_revenue", "affordable_revenue", "cost",
        F.when(F.col("affordable_units") > 0, js_round(F.col("_w") / F.col("affordable_units"))).otherwise(0.0).alias("blended_ami"),
        F.when(F.col("cost") > 0, F.col("annual_revenue") / F.col("cost")).otherwise(0.0).alias("roi"),
    )


def check_constraints(alloc: DataFrame, min_affordable: float, bands: dict[int, float], tolerance: float = 0.10) -> DataFrame:
    """scenario, affordable share and its slack, least slack of the bands' shares, largest deviation of bedroom
    shares between affordable and market units, feasible."""
    affordable = F.col("ami_band") > 0
    n = F.col("count")
    by_type = alloc.groupBy("scenario", "unit_type").agg(F.sum(F.when(affordable, n).otherwise(0)).alias("a"), F.sum(F.when(~affordable, n).otherwise(0)).alias("m"))
    whole = Window.partitionBy("scenario")
    shares = by_type.withColumns({"ta": F.sum("a").over(whole), "tm": F.sum("m").over(whole)})
    deviation = F.when((F.col("ta") > 2) & (F.col("tm") > 0), F.abs(F.col("a") / F.col("ta") - F.col("m") / F.col("tm"))).otherwise(0.0)
    worst = shares.groupBy("scenario").agg(F.max(deviation).alias("deviation"))
    held = [F.sum(F.when(F.col("ami_band") == b, n).otherwise(0)).alias(f"_b{b}") for b in bands]
    sums = alloc.groupBy("scenario").agg(F.sum(n).alias("total"), F.sum(F.when(affordable, n).otherwise(0)).alias("aff"), *held)
    of_band = lambda b: F.when(F.col("aff") > 0, F.col(f"_b{b}") / F.col("aff")).otherwise(0.0)
    enough = lambda b, p: F.col(f"_b{b}") >= F.greatest(F.lit(1), F.floor(F.lit(p) * F.col("aff")))
    slack = [F.when(enough(b, p), F.greatest(of_band(b) - p, F.lit(0.0))).otherwise(of_band(b) - p) for b, p in bands.items()]
    least = F.least(*slack) if len(slack) > 1 else slack[0]
    out = sums.join(worst, "scenario").select("scenario", (F.col("aff") / F.col("total")).alias("affordable_share"), (F.col("aff") / F.col("total") - min_affordable).alias("affordable_slack"), least.alias("band_slack"), "deviation")
    return out.withColumn("feasible", (F.col("affordable_slack") >= -0.001) & (F.col("band_slack") >= -0.001) & (tolerance - F.col("deviation") >= -0.001))


def shock_grid(alloc: DataFrame, shocks: list[float] = (-0.1, 0.0, 0.1), **costs: float) -> DataFrame:
    """Scenarios under each combination of a rent and a hard-cost shock: scenario, rent_shock, cost_shock, roi."""
    grid = F.broadcast(alloc.sparkSession.createDataFrame([(float(r), float(c)) for r in shocks for c in shocks], "rent_shock double, cost_shock double"))
    hard, soft, land = costs.get("hard", 350.0), costs.get("soft", 0.25), costs.get("land", 150.0)
    sums = alloc.groupBy("scenario").agg((F.sum(F.col("count") * F.col("monthly_rent")) * 12).alias("revenue"), F.sum("total_sf").alias("sf")).join(grid)
    cost = F.col("sf") * (hard * (1 + F.col("cost_shock"))) * (1 + soft) + F.col("sf") * land
    return sums.select("scenario", "rent_shock", "cost_shock", (F.col("revenue") * (1 + F.col("rent_shock")) / cost).alias("roi"))


def apportion(df: DataFrame, group: list[str], total: str, share: str, name: str = "units", ties: list[str] = ()) -> DataFrame:
    """Whole units by shares: floors, and one more each for the largest remainders until the total is reached."""
    exact = F.col(total) * F.col(share)
    rows = df.withColumns({"_floor": F.floor(exact), "_rest": exact - F.floor(exact)})
    missing = F.col(total) - F.sum("_floor").over(Window.partitionBy(*group))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_rest"), F.desc(share), *ties))
    return rows.withColumns({"_missing": missing, "_turn": turn}).withColumn(name, (F.col("_floor") + F.when(F.col("_turn") <= F.col("_missing"), 1).otherwise(0)).cast("int")).drop("_floor", "_rest", "_missing", "_turn")


def assemble(lots: DataFrame, mode: str = "most_restrictive", order: list[str] | None = None) -> DataFrame:
    """group_id with summed areas, the least (or greatest) positive ratios, the primary lot's zone, and whether
    the lots lie in several zones. order: what tells the first of several primary lots, the key if nothing is given."""
    pick = F.max if mode == "least_restrictive" else F.min
    far = lambda c: F.coalesce(pick(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(c)
    zone, turn = F.nullif("zone_dist", F.lit("")), F.struct(*(order or ["bbl"]))
    return lots.groupBy("group_id").agg(
        F.sum("lot_area").alias("lot_area"), F.sum("bldg_area").alias("bldg_area"), *(far(c) for c in ("resid_far", "comm_far", "facil_far")),
        F.coalesce(F.min_by("zone_dist", F.when(F.col("is_primary"), turn)), F.min_by(zone, F.when(zone.isNotNull(), turn)), F.lit("")).alias("zone_dist"),
        (F.countDistinct(zone) > 1).alias("multi_zone"), F.count("*").alias("n_lots"),
    )


def unit_totals(units: DataFrame) -> DataFrame:
    """doc_id, bedroom, allocation, ami_band, n, area_sf: totals of each document, by bedroom, by allocation,
    by both and by income band (null where a column isn't part of the total)."""
    sets = [["doc_id"], ["doc_id", "bedroom"], ["doc_id", "allocation"], ["doc_id", "allocation", "bedroom"], ["doc_id", "ami_band"]]
    sums = units.groupingSets(sets, "doc_id", "bedroom", "allocation", "ami_band").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("area_sf").alias("area_sf"))
    return sums.select("doc_id", "bedroom", "allocation", "ami_band", "level", "n", "area_sf")
