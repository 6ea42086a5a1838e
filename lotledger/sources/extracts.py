"""Reading extracts and polygons, writing exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_extract(spark: SparkSession, path: str, fmt: str, columns: list[str]) -> DataFrame:
    """Rows of an extract, every column as text; csv has a header, json a row a line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def parse_filing_snippet(c: Column) -> Column:
    """filing_date, job_type and work_type of a JSON snippet; null if it is none."""
    return F.from_json(c, "filing_date string, job_type string, work_type string")


# The columns of an export and the columns of scored parcels that they show.
EXPORTED = {
    "BBL": "bbl", "Address": "address", "Borough": "borough", "Zone": "zone_dist", "Lot SF": "lot_area", "Bldg SF": "bldg_area", "Slack SF": "slack_sf", "UB Ratio %": "underbuilt_ratio", "Resid FAR": "resid_far",
    "Built FAR": "built_far", "Score": "score", "Potential Units": "potential_units", "Programs": "program_flags", "Data Score": "data_completeness", "Last Sale Date": "last_sale_date", "Last Sale Price": "last_sale_price",
    "PPBSF": "ppbsf", "Sale Source": "last_sale_source", "Owner": "owner_name", "Bldg Class": "bldg_class", "Year Built": "year_built", "Units Res": "units_res",
}
#: Exported with one decimal place; as nothing where they are 0.
ONE_PLACE, OR_NOTHING = ["UB Ratio %", "Score"], ["Last Sale Price", "Year Built"]


def export_rows(scored: DataFrame) -> DataFrame:
    """Scored parcels with the 22 columns of an export: eligible programmes joined with ", ", the rest as it is shown."""
    programs = F.array_join(F.transform(F.filter("program_flags", lambda f: f["eligible"]), lambda f: f["program"]), ", ")
    shown = []
    for name, c in EXPORTED.items():
        value = programs if name == "Programs" else F.format_string("%.1f", F.col(c).cast("double")) if name in ONE_PLACE else F.nullif(F.col(c), F.lit(0)) if name in OR_NOTHING else F.col(c)
        shown.append(value.alias(name))
    return scored.select(*shown)


def export_csv(scored: DataFrame, path: str) -> None:
    """Scored parcels as CSV with a header; quotes in texts are doubled."""
    export_rows(scored).write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').csv(path)


def read_geojson_polygons(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """seq, area, rings of the polygons in GeoJSON feature collections: parts of multipolygons and geometry
    collections have rows of their own. names: properties that may hold the area's name, in turn."""
    rings = "array<array<array<double>>>"
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("seq", "feature"))
    geometry = F.get_json_object("feature", "$.geometry")
    parts = F.when(F.get_json_object(geometry, "$.type") == "GeometryCollection", F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")).otherwise(F.array(geometry))
    area = F.coalesce(*(F.get_json_object("feature", f"$.properties.{n}") for n in names))
    rows = features.select("seq", area.alias("area"), F.explode(parts).alias("g")).withColumns({"kind": F.get_json_object("g", "$.type"), "at": F.get_json_object("g", "$.coordinates")})
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("at", rings))).when(F.col("kind") == "MultiPolygon", F.from_json("at", f"array<{rings}>"))
    return rows.select("seq", "area", F.explode(polygons).alias("rings"))
