"""Census areas and points of interest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
CENSUS_CSV_SCHEMA = (
    "geo_uid string, type string, region_name string, area_sq_km double, "
    "population long, dwellings long, households long, density_per_sq_km double"
)
POINTS_OF_INTEREST = [
    (1, "BC Place", "Vancouver Whitecaps/BC Lions", 49.27596, -123.11274),
    (2, "Rogers Arena", "Vancouver Canucks", 49.277821, -123.109085),
    (3, "Pacific Coliseum", "Vancouver Giants", 49.2848, -123.0390),
]
POI_SCHEMA = "poi_id int, name string, team string, latitude double, longitude double"
NAME_LIMIT = 63
# -------------------------------------------------------------------------------------------

_RING = "array<array<double>>"
_FEATURE = (
    "struct<properties:struct<id:string,pop:string,a:string>,"
    "geometry:struct<type:string,coordinates:string>>"
)


def census_density(df: DataFrame) -> DataFrame:
    """Numbers from ``pop`` and ``a`` (bad text gives NULL), density, rows without density dropped."""
    pop, a = F.col("pop").try_cast("double"), F.col("a").try_cast("double")
    # people on an area of size zero have infinite density, as in float arithmetic
    density = F.when(a != 0, F.try_divide(pop, a)).when(pop > 0, F.lit(float("inf")))
    return df.withColumns({"pop": pop, "a": a}).withColumn("population_density", density).where(
        F.col("population_density").isNotNull())


_HEAD = re.compile(r'\{\s*"type"\s*:\s*$')
_AGAIN = r'\{\s*"type"\s*:\s*"Feature"'


def _feature_mark(spark: SparkSession, path: str) -> str | None:
    """How the features of a collection begin, if with their type; told from the head of the file."""
    first = spark.read.option("lineSep", '"Feature"').text(path).limit(1).first()
    found = _HEAD.search(first["value"]) if first else None
    return found[0] + '"Feature"' if found else None


def read_census(spark: SparkSession, path: str, one_feature_per_line: bool = False) -> DataFrame:
    """GeoJSON areas with density and multipolygon geometry.

    A FeatureCollection whose features begin with their type, as most writers put it, is cut where a feature begins: that mark is
    the separator of a text source, which Spark splits by byte ranges, so many tasks read one file. All features must be
    spaced alike there; one that is not is an error, never a lost row. Other collections are one JSON document and one task.
    """
    properties, geometry = "properties struct<id:string,pop:string,a:string>", "geometry struct<type:string,coordinates:string>"
    mark = None if one_feature_per_line else _feature_mark(spark, path)
    if one_feature_per_line:
        rows = spark.read.schema(f"{properties}, {geometry}").json(path)
    elif mark:
        pieces = spark.read.option("lineSep", mark).text(path).where(~F.col("value").rlike(r'^\s*\{\s*"type"\s*:\s*"FeatureCollection"'))
        whole = F.when(F.col("value").rlike(_AGAIN), F.raise_error(F.lit("features of one collection are spaced differently"))).otherwise(
            F.concat(F.lit(mark), F.col("value")))
        # a piece ends with what parts it from the next feature, or ends the collection; it is not read beyond its object
        rows = pieces.select(F.from_json(whole, f"{properties}, {geometry}").alias("f")).select("f.*")
    else:
        doc = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
        rows = doc.select(F.explode("features").alias("f")).select("f.*")
    as_points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    text = F.col("geometry.coordinates")
    single = F.array(F.transform(F.from_json(text, f"array<{_RING}>"), as_points))
    several = F.transform(F.from_json(text, f"array<array<{_RING}>>"), lambda part: F.transform(part, as_points))
    geom = F.when(F.col("geometry.type") == "Polygon", single).when(F.col("geometry.type") == "MultiPolygon", several)
    return census_density(rows.select("properties.id", "properties.pop", "properties.a", geom.alias("geom")))


def read_census_csv(spark: SparkSession, path: str) -> DataFrame:
    """Census table as CSV; its headers are replaced by plain names."""
    return spark.read.schema(CENSUS_CSV_SCHEMA).csv(path, header=True, enforceSchema=True)


def plain_name(name: str, position: int = 0) -> str:
    """Lower-case column name of letters, digits and underscores."""
    text = name.replace("+", "_plus")
    text = re.sub(r"[()]", "", text)
    text = re.sub(r"[-\s,./]", "_", text)
    text = re.sub(r"_{2,}", "_", text.strip("_"))
    if text and not re.match(r"[^\W\d]", text):
        text = "_" + text
    return text[:NAME_LIMIT].lower() or f"col_{position}"


def normalise_columns(df: DataFrame) -> DataFrame:
    """Plain names for all columns; one that is taken already gets a number."""
    names: list[str] = []
    for i, column in enumerate(df.columns):
        plain, n = plain_name(column, i), 1
        name = plain
        while name in names:
            n += 1
            name = f"{plain[:NAME_LIMIT - len(str(n)) - 1]}_{n}"
        names.append(name)
    return df.toDF(*names)


def poi_table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Points of interest, unique by name: a row of ``extra`` replaces a standard one of the same name,
    and among the extra rows the highest ``poi_id`` wins."""
    base = spark.createDataFrame(POINTS_OF_INTEREST, POI_SCHEMA)
    if extra is None:
        return base
    rest = ["team", "latitude", "longitude"]
    both = base.withColumn("__rank", F.lit(0)).unionByName(extra.select(*base.columns).withColumn("__rank", F.lit(1)))
    last = F.max(F.struct("__rank", "poi_id", *rest)).alias("__r")
    return both.groupBy("name").agg(last).select("__r.poi_id", "name", *[f"__r.{c}" for c in rest])
