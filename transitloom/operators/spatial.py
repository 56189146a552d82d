"""Spatial joins as grid-cell equi-joins, and the layers built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions import geometry as g
from transitloom.functions import scalars as s
from transitloom.functions.statistics import exact_percentiles, percentile_value
from transitloom.operators.lines import counted_lines
from transitloom.operators.timetable import bus_only

# ---- fixed values -------------------------------------------------------------------------
NEAR_M = 600.0
POINT_CELL = 0.01
AREA_CELL = 0.02
# -------------------------------------------------------------------------------------------


def stops_with_bus(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Stops some bus trip calls at."""
    served = bus_only(trips.select("trip_id", "route_id"), routes).select("trip_id")
    return stop_times.select("trip_id", "stop_id").join(served, "trip_id", "left_semi").select("stop_id").distinct()


def exists_bus_service(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    return stops.join(stops_with_bus(stop_times, trips, routes), "stop_id", "left_semi")


def near_points(pois: DataFrame, stops: DataFrame, radius_m: float = NEAR_M, spheroid: bool = False,
                cell: float = POINT_CELL) -> DataFrame:
    """Stops within a distance of each point of interest, with the distance.

    A point of interest is listed under every cell its search box touches and a stop under its own
    cell, so this is an equi-join however many points there are.
    """
    north = radius_m / 110_000.0
    east = F.lit(radius_m / 110_000.0) / F.greatest(F.cos(F.radians("latitude")), F.lit(1e-6))
    boxed = pois.withColumn("__cell", F.explode(g.grid_cells(
        F.col("longitude") - east, F.col("latitude") - north,
        F.col("longitude") + east, F.col("latitude") + north, cell)))
    placed = stops.withColumn("__cell", F.struct(
        F.floor(F.col("stop_lon") / cell).alias("cx"), F.floor(F.col("stop_lat") / cell).alias("cy")))
    measure = g.distance_spheroid if spheroid else g.distance_sphere
    return (
        boxed.join(placed, "__cell").drop("__cell")
        .withColumn("distance_m", measure("longitude", "latitude", "stop_lon", "stop_lat"))
        .where(F.col("distance_m") <= radius_m)
    )


def poi_proximity(pois: DataFrame, stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame,
                  radius_m: float = NEAR_M) -> DataFrame:
    """Bus stops within a great-circle distance of each point of interest."""
    near = near_points(pois, stops, radius_m)
    return exists_bus_service(near, stop_times, trips, routes).select(
        F.col("name").alias("poi_name"), "team", "stop_id", "stop_name", "stop_lon", "stop_lat", "distance_m"
    )


def routes_near_pois(pois: DataFrame, stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame,
                     radius_m: float = NEAR_M) -> DataFrame:
    """Bus routes with a stop within an ellipsoidal distance of each point of interest."""
    near = near_points(pois, stops, radius_m, spheroid=True).select("poi_id", "name", "team", "longitude", "latitude", "stop_id")
    calls = stop_times.select("trip_id", "stop_id").join(near.select("stop_id").distinct(), "stop_id", "left_semi")
    served = calls.join(bus_only(trips.select("trip_id", "route_id"), routes), "trip_id").select("stop_id", "route_id").distinct()
    return near.join(served, "stop_id").select("poi_id", "name", "team", "longitude", "latitude", "route_id").distinct()


def area_cover(areas: DataFrame, area_key: str, geom: str = "geom", cell: float = AREA_CELL) -> DataFrame:
    """The grid cells of polygons: a row (area, ``__cell``) with the boundary edges near the cell and whether the
    area covers the cell's reference point. Cells an area neither covers nor borders have no row.

    Edges are dealt out one by one, so no whole boundary is ever moved or copied. Which reference points
    are inside is read off the crossings of each row of the grid: between the first and the
    second, the third and the fourth, and so on.
    """
    edges = areas.select(area_key, F.explode(g.ring_edges(geom)).alias("e"))
    near = edges.select(area_key, F.explode(g.edge_cells("e", cell)).alias("__cell"), "e", F.lit(False).alias("inside"))
    crossed = edges.select(area_key, F.inline(g.edge_rows("e", cell)))
    along = Window.partitionBy(area_key, "cy").orderBy("x")
    runs = crossed.withColumns({"__n": F.row_number().over(along), "__until": F.lead("x").over(along)}).where(F.col("__n") % 2 == 1)
    filled = runs.select(area_key, "cy", F.explode(g.columns_between("x", "__until", cell)).alias("cx")).select(
        area_key, F.struct("cx", "cy").alias("__cell"), F.lit(None).cast(near.schema["e"].dataType).alias("e"), F.lit(True).alias("inside"))
    return near.unionByName(filled).groupBy(area_key, "__cell").agg(
        F.collect_list("e").alias("edges"), F.bool_or("inside").alias("inside"))


def line_polygon_intersects(lines: DataFrame, line_keys: list[str], cover: DataFrame, area_key: str,
                            geom: str = "seg_geom", cell: float = AREA_CELL) -> DataFrame:
    """Pairs of lines and areas that meet, with the length of the line inside.

    ``cover`` comes from ``area_cover`` with the same cell size. Line edges are cut at the grid lines, and each
    piece meets the areas of its one cell and only the boundary edges there. The pieces of an edge
    that lie inside are put together again before they are measured. A line that is a single point
    is tested as an edge of length zero.
    """
    point = F.get(F.col(geom), F.lit(0))
    lone = F.array(F.struct(point["lon"].alias("x1"), point["lat"].alias("y1"), point["lon"].alias("x2"), point["lat"].alias("y2")))
    edges = lines.select(
        *line_keys, F.posexplode(F.when(F.size(geom) > 1, g.vertex_pairs(geom)).when(F.size(geom) == 1, lone)).alias("__no", "e"))
    pieces = edges.select(*line_keys, "__no", "e", F.explode(g.cell_pieces("e.x1", "e.y1", "e.x2", "e.y2", cell)).alias("p")).select(
        *line_keys, "__no", "e", "p.a", "p.b", F.struct("p.cx", "p.cy").alias("__cell"))

    def covers(t: Column) -> Column:
        return g.covers_from("edges", "inside", g.cell_x("__cell.cx", cell), g.cell_y("__cell.cy", cell),
                             g.at_share("e.x1", "e.x2", t), g.at_share("e.y1", "e.y2", t))

    # columns that are used more than once are made step by step, so each is computed once
    pairs = pieces.join(cover, "__cell").withColumn("cuts", F.when(
        F.size("edges") > 0, g.cuts_between("edges", "e.x1", "e.y1", "e.x2", "e.y2", "a", "b")))
    pairs = pairs.withColumn("covered", F.when(F.col("cuts").isNull(), F.array(F.struct("a", "b"))).otherwise(g.covered_shares("cuts", covers)))
    found = pairs.select(*line_keys, area_key, "__no", "e", F.when(F.size("covered") > 0, F.col("covered")).otherwise(
        g.touched_share("cuts", covers)).alias("spans"))
    # dealt out by line and area once, which serves both sums
    by_edge = found.repartition(*line_keys, area_key).groupBy(*line_keys, area_key, "__no").agg(
        F.any_value("e").alias("e"), F.flatten(F.collect_list("spans")).alias("spans"))
    return by_edge.where(F.size("spans") > 0).groupBy(*line_keys, area_key).agg(
        F.sum(g.shares_length_m("spans", "e.x1", "e.y1", "e.x2", "e.y2")).alias("inside_m"))


LINE = ["segment_id", "geom_key"]


def distinct_segments(segments: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Distinct (segment key, geometry) of bus segments, with how often each occurs."""
    rows = segments.where(F.col("seg_geom").isNotNull())
    rows = bus_only(rows, routes) if routes is not None else rows
    return counted_lines(rows.withColumn("segment_id", s.segment_key("stop1_id", "stop2_id")), *LINE).groupBy(*LINE).agg(
        F.sum("copies").alias("copies"), F.max_by("seg_geom", "copies").alias("seg_geom"))


def segment_usage(segments: DataFrame) -> DataFrame:
    """Per route, distinct (segment key, geometry) with how often the route uses it and the metres that makes.

    A layer that looks at the segments in several ways stores this, a row for each route and line, and reads no trip twice.
    """
    keys = ["route_id", "segment_id", "geom_key"]
    rows = segments.withColumn("segment_id", s.segment_key("stop1_id", "stop2_id"))
    return counted_lines(rows, *keys, measures={"metres": F.sum("seg_length")}).groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.sum("metres").alias("metres"), F.max_by("seg_geom", "copies").alias("seg_geom"))


def used_lines(usage: DataFrame) -> DataFrame:
    """The distinct lines of a usage table, as ``distinct_segments`` finds them in the segments."""
    return usage.groupBy(*LINE).agg(F.sum("copies").alias("copies"), F.any_value("seg_geom").alias("seg_geom"))


def population_layer(areas: DataFrame) -> DataFrame:
    """Areas with a positive density and their ellipsoidal size."""
    return areas.where(F.col("geom").isNotNull() & (F.col("population_density") > 0)).select(
        "id", "population_density", (g.area_m2("geom") / 1e6).alias("area_km2"), "geom"
    )


def poi_layer(pois: DataFrame) -> DataFrame:
    return pois.select(
        F.col("name").alias("poi_name"), "team", "latitude", "longitude", g.make_point("longitude", "latitude").alias("geom")
    )


def population_coverage(segments: DataFrame, routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Per area: distinct bus segments, kilometres inside it, kilometres per square kilometre."""
    usable = areas.where(F.col("geom").isNotNull() & F.col("population_density").isNotNull() & F.col("a").isNotNull())
    met = line_polygon_intersects(distinct_segments(segments, routes), LINE, area_cover(usable, "id"), "id")
    per_area = met.groupBy("id").agg(
        F.countDistinct("segment_id").alias("num_segments"), (F.sum("inside_m") / 1000).alias("route_length_km")
    )
    return (
        usable.select("id", "population_density", F.col("a").cast("double").alias("area_km2"))
        .join(per_area, "id", "left")
        .withColumns({
            "num_segments": F.coalesce("num_segments", F.lit(0)),
            "route_length_km": F.coalesce("route_length_km", F.lit(0.0)),
        })
        .withColumn("route_density_km_per_km2", F.try_divide("route_length_km", "area_km2"))
    )


def high_density_areas(areas: DataFrame, share: float = 0.75) -> DataFrame:
    """Areas whose density lies above a percentile of all densities."""
    limit = percentile_value(areas, "population_density", share)
    return areas.where(F.col("geom").isNotNull() & (F.col("population_density") > limit))


def routes_through_areas(usage: DataFrame, routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Bus routes meeting each area. Geometry is tested once per distinct segment, not per route or trip."""
    used = bus_only(usage, routes)
    met = line_polygon_intersects(used_lines(used), LINE, area_cover(areas, "id"), "id").select(*LINE, "id")
    return used.select(*LINE, "route_id").join(met, LINE).select("id", "route_id").distinct()


def route_lengths(usage: DataFrame) -> DataFrame:
    return usage.groupBy("route_id").agg(
        F.countDistinct("segment_id").alias("connecting_segments"),
        (F.coalesce(F.sum("metres"), F.lit(0.0)) / 1000).alias("direct_route_length_km"),
    )


def poi_area_connectivity(near_routes: DataFrame, through: DataFrame, areas: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per (point of interest, dense area, connecting route), with route statistics."""
    facts = areas.select("id", "population_density", F.col("pop").cast("double").alias("population"),
                         g.centroid("geom").alias("__c"))
    return (
        near_routes.join(through, "route_id")
        .join(facts, "id")
        .join(route_lengths(usage), "route_id", "left")
        .select(
            "poi_id", F.col("name").alias("poi_name"), "team", F.col("id").alias("area_id"),
            "population_density", "population", "route_id",
            F.coalesce("connecting_segments", F.lit(0)).alias("connecting_segments"),
            F.coalesce("direct_route_length_km", F.lit(0.0)).alias("direct_route_length_km"),
            g.distance_sphere("longitude", "latitude", F.col("__c.lon"), F.col("__c.lat")).alias("distance_m"),
        )
    )


def poi_connectivity_stats(connectivity: DataFrame) -> DataFrame:
    """Connectivity per point of interest. An area's people count once per connecting route, as the
    layer has always summed them; ``population_distinct`` counts each area once."""
    linked = F.col("connecting_segments") > 0
    keys = ["poi_id", "poi_name", "team"]
    per_area = connectivity.groupBy(*keys, "area_id").agg(
        F.max(F.when(linked, F.col("population"))).alias("__p"),
    ).groupBy(*keys).agg(F.sum("__p").alias("population_distinct"))
    stats = connectivity.groupBy(*keys).agg(
        F.countDistinct(F.when(linked, F.col("area_id"))).alias("num_high_density_areas_connected"),
        F.sum(F.when(linked, F.col("population")).otherwise(0.0)).alias("total_population_connected"),
        F.avg(F.when(linked, F.col("population_density"))).alias("avg_density_connected"),
        F.max(F.when(linked, F.col("population_density"))).alias("max_density_connected"),
        F.sum("connecting_segments").alias("total_connecting_segments"),
        F.sum("direct_route_length_km").alias("total_route_length_km"),
        F.avg("distance_m").alias("avg_distance_to_dense_areas_m"),
        F.min("distance_m").alias("nearest_dense_area_distance_m"),
    )
    return stats.join(per_area, keys, "left")


def poi_buffer_intersects(pois: DataFrame, usage: DataFrame, routes: DataFrame, radius_m: float = NEAR_M) -> DataFrame:
    """Distinct segments meeting the buffer of each point of interest; buses, or routes without a record."""
    known = routes.select("route_id", "route_type")
    rows = usage.join(known, "route_id", "left").where((F.col("route_type") == s.BUS) | F.col("route_type").isNull())
    discs = pois.select("poi_id", g.buffer_polygon("longitude", "latitude", radius_m).alias("geom"))
    lines = used_lines(rows)
    met = line_polygon_intersects(lines, [*LINE, "copies"], area_cover(discs, "poi_id"), "poi_id")
    return pois.select("poi_id").join(met, "poi_id", "left")


def poi_transit_coverage(pois: DataFrame, usage: DataFrame, routes: DataFrame, radius_m: float = NEAR_M) -> DataFrame:
    return poi_buffer_intersects(pois, usage, routes, radius_m).groupBy("poi_id").agg(
        F.countDistinct("segment_id").alias("num_segments_near_poi"),
        F.coalesce(F.sum(F.col("inside_m") * F.col("copies")) / 1000, F.lit(0.0)).alias("route_length_km_near_poi"),
    )


def connectivity_score(stats: DataFrame) -> DataFrame:
    """Segments per million connected people, 0 without people; missing measures become 0."""
    score = F.when(
        F.col("total_population_connected") > 0,
        F.col("total_connecting_segments") / (F.col("total_population_connected") / 1e6),
    ).otherwise(F.lit(0.0))
    measures = [c for c in stats.columns if c not in ("poi_id", "poi_name", "team")]
    return stats.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in measures}, "connectivity_score_segments_per_million": score
    })


def poi_access(proximity: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Per point of interest: stops, bus routes, trips and the nearest stop."""
    calls = stop_times.select("trip_id", "stop_id").join(proximity.select("stop_id").distinct(), "stop_id", "left_semi")
    calls = calls.join(bus_only(trips.select("trip_id", "route_id"), routes), "trip_id").distinct()
    return proximity.join(calls, "stop_id").groupBy("poi_name", "team").agg(
        F.countDistinct("stop_id").alias("stops_600m"),
        F.countDistinct("route_id").alias("unique_routes_600m"),
        F.countDistinct("trip_id").alias("trips_per_day"),
        F.min("distance_m").alias("nearest_stop_distance_m"),
    )


def stop_poi_count(proximity: DataFrame) -> DataFrame:
    """Near stops with the number of points of interest each is near."""
    counts = proximity.groupBy("stop_id").agg(F.countDistinct("poi_name").alias("poi_count"))
    return proximity.join(counts, "stop_id")


# ---- density measures ---------------------------------------------------------------------
def density_category_stats(coverage: DataFrame) -> DataFrame:
    """Means per density class; classes without areas are listed."""
    label = s.bin_right_closed("population_density", s.DENSITY_EDGES, s.DENSITY_CATEGORY, low=0.0)
    stats = coverage.groupBy(label.alias("density_category")).agg(
        F.avg("route_density_km_per_km2").alias("mean_route_density"),
        F.avg("num_segments").alias("mean_segments"),
        F.avg("population_density").alias("mean_population_density"),
    )
    frame = coverage.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(s.DENSITY_CATEGORY)], "rank int, density_category string")
    return frame.join(stats, "density_category", "left")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; NULL when either side does not vary."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return both.agg(F.try_divide(F.covar_pop(x, y), spread).alias("correlation"))


def quantile_trim(df: DataFrame, cols: list[str], share: float = 0.95) -> DataFrame:
    """Rows strictly below a percentile of every listed column."""
    limits = [F.col(c) < percentile_value(df, c, share) for c in cols]
    for below in limits:
        df = df.where(below)
    return df


def coverage_flags(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count("*").alias("areas"),
        F.count_if(F.col("num_segments") > 0).alias("with_transit"),
        F.count_if(F.col("num_segments") == 0).alias("without_transit"),
    )


def box_stats(df: DataFrame, value: str, key: str) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers (nearest values inside the fences) per group."""
    q = exact_percentiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [key])
    spread = F.col("q3") - F.col("q1")
    fenced = df.where(F.col(value).isNotNull()).join(q, key).where(
        F.col(value).between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread))
    whiskers = fenced.groupBy(key).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(whiskers, key)
