"""Composite layers and the full refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.operators import layers as y
from transitloom.operators import lines as l
from transitloom.operators import spatial as sp
from transitloom.operators.timetable import bus_only, route_trip_counts


def route_layer(routes: DataFrame, trips: DataFrame, segments: DataFrame) -> DataFrame:
    """Bus routes with trip counts and the size of their multi-line; routes without geometry drop out.

    The lines themselves are ``route_lines``: one row per distinct line of a route.
    """
    drawn = segments.where(F.col("seg_geom").isNotNull()).groupBy("route_id").agg(
        F.count("*").alias("num_lines"), (F.sum("seg_length") / 1000).alias("total_length_km"))
    return route_trip_counts(trips, routes).join(drawn, "route_id").select(
        "route_id", "route_short_name", "route_long_name", "route_type", "num_trips", "num_lines", "total_length_km")


def route_lines(routes: DataFrame, segments: DataFrame) -> DataFrame:
    return l.collect_lines(bus_only(segments, routes))


Stage = Callable[[DataFrame], DataFrame]


def poi_population_overlay(pois: DataFrame, areas: DataFrame, segments: DataFrame, stops: DataFrame,
                           stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stage: Stage = lambda df: df) -> DataFrame:
    """How each point of interest is tied to dense areas by bus, and the service around it.

    ``stage`` stores the table of lines in use, the dense areas and the links, which are read several times.
    """
    dense, usage = stage(sp.high_density_areas(areas)), stage(sp.segment_usage(segments))
    near = sp.routes_near_pois(pois, stops, stop_times, trips, routes)
    through = sp.routes_through_areas(usage, routes, dense)
    stats = sp.poi_connectivity_stats(stage(sp.poi_area_connectivity(near, through, dense, usage)))
    around = sp.poi_transit_coverage(pois, usage, routes)
    return sp.connectivity_score(stats.join(around, "poi_id", "left"))


def connecting_routes(pois: DataFrame, areas: DataFrame, segments: DataFrame, stops: DataFrame,
                      stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stage: Stage = lambda df: df) -> DataFrame:
    """Every bus route that links a point of interest with a dense area, with its full extent."""
    dense, usage = stage(sp.high_density_areas(areas)), stage(sp.segment_usage(segments))
    near = sp.routes_near_pois(pois, stops, stop_times, trips, routes)
    through = sp.routes_through_areas(usage, routes, dense)
    extent = sp.route_lengths(bus_only(usage, routes)).select(
        "route_id", F.col("connecting_segments").alias("num_segments"), F.col("direct_route_length_km").alias("total_route_length_km"))
    return (
        near.join(through, "route_id")
        .join(dense.select("id", "population_density"), "id")
        .join(extent, "route_id")
        .join(routes.select("route_id", "route_short_name", "route_long_name"), "route_id")
        .select(
            "poi_id", F.col("name").alias("poi_name"), "team", F.col("id").alias("area_id"), "population_density",
            "route_id", "route_short_name", "route_long_name", "num_segments", "total_route_length_km",
        )
    )


def trips_per_route(layer: DataFrame, n: int = 20) -> DataFrame:
    """Routes with the most trips and a label for them."""
    from transitloom.functions.scalars import truncate_label
    from transitloom.operators.ordering import top_n

    label = F.concat_ws(" - ", "route_short_name", truncate_label("route_long_name", 30, "..."))
    return top_n(layer, n, "-num_trips!", "route_id").select("route_id", label.alias("label"), "num_trips")


def refresh_all(builders: dict[str, Callable[[], DataFrame]], write: Callable[[DataFrame, str], int]) -> dict[str, str]:
    """Build and store every view in order; one that fails does not stop the rest."""
    status = {}
    for name, build in builders.items():
        try:
            status[name] = f"ok: {write(build(), name)} rows"
        except Exception as problem:  # noqa: BLE001 - the status is the result
            status[name] = f"failed: {type(problem).__name__}: {problem}".removesuffix(": ")
    return status
