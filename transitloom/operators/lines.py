"""Lines from ordered points, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions import geometry as g


def edge_table(points: DataFrame, key: str, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Edges of the lines through ordered points: start vertex, step, planar length and running start.

    One window per line, whose size is bounded by what the line may hold as a single value.
    """
    line = Window.partitionBy(key)
    w = line.orderBy(order)
    return (
        points.where(F.col(key).isNotNull())
        .select(
            key, F.lag(lon).over(w).alias("x1"), F.lag(lat).over(w).alias("y1"),
            (F.col(lon) - F.lag(lon).over(w)).alias("dx"), (F.col(lat) - F.lag(lat).over(w)).alias("dy"),
            (F.row_number().over(w) - 1).alias("edge_no"),
        )
        .withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
        .withColumn("upto", F.sum("len").over(line.orderBy("edge_no").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.max("upto").over(line))
        .where(F.col("edge_no") > 0)
        .withColumn("start", F.col("upto") - F.col("len"))
        .select(key, "edge_no", "x1", "y1", "dx", "dy", "len", "start", "upto", "total")
    )


def tracks(edges: DataFrame, key: str) -> DataFrame:
    """Edges packed per line, for measuring many points against one line without exploding it."""
    packed = F.sort_array(F.collect_list(F.struct("edge_no", "x1", "y1", "dx", "dy", "len", "start")))
    return edges.groupBy(key).agg(packed.alias("track"))


def make_line(points: DataFrame, key: str, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Ordered points to one line per key."""
    packed = F.sort_array(F.collect_list(F.struct(order, F.col(lon).alias("lon"), F.col(lat).alias("lat"))))
    return points.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("__p")).select(
        key, F.transform("__p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def line_edges(edges: DataFrame, key: str) -> DataFrame:
    """Edge table with both ends, planar and metric lengths and their running starts."""
    rows = edges.select(
        key, "edge_no", "x1", "y1", (F.col("x1") + F.col("dx")).alias("x2"), (F.col("y1") + F.col("dy")).alias("y2"),
        F.col("len").alias("len_deg"), F.col("start").alias("cum_deg"),
    ).withColumn("len_m", g.distance_spheroid("x1", "y1", "x2", "y2"))
    before = Window.partitionBy(key).orderBy("edge_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cum_m", F.coalesce(F.sum("len_m").over(before), F.lit(0.0)))


def locate_points(points: DataFrame, edges: DataFrame, line_key: str, point_keys: list[str],
                  lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Share (0-1) of the planar line length at the spot nearest to each point, first spot on ties.

    Grouping starts with the join key, so the minimum is taken in the stage of the join.
    """
    along = (F.col(lon) - F.col("x1")) * F.col("dx") + (F.col(lat) - F.col("y1")) * F.col("dy")
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    foot = F.coalesce(F.greatest(F.least(F.try_divide(along, square), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    away_x, away_y = F.col("__x") - F.col(lon), F.col("__y") - F.col(lat)
    spots = (
        points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .join(edges, line_key)
        .withColumn("__t", foot)
        .withColumn("__x", F.col("x1") + F.col("__t") * F.col("dx"))
        .withColumn("__y", F.col("y1") + F.col("__t") * F.col("dy"))
        .select(
            line_key, *point_keys, (away_x * away_x + away_y * away_y).alias("d2"),
            F.least(F.coalesce(F.try_divide(F.col("start") + F.col("__t") * F.col("len"), F.col("total")), F.lit(0.0)),
                    F.lit(1.0)).alias("share"),
        )
    )
    nearest = F.min(F.struct("d2", "share"))
    return spots.groupBy(line_key, *point_keys).agg(nearest.alias("__n")).select(
        line_key, *point_keys, F.col("__n.share").alias("share"))


def cut_lines(parts: DataFrame, edges: DataFrame, line_key: str, part_keys: list[str],
              share1: str = "perc1", share2: str = "perc2") -> DataFrame:
    """Sub-lines between two shares: geometry, ellipsoidal length, vertex count, and running lengths at the vertices in metres and degrees.

    Reversed or unknown shares give no row; equal shares give a single point. Vertices closer to an
    end than 1e-12 of the line are not repeated.
    """
    d1, d2 = F.col(share1) * F.col("total"), F.col(share2) * F.col("total")
    slack = F.lit(g.SAME_SPOT) * F.col("total")
    spans = (F.col("upto") > d1 + slack) & (F.col("start") < d2 - slack)
    holds = (F.col(share1) == F.col(share2)) & (d1 <= F.col("upto")) & ((d1 > F.col("start")) | (F.col("edge_no") == 1))
    at = lambda d: F.coalesce(F.try_divide(d - F.col("start"), F.col("len")), F.lit(0.0))
    pieces = (
        parts.where(F.col(share1) <= F.col(share2)).join(edges, line_key).where(spans | holds)
        .withColumn("__a", at(F.greatest(F.col("start"), d1)))
        .withColumn("__b", at(F.least(F.col("upto"), d2)))
        .select(
            line_key, *part_keys, "edge_no", (F.col(share1) == F.col(share2)).alias("__same"),
            (F.col("x1") + F.col("dx") * F.col("__a")).alias("ax"), (F.col("y1") + F.col("dy") * F.col("__a")).alias("ay"),
            (F.col("x1") + F.col("dx") * F.col("__b")).alias("bx"), (F.col("y1") + F.col("dy") * F.col("__b")).alias("by"),
        )
        .withColumns({"m": g.distance_spheroid("ax", "ay", "bx", "by"), "deg": g.distance_planar("ax", "ay", "bx", "by")})
    )
    # running sums before the pieces are packed: the window and the grouping share their exchange
    along = Window.partitionBy(line_key, *part_keys).orderBy("edge_no").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumns({"run_m": F.sum("m").over(along), "run_deg": F.sum("deg").over(along)})
    grouped = pieces.groupBy(line_key, *part_keys).agg(
        F.sort_array(F.collect_list(F.struct("edge_no", "ax", "ay", "bx", "by", "run_m", "run_deg"))).alias("__p"),
        F.sum("m").alias("seg_length"), F.bool_and("__same").alias("__same"),
    )
    starts = F.transform("__p", lambda p: F.struct(p["ax"].alias("lon"), p["ay"].alias("lat")))
    last = F.element_at("__p", -1)
    end = F.struct(last["bx"].alias("lon"), last["by"].alias("lat"))

    def running(name: str) -> Column:
        sums = F.concat(F.array(F.lit(0.0)), F.transform("__p", lambda p: p[name]))
        return F.when(F.col("__same"), F.array(F.lit(0.0))).otherwise(sums).alias(name)

    return grouped.select(
        line_key, *part_keys,
        F.when(F.col("__same"), F.slice(starts, 1, 1)).otherwise(F.concat(starts, F.array(end))).alias("seg_geom"),
        F.when(F.col("__same"), F.lit(0.0)).otherwise(F.col("seg_length")).alias("seg_length"),
        running("run_m"), running("run_deg"),
    ).withColumns({"no_points": g.num_points("seg_geom"), "geom_key": g.geometry_key("seg_geom")})


def dump_points(df: DataFrame, line: str) -> DataFrame:
    """One row per vertex, numbered from 1."""
    rest = [c for c in df.columns if c != line]
    return df.select(*rest, F.posexplode(line).alias("__i", "point")).select(
        *rest, (F.col("__i") + 1).alias("point_sequence"), "point"
    )


def running_length(points: DataFrame, keys: list[str], order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Running ellipsoidal length along ordered points, by a running sum rather than growing arrays."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = g.distance_spheroid(F.lag(lon).over(w), F.lag(lat).over(w), F.col(lon), F.col(lat))
    return points.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn(
        "run_m", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__step")


def collect_lines(segments: DataFrame, by: str = "route_id") -> DataFrame:
    """All segment lines of a route as a multi-line, kept exploded: one row per distinct line.

    ``copies`` says how many trips drive it. A busy route owns an unbounded number of segments, so
    they are never gathered into one value.
    """
    return (
        counted_lines(segments, by, "stop1_id", "stop2_id", "geom_key", measures={"seg_length": F.max("seg_length")})
        .groupBy(by, "stop1_id", "stop2_id", "geom_key")
        .agg(
            F.sum("copies").alias("copies"),
            F.max("seg_length").alias("seg_length"),
            F.max_by("seg_geom", "copies").alias("seg_geom"),
        )
    )


def counted_lines(segments: DataFrame, *keys: str | Column, measures: dict[str, Column] | None = None) -> DataFrame:
    """Segments with a line, one row per keys and line, with their number (``copies``).

    The line is a key here: picking one of many makes Spark sort all rows with their lines, while equal keys
    collapse in a hash table. What is left is picked from later, by ``copies``: an aggregate that any row would do for is
    merged with this one by the planner.
    """
    return segments.where(F.col("seg_geom").isNotNull()).groupBy(*keys, "seg_geom").agg(
        F.count("*").alias("copies"), *[c.alias(n) for n, c in (measures or {}).items()])


def segment_geometries(segments: DataFrame) -> DataFrame:
    """Geometry dimension: one line per (stop pair, geometry key)."""
    return (
        counted_lines(segments, "stop1_id", "stop2_id", "geom_key")
        .groupBy("stop1_id", "stop2_id", "geom_key")
        .agg(F.max_by("seg_geom", "copies").alias("geom"))
    )


def attach_geometry(layer: DataFrame, geometries: DataFrame, stop1: str, stop2: str, *more: str) -> DataFrame:
    """Add the line (and further columns of it) to a layer; grouping works on the short key, not on coordinate arrays."""
    dim = geometries.select(F.col("stop1_id").alias(stop1), F.col("stop2_id").alias(stop2), "geom_key", "geom", *more)
    return layer.join(dim, [stop1, stop2, "geom_key"], "left")
