"""Query registry, and the SQL building blocks of the checks.

The SQL is an independent formulation: plain windows, edge joins and half-plane clipping where the
DataFrame side uses pre-aggregation, sliced lookups and polygon expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.standins import Transit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def comparable(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Whole numbers as bigint and rounded doubles, so both engines can be compared by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INTEGRAL):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits.get(f.name, 6))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def with_ctes(body: str) -> str:
    """Prefix a statement with the CTEs it names, directly or through another one."""
    order: list[str] = []

    def need(text: str, stack: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in order and word not in stack:
                need(CTES[word], (*stack, word))
                order.append(word)

    need(body)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body.strip()


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def add(name: str, build: Callable[[Transit], DataFrame], sql: str | None = None, **digits: int) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(build(Transit(spark, folder)), digits)

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# ---- stand-in tables ----------------------------------------------------------------------
cte("x_routes", """
SELECT CAST(n_nationkey AS VARCHAR) AS route_id, CAST(n_regionkey AS VARCHAR) AS agency_id,
  n_name AS route_short_name, concat(n_name, ' line') AS route_long_name,
  CASE WHEN n_nationkey % 8 = 7 THEN '1' ELSE '3' END AS route_type FROM nation""")
cte("x_stops", """
SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS stop_name,
  CASE WHEN s_suppkey % 4 = 0 THEN 49.27596e0 + ((s_suppkey * 37) % 101 - 50) * 1e-4
       ELSE 49e0 + ((s_suppkey * 37) % 1000) / 1900e0 END AS stop_lat,
  CASE WHEN s_suppkey % 4 = 0 THEN -123.11274e0 + ((s_suppkey * 91) % 101 - 50) * 2e-4
       ELSE -123.3e0 + ((s_suppkey * 91) % 1000) / 980e0 END AS stop_lon FROM supplier""")
cte("x_trips", """
SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_custkey % 25 AS VARCHAR) AS route_id,
  substr(o_orderpriority, 1, 1) AS service_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 25 AS VARCHAR) END AS shape_id FROM orders""")
cte("x_calls", """
SELECT s.l_orderkey, s.l_linenumber, CAST(s.l_orderkey AS VARCHAR) AS trip_id, s.stop_sequence,
  CAST(((o.o_custkey % 25) * 7 + s.stop_sequence * 3) % (SELECT count(*) FROM supplier) AS VARCHAR) AS stop_id,
  21600 + (s.l_orderkey * 7 % 1080) * 60 + s.stop_sequence * 240 + s.p % 60 AS arrival_seconds
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stop_sequence
      FROM lineitem GROUP BY l_orderkey, l_linenumber) s
JOIN orders o ON o.o_orderkey = s.l_orderkey""")
cte("x_stop_times", "SELECT trip_id, stop_sequence, stop_id, arrival_seconds FROM x_calls")
cte("x_updates", """
SELECT concat(c.trip_id, '_20240108') AS trip_instance_id, c.trip_id, t.route_id, c.stop_sequence, c.stop_id,
  l.l_shipdate AS fetch_timestamp, l.l_partkey AS tie1, l.l_suppkey AS tie2,
  1704700800 + c.arrival_seconds + (CAST(l.l_quantity AS INT) * 20 - 500) AS arrival_epoch,
  CAST(nullif(CAST(l.l_quantity AS INT) * 20 - 500, 0) AS BIGINT) AS delay
FROM lineitem l JOIN x_calls c ON c.l_orderkey = l.l_orderkey AND c.l_linenumber = l.l_linenumber
JOIN x_trips t ON t.trip_id = c.trip_id""")
cte("x_positions", """
SELECT concat(CAST(user_id AS VARCHAR), '_', strftime(ts, '%Y-%m-%d')) AS trip_instance_id,
  CAST(user_id AS VARCHAR) AS vehicle_id, CAST(user_id * 3 AS VARCHAR) AS trip_id, CAST(user_id % 25 AS VARCHAR) AS route_id,
  ts AS fetch_timestamp, date_trunc('hour', ts) AS entity_timestamp, event_id AS tie1,
  -123.3e0 + (user_id % 50) * 0.02e0 + value * 1e-4 AS longitude, 49e0 + (event_id % 500) * 1e-3 AS latitude FROM events""")
cte("x_shapes", """
SELECT shape_id, i, lon, lat FROM (
  SELECT CAST(a.r AS VARCHAR) AS shape_id, a.k * 2 - 1 AS i, a.stop_lon AS lon, a.stop_lat AS lat FROM x_shape_stops a
  UNION ALL
  SELECT CAST(a.r AS VARCHAR), a.k * 2, (a.stop_lon + b.stop_lon) / 2, (a.stop_lat + b.stop_lat) / 2 + 0.0005e0
  FROM x_shape_stops a JOIN x_shape_stops b ON a.r = b.r AND b.k = a.k + 1)""")
cte("x_shape_stops", """
SELECT n_nationkey AS r, k, stop_lon, stop_lat
FROM nation CROSS JOIN range(1, 8) g(k)
JOIN x_stops ON stop_id = CAST((n_nationkey * 7 + k * 3) % (SELECT count(*) FROM supplier) AS VARCHAR)""")
cte("x_calendar", """
SELECT service_id, DATE '2024-01-01' AS start_date, DATE '2024-01-01' + CAST(count(*) % 60 + 30 AS INTEGER) AS end_date
FROM x_trips GROUP BY service_id""")
cte("x_calendar_dates", """
SELECT DISTINCT substr(o_orderpriority, 1, 1) AS service_id, DATE '2024-01-01' + CAST(o_custkey % 40 * 3 + 1 AS INTEGER) AS date,
  CASE WHEN (o_custkey % 40 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) % 8 = 5 THEN 2 ELSE 1 END AS exception_type FROM orders""")
E2 = 0.0066943799901413165


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    """Mid-latitude ellipsoid distance as SQL."""
    x1, y1, x2, y2 = (f"({v})" for v in (x1, y1, x2, y2))
    w = f"(1 - {E2} * pow(sin(radians(({y1} + {y2}) / 2)), 2))"
    north = f"6335439.3272928195 / pow({w}, 1.5) * radians({y2} - {y1})"
    east = f"6378137.0 / sqrt({w}) * cos(radians(({y1} + {y2}) / 2)) * radians({x2} - {x1})"
    return f"sqrt(pow({north}, 2) + pow({east}, 2))"


def sphere(x1: str, y1: str, x2: str, y2: str) -> str:
    x1, y1, x2, y2 = (f"({v})" for v in (x1, y1, x2, y2))
    return (f"2 * 6371008.77141506 * asin(sqrt(least(1, pow(sin(radians({y2} - {y1}) / 2), 2) + "
            f"cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))")


def authalic(y: str) -> str:
    e = 0.08181919084262149
    return (f"({1 - E2} * (sin(radians({y})) / (1 - {E2} * pow(sin(radians({y})), 2)) - "
            f"ln((1 - {e} * sin(radians({y}))) / (1 + {e} * sin(radians({y})))) / {2 * e}))")


cte("x_areas", f"""
SELECT *, (x2 - x1) * pi() / 180 * 6378137.0 * 6378137.0 / 2 * ({authalic('y2')} - {authalic('y1')}) / 1e6 AS a,
  pop / ((x2 - x1) * pi() / 180 * 6378137.0 * 6378137.0 / 2 * ({authalic('y2')} - {authalic('y1')}) / 1e6) AS population_density
FROM (SELECT n_nationkey AS id, 500e0 * (1 + (n_nationkey * 37) % 50) AS pop,
  -123.3e0 + (n_nationkey % 5) * 0.2e0 AS x1, 49e0 + floor(n_nationkey / 5e0) * 0.1e0 AS y1,
  -123.3e0 + (n_nationkey % 5 + 1) * 0.2e0 AS x2, 49e0 + (floor(n_nationkey / 5e0) + 1) * 0.1e0 AS y2 FROM nation)""")
cte("x_pois", """
SELECT * FROM (VALUES (1, 'BC Place', 'Vancouver Whitecaps/BC Lions', 49.27596e0, -123.11274e0),
  (2, 'Rogers Arena', 'Vancouver Canucks', 49.277821e0, -123.109085e0),
  (3, 'Pacific Coliseum', 'Vancouver Giants', 49.2848e0, -123.0390e0)) v(poi_id, name, team, latitude, longitude)""")

# ---- network ------------------------------------------------------------------------------
cte("x_transit_stops", """
SELECT t.trip_id, t.route_id, t.service_id, t.shape_id, s.stop_sequence, s.stop_id, s.arrival_seconds,
  max(s.stop_sequence) OVER (PARTITION BY t.trip_id) AS num_stops,
  CASE WHEN t.shape_id IS NULL THEN 'trip:' || t.trip_id ELSE 'shape:' || t.shape_id END AS line_id
FROM x_trips t JOIN x_stop_times s ON s.trip_id = t.trip_id""")
cte("x_line_points", """
SELECT 'shape:' || shape_id AS line_id, i, lon, lat FROM x_shapes
UNION ALL
SELECT line_id, stop_sequence, stop_lon, stop_lat FROM x_transit_stops JOIN x_stops USING (stop_id) WHERE shape_id IS NULL""")
cte("x_steps", """
SELECT line_id, i, lon, lat, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1, lon - lag(lon) OVER w AS dx, lat - lag(lat) OVER w AS dy,
  row_number() OVER w - 1 AS edge_no
FROM x_line_points WINDOW w AS (PARTITION BY line_id ORDER BY i)""")
cte("x_edges", """
SELECT *, upto - len AS start, max(upto) OVER (PARTITION BY line_id) AS total FROM (
  SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY edge_no ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT line_id, edge_no, x1, y1, dx, dy, sqrt(dx * dx + dy * dy) AS len FROM x_steps WHERE x1 IS NOT NULL))""")
cte("x_spots", """
SELECT line_id, stop_id, share FROM (
  SELECT line_id, stop_id, least((start + t * len) / nullif(total, 0), 1) AS share,
    pow(x1 + t * dx - stop_lon, 2) + pow(y1 + t * dy - stop_lat, 2) AS d2, edge_no
  FROM (SELECT p.line_id, p.stop_id, p.stop_lon, p.stop_lat, e.x1, e.y1, e.dx, e.dy, e.start, e.len, e.total, e.edge_no,
          coalesce(greatest(least(((p.stop_lon - e.x1) * e.dx + (p.stop_lat - e.y1) * e.dy) / nullif(e.dx * e.dx + e.dy * e.dy, 0), 1), 0), 0) AS t
        FROM (SELECT DISTINCT line_id, s.stop_id, stop_lon, stop_lat FROM x_transit_stops t JOIN x_stops s ON s.stop_id = t.stop_id) p
        JOIN x_edges e ON e.line_id = p.line_id))
QUALIFY row_number() OVER (PARTITION BY line_id, stop_id ORDER BY d2, edge_no) = 1""")
cte("x_placed", """
SELECT t.*, CASE WHEN p.share IS NULL THEN NULL WHEN t.stop_sequence = 1 THEN 0e0 WHEN t.stop_sequence = t.num_stops THEN 1e0
  ELSE p.share END AS perc
FROM x_transit_stops t LEFT JOIN x_spots p ON p.line_id = t.line_id AND p.stop_id = t.stop_id""")
cte("x_lead", """
SELECT * FROM (
  SELECT trip_id, route_id, service_id, shape_id, line_id, num_stops, stop_sequence AS stop1_sequence, lead(stop_sequence) OVER w AS stop2_sequence,
    stop_id AS stop1_id, lead(stop_id) OVER w AS stop2_id, arrival_seconds AS stop1_arrival, lead(arrival_seconds) OVER w AS stop2_arrival,
    perc AS perc1, lead(perc) OVER w AS perc2
  FROM x_placed WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE stop2_sequence IS NOT NULL""")
cte("x_parts", "SELECT DISTINCT line_id, stop1_id, stop2_id, perc1, perc2 FROM x_lead WHERE perc1 <= perc2")
cte("x_pieces", f"""
SELECT *, {dist('pax', 'pay', 'pbx', 'pby')} AS m FROM (
  SELECT line_id, stop1_id, stop2_id, perc1, perc2, edge_no,
    x1 + dx * (a - start) / len AS pax, y1 + dy * (a - start) / len AS pay, x1 + dx * (b - start) / len AS pbx, y1 + dy * (b - start) / len AS pby
  FROM (SELECT p.*, e.edge_no, e.x1, e.y1, e.dx, e.dy, e.start, e.len, greatest(e.start, p.perc1 * e.total) AS a, least(e.upto, p.perc2 * e.total) AS b
        FROM x_parts p JOIN x_edges e ON e.line_id = p.line_id
        WHERE p.perc1 < p.perc2 AND e.upto > p.perc1 * e.total + 1e-12 * e.total AND e.start < p.perc2 * e.total - 1e-12 * e.total))""")
cte("x_cuts", """
SELECT p.line_id, p.stop1_id, p.stop2_id, p.perc1, p.perc2, coalesce(q.seg_length, 0) AS seg_length, q.no_points, q.geom
FROM x_parts p LEFT JOIN (
  SELECT line_id, stop1_id, stop2_id, perc1, perc2, sum(m) AS seg_length, count(*) + 1 AS no_points,
    string_agg(CAST(round(pax, 9) AS VARCHAR) || ' ' || CAST(round(pay, 9) AS VARCHAR) || ' ' || CAST(round(pbx, 9) AS VARCHAR) || ' ' || CAST(round(pby, 9) AS VARCHAR), ',' ORDER BY edge_no) AS geom
  FROM x_pieces GROUP BY ALL) q
  ON q.line_id = p.line_id AND q.stop1_id = p.stop1_id AND q.stop2_id = p.stop2_id AND q.perc1 = p.perc1 AND q.perc2 = p.perc2""")
cte("x_bad", "SELECT DISTINCT trip_id FROM x_lead WHERE perc1 IS NULL OR perc2 IS NULL OR perc1 > perc2")
cte("x_segments", """
SELECT l.*, c.seg_length, c.no_points, coalesce(c.geom, l.line_id || CAST(l.perc1 AS VARCHAR)) AS geom,
  l.stop2_arrival - l.stop1_arrival AS scheduled_seconds
FROM x_lead l JOIN x_cuts c ON c.line_id = l.line_id AND c.stop1_id = l.stop1_id AND c.stop2_id = l.stop2_id AND c.perc1 = l.perc1 AND c.perc2 = l.perc2
WHERE l.trip_id NOT IN (SELECT trip_id FROM x_bad)""")
cte("x_bus_segments", "SELECT s.*, r.route_short_name FROM x_segments s JOIN x_routes r ON r.route_id = s.route_id WHERE r.route_type = '3'")

cte("x_edge_metres", f"""
SELECT line_id, edge_no, {dist('x1', 'y1', 'x1 + dx', 'y1 + dy')} AS m FROM x_edges""")

# ---- live feed ----------------------------------------------------------------------------
PERIOD = ("CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 'Morning Rush' WHEN hour_of_day BETWEEN 16 AND 18 THEN 'Evening Rush' "
          "WHEN hour_of_day BETWEEN 9 AND 16 THEN 'Midday' WHEN hour_of_day BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Night' END")
DAY = "CASE WHEN day_of_week IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END"


def local(epoch: str) -> str:
    at = f"(to_timestamp({epoch}) AT TIME ZONE 'America/Vancouver')"
    return f"CAST(extract(hour FROM {at}) AS BIGINT) AS hour_of_day, CAST(extract(dow FROM {at}) AS BIGINT) AS day_of_week"


cte("x_deduped", """
SELECT * FROM x_updates QUALIFY row_number() OVER (PARTITION BY trip_instance_id, stop_sequence
  ORDER BY fetch_timestamp DESC, tie1 DESC, tie2 DESC, arrival_epoch DESC) = 1""")
cte("x_next", """
SELECT *, lead(stop_sequence) OVER w AS next_sequence, lead(stop_id) OVER w AS next_stop_id,
  lead(arrival_epoch) OVER w AS next_epoch, lead(delay) OVER w AS next_delay
FROM x_deduped WINDOW w AS (PARTITION BY trip_instance_id ORDER BY stop_sequence)""")
cte("x_observed", f"""
SELECT n.*, s.seg_length, s.no_points, s.geom, s.stop2_sequence, s.scheduled_seconds, n.next_epoch - n.arrival_epoch AS actual_seconds,
  s.seg_length / s.scheduled_seconds * 3.6 AS scheduled_speed, s.seg_length / (n.next_epoch - n.arrival_epoch) * 3.6 AS actual_speed,
  (n.next_epoch - n.arrival_epoch - s.scheduled_seconds) / 60e0 AS delay_minutes,
  r.route_short_name, r.route_type, f.stop_name AS from_stop_name, t.stop_name AS to_stop_name,
  f.stop_lat AS from_lat, f.stop_lon AS from_lon, t.stop_lat AS to_lat, t.stop_lon AS to_lon, {local('n.arrival_epoch')}
FROM x_next n JOIN x_segments s ON s.trip_id = n.trip_id AND s.stop1_sequence = n.stop_sequence
LEFT JOIN x_routes r ON r.route_id = n.route_id LEFT JOIN x_stops f ON f.stop_id = n.stop_id LEFT JOIN x_stops t ON t.stop_id = n.next_stop_id
WHERE n.next_epoch IS NOT NULL AND s.seg_length > 10 AND s.scheduled_seconds > 0
  AND n.next_epoch - n.arrival_epoch > 0 AND n.next_epoch - n.arrival_epoch < 3600""")
cte("x_delays", f"SELECT *, {DAY} AS day_type, {PERIOD} AS time_period FROM x_observed")
cte("x_bus_delays", """
SELECT *, (scheduled_speed - actual_speed) / nullif(scheduled_speed, 0) * 100 AS reduction
FROM x_delays WHERE route_type = '3' AND delay_minutes BETWEEN -30 AND 60 AND actual_speed < 150""")
cte("x_bus_speeds", f"""
SELECT *, {DAY} AS day_type, actual_speed - scheduled_speed AS delta FROM x_observed
WHERE route_type = '3' AND scheduled_speed > 0 AND scheduled_speed < 150 AND actual_speed > 0 AND actual_speed < 150""")
cte("x_lagged", f"""
SELECT u.route_id, r.route_short_name, r.route_type, u.stop_id, u.trip_instance_id, u.arrival_epoch,
  lag(u.arrival_epoch) OVER w AS prev_epoch, lag(u.trip_instance_id) OVER w AS prev_trip
FROM x_updates u JOIN x_routes r ON r.route_id = u.route_id
WINDOW w AS (PARTITION BY u.route_id, u.stop_id ORDER BY u.arrival_epoch, u.trip_instance_id, u.stop_sequence, u.fetch_timestamp, u.tie1, u.tie2)""")
cte("x_headways", f"""
SELECT *, {DAY} AS day_type, {PERIOD} AS time_period FROM (
  SELECT l.*, s.stop_name, s.stop_lat, s.stop_lon, (arrival_epoch - prev_epoch) / 60e0 AS headway_minutes, {local('l.arrival_epoch')}
  FROM x_lagged l LEFT JOIN x_stops s ON s.stop_id = l.stop_id
  WHERE prev_epoch IS NOT NULL AND trip_instance_id <> prev_trip AND arrival_epoch - prev_epoch > 0 AND arrival_epoch - prev_epoch < 7200)""")
cte("x_bus_headways", "SELECT * FROM x_headways WHERE route_type = '3'")
cte("x_schedule", f"""
SELECT *, {DAY} AS day_type FROM (
  SELECT d.trip_instance_id, d.trip_id, d.route_id, r.route_short_name, r.route_type, d.stop_sequence, d.stop_id, s.stop_name, s.stop_lat, s.stop_lon,
    ts.arrival_seconds AS scheduled_arrival_seconds, d.arrival_epoch, d.delay, d.delay / 60e0 AS delay_minutes, {local('d.arrival_epoch')}
  FROM x_deduped d JOIN x_routes r ON r.route_id = d.route_id LEFT JOIN x_stops s ON s.stop_id = d.stop_id
  LEFT JOIN x_transit_stops ts ON ts.trip_id = d.trip_id AND ts.stop_sequence = d.stop_sequence WHERE d.delay IS NOT NULL)""")
cte("x_bus_schedule", "SELECT * FROM x_schedule WHERE route_type = '3'")
cte("x_sched_headway", """
SELECT route_id, route_short_name, stop_id, avg((arrival_seconds - prev) / 60e0) AS scheduled_headway_minutes FROM (
  SELECT t.route_id, r.route_short_name, ts.stop_id, ts.arrival_seconds,
    lag(ts.arrival_seconds) OVER (PARTITION BY t.route_id, ts.stop_id ORDER BY ts.arrival_seconds) AS prev
  FROM x_trips t JOIN x_stop_times ts ON ts.trip_id = t.trip_id JOIN x_routes r ON r.route_id = t.route_id
  WHERE r.route_type = '3' AND ts.arrival_seconds IS NOT NULL)
WHERE prev IS NOT NULL AND arrival_seconds - prev > 0 AND arrival_seconds - prev < 7200 GROUP BY ALL""")
cte("x_hvs", """
SELECT a.route_id, a.route_short_name, a.stop_id, a.stop_name, a.stop_lat, a.stop_lon, count(*) AS observations, avg(a.headway_minutes) AS actual,
  quantile_cont(a.headway_minutes, 0.5) AS median_actual, stddev_samp(a.headway_minutes) AS std_actual, sh.scheduled_headway_minutes AS sched,
  avg(a.headway_minutes) - sh.scheduled_headway_minutes AS delta, avg(CASE WHEN a.headway_minutes < 3 THEN 100e0 ELSE 0 END) AS bunching,
  avg(CASE WHEN sh.scheduled_headway_minutes IS NOT NULL AND a.headway_minutes > sh.scheduled_headway_minutes * 1.8e0 THEN 100e0
           WHEN sh.scheduled_headway_minutes IS NULL AND a.headway_minutes > 20 THEN 100e0 ELSE 0 END) AS gaps
FROM x_bus_headways a LEFT JOIN x_sched_headway sh ON sh.route_id = a.route_id AND sh.stop_id = a.stop_id
GROUP BY a.route_id, a.route_short_name, a.stop_id, a.stop_name, a.stop_lat, a.stop_lon, sh.scheduled_headway_minutes HAVING count(*) >= 3""")
cte("x_speed_layer", """
SELECT route_id || stop1_sequence || stop2_sequence AS segment_id, route_id, route_short_name, stop1_sequence, stop2_sequence, geom,
  avg(seg_length / scheduled_seconds * 3.6) AS speed
FROM x_bus_segments WHERE scheduled_seconds <> 0 AND seg_length > 0 AND seg_length / scheduled_seconds * 3.6 > 0
  AND seg_length / scheduled_seconds * 3.6 < 150 GROUP BY route_id, stop1_sequence, stop2_sequence, geom, route_short_name""")
cte("x_pairs", """
SELECT p.route1, p.route2, p.shared, a.n AS total1, b.n AS total2, p.shared * 100e0 / least(a.n, b.n) AS overlap FROM (
  SELECT a.route_id AS route1, b.route_id AS route2, count(*) AS shared FROM x_usage a JOIN x_usage b ON a.segment_id = b.segment_id AND a.route_id < b.route_id
  GROUP BY ALL) p
JOIN (SELECT route_id, count(*) AS n FROM x_usage GROUP BY 1) a ON a.route_id = p.route1
JOIN (SELECT route_id, count(*) AS n FROM x_usage GROUP BY 1) b ON b.route_id = p.route2""")
cte("x_usage", "SELECT DISTINCT route_id, stop1_id || stop2_id AS segment_id FROM x_bus_segments")
