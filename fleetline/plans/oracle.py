"""The registered queries again, as plain SQL over the same tables, to check the results against."""

from __future__ import annotations

import re

_COMMON: dict[str, str] = {}
_CHECKS: dict[str, str] = {}

_COMMON["ev"] = r"SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events"
_COMMON["pos"] = """
SELECT 'T' || user_id || '@' || strftime(ts, '%Y%m%d') AS trip_id, 'R' || (user_id % 2) AS route_id,
  CASE WHEN (user_id // 2) % 2 = 0 THEN 'N' ELSE 'S' END AS direction, 'S' || (k % 2) AS stop_id,
  'Stop ' || (k % 2) AS stop_name, 40.5::DOUBLE + (k % 2) * 0.25::DOUBLE AS stop_lat,
  -74.0::DOUBLE + (k % 2) * 0.125::DOUBLE AS stop_lon,
  CASE event_type WHEN 'click' THEN 'INCOMING_AT' WHEN 'error' THEN 'IN_TRANSIT_TO' ELSE 'STOPPED_AT' END AS current_status,
  ts AS event_time FROM ev"""
_COMMON["bus"] = """
SELECT 'T' || user_id || '@' || strftime(ts, '%Y%m%d') AS trip_id, 'CITY_R' || (user_id % 2) AS route_id,
  'R' || (user_id % 2) AS route_short, CASE WHEN user_id % 3 = 0 THEN '0' ELSE '1' END AS direction,
  40.5::DOUBLE + (user_id % 64) / 128.0::DOUBLE AS vehicle_lat, -74.0::DOUBLE + (user_id % 32) / 64.0::DOUBLE AS vehicle_lon,
  CASE WHEN user_id % 5 <> 0 THEN (user_id % 360)::DOUBLE END AS bearing,
  CASE event_type WHEN 'click' THEN 'INCOMING_AT' WHEN 'error' THEN 'IN_TRANSIT_TO' ELSE 'STOPPED_AT' END AS current_status,
  ts AS event_time FROM events"""
_COMMON["arr"] = """
SELECT trip_id, route_id, direction, stop_id, stop_name, stop_lat, stop_lon, event_time FROM pos
WHERE current_status = 'STOPPED_AT'
QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY event_time, route_id, direction, stop_name) = 1"""
_COMMON["hw"] = """
SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, lag(trip_id) OVER w AS prev_trip,
  trip_id AS curr_trip, date_sub('second', lag(event_time) OVER w, event_time) AS headway_seconds,
  event_time AS arrival_time
FROM arr WINDOW w AS (PARTITION BY route_id, direction, stop_id ORDER BY event_time, trip_id)
QUALIFY lag(trip_id) OVER w <> trip_id"""
_COMMON["al"] = """
SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, prev_trip, curr_trip, headway_seconds,
  CASE WHEN headway_seconds < 150 THEN 'BUNCHING' ELSE 'GAP' END AS alert_type,
  CASE WHEN headway_seconds < 75 OR headway_seconds > 1500 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, arrival_time
FROM hw WHERE headway_seconds < 150 OR headway_seconds > 900"""
_COMMON["trip3"] = """
SELECT *, 2 * headway_seconds - prev_headway_seconds AS predicted_headway FROM (
  SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, trip_id AS curr_trip,
    date_sub('second', lag(event_time) OVER w, event_time) AS headway_seconds,
    date_sub('second', lag(event_time, 2) OVER w, lag(event_time) OVER w) AS prev_headway_seconds,
    event_time AS arrival_time
  FROM arr WINDOW w AS (PARTITION BY route_id, direction, stop_id ORDER BY event_time, trip_id)
  QUALIFY lag(trip_id) OVER w <> trip_id AND lag(trip_id, 2) OVER w <> lag(trip_id) OVER w)"""
_COMMON["fc"] = """
SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, curr_trip, headway_seconds,
  prev_headway_seconds, predicted_headway,
  CASE WHEN predicted_headway < 150 THEN 'PREDICTED_BUNCHING' ELSE 'PREDICTED_GAP' END AS forecast_type, arrival_time
FROM trip3 WHERE (predicted_headway < 150 AND headway_seconds >= 150) OR (predicted_headway > 900 AND headway_seconds <= 900)"""
_COMMON["tu"] = """
SELECT 'T' || (l_orderkey % 3000) AS trip_id, 'R' || (l_orderkey % 12) AS route_id,
  CASE WHEN l_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS direction, 'S' || (l_suppkey % 40) AS stop_id,
  'Stop ' || (l_suppkey % 40) AS stop_name, 40.5::DOUBLE + (l_suppkey % 40) / 64.0::DOUBLE AS stop_lat,
  -74.0::DOUBLE + (l_suppkey % 40) / 128.0::DOUBLE AS stop_lon,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE 1704067200 + (l_orderkey * 7 + l_linenumber * 131) % 4000 - 1000 END::BIGINT AS arrival_epoch,
  l_shipdate::TIMESTAMP + to_seconds(l_linenumber) AS event_time FROM lineitem"""
_COMMON["pred"] = """
SELECT trip_id, route_id, direction, stop_id, stop_name, stop_lat, stop_lon, arrival_epoch, event_time FROM tu
WHERE arrival_epoch > 0
QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY event_time DESC, arrival_epoch DESC) = 1"""
_COMMON["est"] = """
SELECT trip_id, stop_id, route_id, direction, stop_name, stop_lat, stop_lon, arrival_epoch,
  arrival_epoch - 1704067200 AS eta_seconds, event_time FROM pred
WHERE arrival_epoch - 1704067200 BETWEEN -30 AND 1800"""
_COMMON["wx"] = """
SELECT event_id, ts AS event_time, CASE WHEN k % 10 <> 9 THEN floor(value) / 2 - 20 END AS temp,
  CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 1.5 END::DOUBLE AS precip,
  CASE WHEN k % 8 < 4 THEN 0.0 ELSE 2.5 END::DOUBLE AS rain, CASE WHEN k % 7 <> 6 THEN k END AS code,
  CASE WHEN k % 5 <> 0 THEN floor(value) % 40 END AS wind
FROM ev WHERE event_type = 'view'"""
_COMMON["sg"] = """
SELECT 'ST' || (user_id % 5) AS station_id, 'Station ' || (user_id % 5) AS station_name,
  'LR' || (user_id % 2) AS line, 200 + k * 20 AS taps_per_minute,
  CASE k % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH' ELSE 'SURGE' END AS crowd_level,
  epoch_us(ts) // 1000 AS event_time FROM ev WHERE event_type = 'signup'"""
_COMMON["sa"] = """
SELECT 'A' || o_orderkey AS alert_id, 'E' || o_custkey AS event_id, (o_orderkey % 7)::VARCHAR AS update_number,
  'AG' || (o_custkey % 3) AS agency, o_orderpriority AS affected,
  CASE o_orderstatus WHEN 'F' THEN 'delays' WHEN 'O' THEN '' END AS status_label,
  'Notice ' || o_orderkey AS header, 'Details of notice ' || o_orderkey AS description,
  epoch_ms(o_orderdate::TIMESTAMP) AS date FROM orders"""
_COMMON["st"] = """
SELECT 'S' || n_nationkey AS stop_id, n_name AS stop_name, 40.0::DOUBLE + n_nationkey / 32.0::DOUBLE AS stop_lat,
  -74.0::DOUBLE + n_nationkey / 64.0::DOUBLE AS stop_lon FROM nation
UNION ALL
SELECT 'S' || n_nationkey || 'N', n_name || ' North', 40.0::DOUBLE + n_nationkey / 32.0::DOUBLE,
  -74.0::DOUBLE + n_nationkey / 64.0::DOUBLE FROM nation WHERE n_nationkey % 5 = 0"""
_COMMON["shp"] = """
SELECT 'SH' || (l_suppkey % 50) AS shape_id, (l_orderkey * 8 + l_linenumber)::INTEGER AS seq,
  40.0::DOUBLE + l_partkey / 65536.0::DOUBLE AS lat, -74.0::DOUBLE + l_quantity / 64.0::DOUBLE AS lon FROM lineitem"""
_COMMON["own"] = """
SELECT 'SH' || (o_orderkey % 60) AS shape_id, 'R' || (o_custkey % 20) AS route_id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderkey % 60 ORDER BY o_orderkey) = 1"""
_COMMON["trunk"] = """
SELECT route_id, shape_id, n_points FROM (SELECT shape_id, count(*) AS n_points FROM shp GROUP BY shape_id) JOIN own USING (shape_id)
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n_points DESC, shape_id) = 1"""
_COMMON["rsh"] = """
SELECT t.route_id, t.shape_id,
  CASE WHEN n.n_nationkey IS NULL OR n.n_nationkey % 4 = 0 THEN '#888888' ELSE '#' || lpad(printf('%X', n.n_nationkey * 4099), 6, '0') END AS color,
  row_number() OVER (PARTITION BY t.shape_id ORDER BY seq, lat, lon) - 1 AS position, lat, lon
FROM trunk t JOIN shp USING (shape_id) LEFT JOIN nation n ON t.route_id = 'R' || n.n_nationkey WHERE n_points >= 2"""
_COMMON["ent"] = """
SELECT event_id, 'G' || (user_id % 8) AS feed, epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS secs, k, user_id,
  event_type IN ('signup', 'purchase') AS is_update,
  CASE WHEN k % 10 = 0 THEN '' ELSE 'T' || user_id || '@' || strftime(ts, '%Y%m%d') END AS trip_id,
  CASE WHEN k % 13 = 0 THEN '' ELSE 'LOCAL_R' || (user_id % 20) END AS route_id,
  CASE user_id % 3 WHEN 0 THEN 'EAST SIDE_' WHEN 1 THEN 'WEST_' ELSE '' END || user_id AS vehicle_id,
  'S' || (k % 40) || CASE k % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS stop_id,
  CASE k % 4 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' ELSE 'IN_TRANSIT_TO' END AS status,
  CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 11 = 0 THEN 0.0 ELSE 40.0 + user_id / 1024.0 END END::DOUBLE AS lat,
  CASE WHEN k % 7 <> 0 THEN -74.0 + user_id / 2048.0 END::DOUBLE AS lon,
  CASE WHEN k % 3 <> 0 THEN (user_id % 360)::DOUBLE ELSE -1.0 END AS bearing
FROM ev"""
_COMMON["dec"] = """
SELECT 'R' || (user_id % 20) AS route_id, 'S' || (k % 40) AS stop_id, event_id,
  CASE k % 4 WHEN 0 THEN 'BUNCHING' WHEN 1 THEN ' gap ' WHEN 2 THEN 'OTHER' END AS alert_type,
  CASE WHEN k % 9 <> 0 THEN floor(value * 8)::BIGINT END AS headway_seconds,
  CASE k % 5 WHEN 0 THEN 'HOLD TRAIN' WHEN 1 THEN 'gap fill' WHEN 2 THEN 'MONITOR' WHEN 3 THEN '' END AS action,
  CASE user_id % 5 WHEN 0 THEN 'HOLD TRAIN' WHEN 1 THEN 'gap fill' WHEN 2 THEN 'MONITOR' WHEN 3 THEN '' END AS llm_action
FROM ev"""
_COMMON["scd"] = """
SELECT *, CASE WHEN trim(upper(alert_type)) = 'BUNCHING' AND headway_seconds < 90 THEN 'HOLD TRAIN'
  WHEN trim(upper(alert_type)) = 'GAP' AND headway_seconds > 1200 THEN 'GAP FILL' ELSE 'MONITOR' END AS expected,
  trim(upper(coalesce(action, ''))) AS actual
FROM dec WHERE alert_type IS NOT NULL AND headway_seconds IS NOT NULL"""
_COMMON["veh"] = """
SELECT trip_id, 'subway' AS mode, route_id, route_id AS route_short, direction, stop_id, stop_name,
  stop_lat AS lat, stop_lon AS lon, -1.0::DOUBLE AS bearing, current_status AS status, event_time AS seen FROM pos
UNION ALL
SELECT trip_id, 'bus', route_id, route_short, direction, '', '', vehicle_lat, vehicle_lon,
  coalesce(bearing, -1.0), current_status, event_time FROM bus"""


def _live(ttl: str) -> str:
    return f"""SELECT * FROM veh WHERE seen BETWEEN TIMESTAMP '2024-01-31' - INTERVAL {ttl} AND TIMESTAMP '2024-01-31'
QUALIFY row_number() OVER (PARTITION BY mode, trip_id ORDER BY seen DESC) = 1"""


_COMMON["now"] = _live("6 HOURS")
_COMMON["month"] = _live("40 DAYS")
_COMMON["place"] = "SELECT * FROM month QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY seen DESC, mode DESC) = 1"
_COMMON["due"] = """
SELECT route_id, direction, stop_id, stop_name, trip_id, arrival_epoch + 2592000 - 1706659200 AS eta_seconds
FROM est WHERE arrival_epoch + 2592000 - 1706659200 BETWEEN 0 AND 1800"""
_COMMON["board"] = """
SELECT * FROM (SELECT * FROM due QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY eta_seconds, stop_id, trip_id) <= 6)
ORDER BY eta_seconds, route_id, stop_id, trip_id LIMIT 120"""
_COMMON["al60"] = """
SELECT route_id, direction, stop_id, stop_name, alert_type, severity, headway_seconds, prev_trip, curr_trip,
  epoch_us(arrival_time) // 1000 AS ts FROM al
ORDER BY arrival_time DESC, route_id, direction, stop_id, curr_trip, prev_trip LIMIT 60"""
_COMMON["act"] = """
SELECT *, CASE WHEN alert_type = 'BUNCHING' AND headway_seconds < 90 THEN 'HOLD TRAIN'
  WHEN alert_type = 'GAP' AND headway_seconds > 1200 THEN 'GAP FILL' ELSE 'MONITOR' END AS action
FROM al QUALIFY row_number() OVER (PARTITION BY route_id, direction, stop_id, curr_trip, prev_trip ORDER BY arrival_time) = 1"""
_COMMON["dd"] = """
SELECT *, CASE action WHEN 'HOLD TRAIN' THEN 'Hold ' || curr_trip || ' at ' || stop_name || ' to restore spacing.'
    WHEN 'GAP FILL' THEN 'Add service behind ' || prev_trip || ' at ' || stop_name || '.'
    ELSE 'Watch line ' || route_id || ' at ' || stop_name || '.' END AS dispatcher_note,
  CASE alert_type WHEN 'GAP' THEN 'Longer wait than usual at ' ELSE 'Two vehicles are close together at ' END || stop_name || '.' AS rider_message,
  'Headway of ' || headway_seconds || ' seconds is a ' || alert_type || ' alert.' AS reasoning FROM act"""
_COMMON["crowd"] = """
SELECT * FROM (SELECT * FROM sg WHERE event_time >= epoch_ms(TIMESTAMP '2024-01-30')
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_time DESC, taps_per_minute DESC, line DESC) = 1)
WHERE crowd_level IN ('SURGE', 'HIGH')"""
# Texts of the weather codes.
_WMO = """
    WHEN 0 THEN 'Clear Sky'
    WHEN 1 THEN 'Mainly Clear'
    WHEN 2 THEN 'Partly Cloudy'
    WHEN 3 THEN 'Overcast'
    WHEN 45 THEN 'Foggy'
    WHEN 48 THEN 'Rime Fog'
    WHEN 51 THEN 'Light Drizzle'
    WHEN 53 THEN 'Drizzle'
    WHEN 55 THEN 'Heavy Drizzle'
    WHEN 61 THEN 'Light Rain'
    WHEN 63 THEN 'Rain'
    WHEN 65 THEN 'Heavy Rain'
    WHEN 71 THEN 'Light Snow'
    WHEN 73 THEN 'Snow'
    WHEN 75 THEN 'Heavy Snow'
    WHEN 80 THEN 'Rain Showers'
    WHEN 81 THEN 'Heavy Showers'
    WHEN 95 THEN 'Thunderstorm'
"""
_COMMON["wn"] = f"""
SELECT event_id, event_time, round_even(temp, 1) AS temp_c, round_even(temp * 9 / 5 + 32, 1) AS temp_f,
  CASE coalesce(code, 0) {_WMO} ELSE 'Partly Cloudy' END AS condition,
  coalesce(nullif(precip, 0), nullif(rain, 0), 0.0) AS precip_mm, round_even(coalesce(wind, 0.0), 1) AS wind_kph,
  coalesce(code, 0) AS weather_code FROM wx"""
_COMMON["prompt"] = r"""
SELECT curr_trip, prev_trip, stop_id, alert_type, headway_seconds, 'SERVICE ALERT' || chr(10) || 'Line: ' || route_id || '  Direction: ' || direction || ' (' ||
  CASE WHEN direction = 'N' THEN 'uptown/Bronx-bound' ELSE 'downtown/Brooklyn-bound' END || ')' || chr(10) ||
  'Station: ' || stop_name || chr(10) || 'Alert Type: ' || alert_type || chr(10) || 'Severity: ' || severity || chr(10) ||
  'Observed Headway: ' || headway_seconds || ' seconds (normal is roughly 150-600s)' || chr(10) ||
  'Trailing Train: ' || curr_trip || '   Leading Train: ' || prev_trip AS prompt FROM al"""
_COMMON["prop"] = """
SELECT doc_id, lang, source, doc_id % 7 AS form, 40.25 + (n_chars % 64) / 64.0::DOUBLE AS a1, -74.25 + (doc_id % 32) / 32.0::DOUBLE AS o1,
  doc_id % 5 <> 0 AS has2, 40.25 + (n_chars * 2 % 64) / 64.0::DOUBLE AS a2, -74.25 + (doc_id * 2 % 32) / 32.0::DOUBLE AS o2,
  40.25 + (n_chars * 3 % 64) / 64.0::DOUBLE AS a3, -74.25 + (doc_id * 3 % 32) / 32.0::DOUBLE AS o3, "text" FROM documents"""
_COMMON["okprop"] = """
SELECT * FROM (SELECT *, list_filter([[o1, a1], CASE WHEN has2 THEN [o2, a2] ELSE [0.0, 0.0] END, [o3, a3]],
    lambda p: p[2] BETWEEN 40.3 AND 41.1 AND p[1] BETWEEN -74.3 AND -73.6) AS pts FROM prop)"""
_COMMON["cong"] = """
SELECT route_short, w, count(DISTINCT trip_id) AS active_buses,
  count(*) FILTER (WHERE current_status = 'IN_TRANSIT_TO') AS in_transit_buses,
  count(*) FILTER (WHERE current_status = 'STOPPED_AT') AS stopped_buses,
  count(DISTINCT CASE WHEN current_status = 'STOPPED_AT' THEN trip_id END) AS stopped_trips
FROM (SELECT *, date_trunc('hour', event_time) AS w FROM bus) GROUP BY route_short, w"""


def _level(stopped: str) -> str:
    return (f"CASE WHEN active_buses >= 10 AND {stopped}::DOUBLE / active_buses > 0.4 THEN 'HEAVY' "
            f"WHEN active_buses >= 5 AND {stopped}::DOUBLE / active_buses > 0.25 THEN 'MODERATE' ELSE 'LIGHT' END AS congestion_level")


_HOURLY = f"""SELECT route_short, active_buses, in_transit_buses, stopped_buses, {_level('stopped_buses')},
  w + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS window_time FROM cong"""
_ACTIONS = """CASE WHEN {k} = 'BUNCHING' AND {h} < 90 THEN 'HOLD TRAIN' WHEN {k} = 'GAP' AND {h} > 1200 THEN 'GAP FILL' ELSE 'MONITOR' END"""

_CHECKS["latest_predictions"] = "SELECT * FROM pred"
_CHECKS["arrival_estimates"] = "SELECT * FROM est"
_CHECKS["first_arrivals"] = "SELECT * FROM arr"
_CHECKS["first_arrivals_by_service_date"] = """
SELECT trip_id, route_id, direction, stop_id, stop_name, stop_lat, stop_lon, event_time FROM pos
WHERE current_status = 'STOPPED_AT'
QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id, event_time::DATE ORDER BY event_time, route_id, direction, stop_name) = 1"""
_CHECKS["headway"] = "SELECT * FROM hw"
_CHECKS["headway_alerts"] = "SELECT * FROM al"
_CHECKS["headway_triplets"] = "SELECT * FROM trip3"
_CHECKS["headway_forecast"] = "SELECT * FROM fc"
_CHECKS["match_consecutive_orders"] = """
SELECT o_custkey, lag(o_orderkey, 2) OVER w AS first_order, o_orderkey AS last_order,
  date_sub('second', lag(o_orderdate, 2) OVER w, o_orderdate) AS seconds
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
QUALIFY lag(o_totalprice) OVER w > lag(o_totalprice, 2) OVER w AND o_totalprice > lag(o_totalprice) OVER w"""
_CHECKS["corridor_congestion_hourly"] = _HOURLY
_COMMON["cong_minute"] = _COMMON["cong"].replace("'hour'", "'minute'")
_CHECKS["corridor_congestion_minute"] = _HOURLY.replace("1 HOUR", "1 MINUTE").replace("FROM cong", "FROM cong_minute")
_CHECKS["corridor_congestion_vehicles"] = f"""
SELECT route_short, active_buses, in_transit_buses, stopped_trips AS stopped_buses, {_level('stopped_trips')},
  w + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS window_time FROM cong"""
_COMMON["cong_day"] = _COMMON["cong"].replace("'hour'", "'day'")
_CHECKS["corridor_congestion_rollup"] = (
    f"SELECT *, 'hour' AS span FROM ({_HOURLY}) UNION ALL BY NAME SELECT *, 'day' AS span FROM (" +
    _CHECKS["corridor_congestion_vehicles"].replace("1 HOUR", "1 DAY").replace("FROM cong", "FROM cong_day") + ")")
_CHECKS["weather_impact"] = """
SELECT a.route_id, a.direction, a.stop_name, a.alert_type, a.severity, a.headway_seconds,
  coalesce(temp, 18.0) AS temperature_c, coalesce(precip, 0.0) AS precipitation_mm, coalesce(wind, 5.0) AS wind_speed_kmh,
  CASE WHEN code >= 80 THEN 'RAIN_SHOWERS' WHEN code >= 51 THEN 'DRIZZLE' WHEN code >= 1 THEN 'OVERCAST' ELSE 'CLEAR' END AS weather_condition,
  CASE WHEN coalesce(precip, 0) > 1 OR coalesce(wind, 0) > 30 THEN 'HIGH_WEATHER_DISRUPTION'
    WHEN coalesce(precip, 0) > 0 OR coalesce(wind, 0) > 15 THEN 'MODERATE_WEATHER_RISK' ELSE 'NORMAL_TRACK_CONDITIONS' END AS weather_risk_level,
  a.arrival_time
FROM al a ASOF JOIN wx ON a.arrival_time >= wx.event_time
WHERE a.arrival_time - wx.event_time <= INTERVAL 30 MINUTES"""
_CHECKS["station_bottlenecks"] = """
SELECT station_name, a.route_id AS subway_line, crowd_level, taps_per_minute, alert_type, headway_seconds,
  CASE WHEN crowd_level = 'SURGE' AND alert_type = 'GAP' THEN 'CRITICAL' ELSE 'ELEVATED' END AS bottleneck_severity,
  CASE WHEN crowd_level = 'SURGE' AND alert_type = 'GAP' THEN 'DEPLOY GAP FILL & PLATFORM CROWD CONTROL'
    WHEN crowd_level = 'SURGE' THEN 'HOLD LEADING TRAIN TO ABSORB PASSENGERS'
    ELSE 'MONITOR PASSENGER SURGE CONGESTION' END AS dispatcher_recommendation,
  a.arrival_time AS detection_time
FROM (SELECT al.*, e.station_id AS st FROM al JOIN (SELECT DISTINCT line, station_id FROM sg) e ON al.route_id = substr(e.line, 2)) a
ASOF JOIN (SELECT *, make_timestamp(event_time * 1000) AS seen, substr(line, 2) AS route FROM sg) s
  ON a.st = s.station_id AND a.route_id = s.route AND a.arrival_time >= s.seen
WHERE a.arrival_time - s.seen <= INTERVAL 1 HOUR AND crowd_level IN ('HIGH', 'SURGE')"""
_CHECKS["asof_join_events"] = """
SELECT p.event_id, p.user_id, p.ts, c.ts AS click_ts, c.event_id AS click_id
FROM (FROM events WHERE event_type = 'purchase') p ASOF JOIN (FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND p.ts >= c.ts WHERE p.ts - c.ts <= INTERVAL 48 HOURS"""
_CHECKS["dedup_alerts"] = "SELECT * EXCLUDE (action) FROM act"
_CHECKS["active_service_alerts"] = """
SELECT event_id, agency, affected, status_label, header, description, date FROM sa WHERE status_label <> ''"""
_CHECKS["latest_service_alerts"] = """
SELECT event_id, agency, affected, status_label, header, description, date FROM sa
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY date DESC, update_number DESC, alert_id DESC) = 1"""
_CHECKS["read_service_alerts"] = _CHECKS["latest_service_alerts"]
_CHECKS["alerts_by_type"] = """
SELECT alert_type AS kind, severity AS detail, count(*) AS n FROM al GROUP BY ALL
UNION ALL SELECT forecast_type, direction, count(*) FROM fc GROUP BY ALL
UNION ALL SELECT action, alert_type, count(*) FROM act GROUP BY ALL"""
_CHECKS["derived_table_counts"] = """
SELECT 'arrival_estimates' AS name, count(*) AS n FROM est UNION ALL SELECT 'headway', count(*) FROM hw
UNION ALL SELECT 'headway_forecast', count(*) FROM fc UNION ALL SELECT 'headway_alerts', count(*) FROM al
UNION ALL SELECT 'dispatcher_decisions', count(*) FROM act UNION ALL SELECT 'bus_corridor_speed', count(*) FROM cong"""

_CHECKS["dispatcher_prompt"] = "SELECT curr_trip, prev_trip, stop_id, prompt FROM prompt"
_CHECKS["dispatcher_decisions"] = """
SELECT route_id, direction, stop_id, curr_trip, prev_trip, stop_name, stop_lat, stop_lon, alert_type, severity,
  headway_seconds, arrival_time, action, action AS llm_action, dispatcher_note, rider_message, reasoning,
  'Action: ' || action || chr(10) || 'Dispatcher Note: ' || dispatcher_note || chr(10) || 'Rider Message: ' ||
  rider_message || chr(10) || 'Reasoning: ' || reasoning AS raw_response FROM dd"""
_CHECKS["run_agent"] = """
SELECT curr_trip, stop_id, '**MONITOR**' AS llm_action, alert_type AS dispatcher_note,
  headway_seconds || 's' AS rider_message, 'seen' AS reasoning FROM prompt"""
_CHECKS["run_agent_lateral"] = """
SELECT curr_trip, stop_id, 'Action: **MONITOR**' || chr(10) || 'Dispatcher Note: ' || alert_type || chr(10) ||
  'Rider Message: ' || headway_seconds || 's' || chr(10) || 'Reasoning: seen' AS response FROM prompt"""
_CHECKS["parse_response"] = r"""
WITH r AS (SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN '**Action:** HOLD TRAIN ' || chr(10) || 'Dispatcher Note: ' || lang || chr(10) || 'Rider Message: to ' || source || chr(10) || 'Reasoning: ' || rtrim("text", ' ')
  WHEN 1 THEN 'Action:' || chr(10) || 'Dispatcher Note: ' || source || chr(10) || 'Reasoning: ' || rtrim("text", ' ')
  WHEN 2 THEN rtrim("text", ' ') ELSE 'Rider Message: ' || rtrim("text", ' ') END AS t FROM documents)
SELECT doc_id, trim(nullif(regexp_extract(t, '\*{0,2}Action:\*{0,2}\s*([^\n]+)', 1), ''), ' ') AS llm_action,
  trim(nullif(regexp_extract(t, '\*{0,2}Dispatcher Note:\*{0,2}\s*([^\n]+)', 1), ''), ' ') AS dispatcher_note,
  trim(nullif(regexp_extract(t, '\*{0,2}Rider Message:\*{0,2}\s*([^\n]+)', 1), ''), ' ') AS rider_message,
  trim(nullif(regexp_extract(t, '\*{0,2}Reasoning:\*{0,2}\s*([\s\S]+?)$', 1), ''), ' ') AS reasoning
FROM r"""
_CHECKS["decision_outbox"] = """
SELECT '{"route_id":"' || route_id || '","direction":"' || direction || '","stop_id":"' || stop_id || '","curr_trip":"' ||
  curr_trip || '","action":"' || action || '","headway_seconds":' || headway_seconds || '}' AS payload FROM act"""
_SCORE = """
SELECT count(*) AS total, count(*) FILTER (WHERE actual = expected) AS action_correct,
  count(*) FILTER (WHERE actual <> expected) AS action_wrong, count(*) FILTER (WHERE llm_action <> '') AS llm_present,
  count(*) FILTER (WHERE llm_action <> '' AND trim(upper(llm_action)) = expected) AS llm_agreement,
  CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE actual = expected) / count(*) END AS action_accuracy,
  count(*) FILTER (WHERE llm_action <> '' AND trim(upper(llm_action)) = expected) / nullif(count(*) FILTER (WHERE llm_action <> ''), 0) AS llm_agreement_rate
FROM scd"""
_CHECKS["score_decisions"] = _SCORE
_CHECKS["read_decisions_jsonl"] = _SCORE + " WHERE event_id % 11 > 1"
_CHECKS["decision_mismatches"] = """
SELECT route_id, stop_id, alert_type, headway_seconds, expected, CASE actual WHEN '' THEN '(empty)' ELSE actual END AS actual
FROM scd WHERE actual <> expected"""
_CHECKS["expected_actions"] = f"""
SELECT 'note ' || event_id AS dispatcher_note, {_ACTIONS.format(k="trim(upper(coalesce(alert_type, '')))", h='headway_seconds')} AS expected
FROM dec WHERE headway_seconds IS NOT NULL"""
_COMMON["band"] = """
SELECT *, count(*) OVER w AS n, avg(headway_seconds::DOUBLE) OVER w AS mean, stddev_samp(headway_seconds::DOUBLE) OVER w AS sd FROM hw
WINDOW w AS (PARTITION BY route_id, direction, stop_id ORDER BY arrival_time, curr_trip ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"""
_COMMON["bounds"] = """
SELECT *, headway_seconds::DOUBLE AS actual_value,
  CASE WHEN n >= 12 THEN round(mean - 2.5758293035489004 * sd, 6) END AS lower_bound,
  CASE WHEN n >= 12 THEN round(mean + 2.5758293035489004 * sd, 6) END AS upper_bound FROM band"""
_CHECKS["anomaly_bounds"] = """
SELECT curr_trip, stop_id, actual_value, lower_bound, upper_bound,
  coalesce(actual_value < lower_bound OR actual_value > upper_bound, false) AS is_anomaly FROM bounds"""
_CHECKS["anomaly_alerts"] = """
SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, prev_trip, curr_trip, headway_seconds,
  CASE WHEN actual_value < lower_bound THEN 'BUNCHING' ELSE 'GAP' END AS alert_type, 'MEDIUM' AS severity, arrival_time
FROM bounds WHERE actual_value < lower_bound OR actual_value > upper_bound"""
_CHECKS["trend_forecasts"] = """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY route_id, direction, stop_id ORDER BY arrival_time, curr_trip)::DOUBLE AS x FROM hw),
f AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN round(regr_intercept(headway_seconds::DOUBLE, x) OVER w + regr_slope(headway_seconds::DOUBLE, x) OVER w * (x + 1), 3) END AS v
  FROM x WINDOW w AS (PARTITION BY route_id, direction, stop_id ORDER BY arrival_time, curr_trip ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT route_id, direction, stop_id, stop_name, stop_lat, stop_lon, curr_trip, headway_seconds,
  trunc(v)::BIGINT AS predicted_headway, CASE WHEN v < 150 THEN 'PREDICTED_BUNCHING' ELSE 'PREDICTED_GAP' END AS forecast_type, arrival_time
FROM f WHERE v < 150 OR v > 900"""
_CHECKS["route_proposals"] = """
SELECT doc_id, CASE WHEN ok THEN 'Line ' || doc_id END AS name, CASE WHEN ok THEN coalesce("text", '') END AS rationale,
  CASE WHEN ok THEN lang END AS stops, CASE WHEN ok THEN len(pts) ELSE 0 END AS points
FROM (SELECT *, form NOT IN (0, 1) AND len(pts) >= 2 AS ok FROM okprop)"""
_CHECKS["proposal_geojson"] = """
SELECT doc_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' ||
  array_to_string(list_transform(pts, lambda p: '[' || p[1] || ',' || p[2] || ']'), ',') ||
  ']},"properties":{"name":"Line ' || doc_id || '","kind":"proposed_route"}}' AS geojson
FROM okprop WHERE form NOT IN (0, 1) AND len(pts) >= 2"""
_COMMON["req"] = """
SELECT conv_id * 1000 + turn AS request_id, CASE turn % 3 WHEN 0 THEN 'rider' WHEN 1 THEN 'operator' ELSE 'route' END AS kind,
  role, "text" AS question FROM conversations"""
_CHECKS["answer_requests"] = """
SELECT request_id, kind, kind <> 'route' OR role = 'user' AS ok,
  CASE WHEN kind <> 'route' THEN 'noted' WHEN role = 'user'
    THEN 'Here: {"name": "Loop", "waypoints": [[40.5, -74.0], [40.75, -73.75], [99, 0]]}' ELSE 'no route' END AS answer,
  CASE WHEN kind = 'route' AND role = 'user' THEN '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-74.0,40.5],[-73.75,40.75]]},"properties":{"name":"Loop","kind":"proposed_route"}}' END AS geojson,
  CASE WHEN kind = 'route' AND role <> 'user' THEN 'Could not parse a route proposal.' END AS error FROM req"""
_CHECKS["copilot_prompts"] = """
WITH c AS (SELECT count(*) || ' events' AS t FROM events)
SELECT request_id, CASE kind
  WHEN 'rider' THEN 'Trip: from ''' || trim(role, ' ') || ''' to ''?''.' || CASE WHEN trim(question, ' ') <> '' THEN chr(10) || 'Rider asks: ' || trim(question, ' ') ELSE '' END || chr(10) || chr(10) || 'LIVE SYSTEM STATE:' || chr(10) || t
  WHEN 'operator' THEN 'Operator asks: ' || CASE WHEN trim(question, ' ') <> '' THEN trim(question, ' ') ELSE 'How is service now, what is about to get worse, and what should operators do first?' END || chr(10) || chr(10) || 'LIVE SYSTEM STATE:' || chr(10) || t
  ELSE 'Design a bus route from ''' || trim(role, ' ') || ''' to ''?''.' || chr(10) || chr(10) || 'LIVE SYSTEM STATE (for demand/gap signals):' || chr(10) || t END AS prompt
FROM req, c"""

_CHECKS["unified_vehicles"] = "SELECT * FROM veh"
_CHECKS["latest_state_readings"] = """
SELECT * FROM sg WHERE event_time >= epoch_ms(TIMESTAMP '2024-01-30')
QUALIFY row_number() OVER (PARTITION BY station_id, line ORDER BY event_time DESC, taps_per_minute DESC) = 1"""
_CHECKS["soonest_per_route"] = """
SELECT route_id, direction, stop_id, stop_name, trip_id, eta_seconds FROM est
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY eta_seconds, stop_id, trip_id) <= 6"""
_CHECKS["snapshot_vehicles"] = "SELECT * FROM now"
_CHECKS["snapshot_arrivals"] = "SELECT * FROM board"
_CHECKS["snapshot_alerts"] = "SELECT * FROM al60"
_CHECKS["snapshot_decisions"] = """
SELECT route_id, direction, stop_id, stop_name, alert_type, action, dispatcher_note, rider_message, epoch_us(arrival_time) // 1000 AS ts FROM dd
ORDER BY arrival_time DESC, route_id, direction, stop_id, curr_trip, prev_trip LIMIT 60"""
_CHECKS["snapshot_forecasts"] = """
SELECT route_id, direction, stop_id, stop_name, stop_lat AS lat, stop_lon AS lon, curr_trip, forecast_type, headway_seconds, predicted_headway
FROM fc WHERE arrival_time >= TIMESTAMP '2024-01-30'
QUALIFY row_number() OVER (PARTITION BY route_id, direction, stop_id ORDER BY arrival_time DESC, curr_trip DESC) = 1"""
_COMMON["wnow"] = "SELECT * FROM wn WHERE event_time >= TIMESTAMP '2024-01-30 18:00:00' ORDER BY event_time DESC, temp_c NULLS FIRST, temp_f NULLS FIRST, condition, precip_mm, wind_kph NULLS FIRST, weather_code LIMIT 1"
_CHECKS["snapshot_weather"] = "SELECT temp_c, temp_f, condition, precip_mm, wind_kph, weather_code FROM wnow"
_CHECKS["snapshot_surges"] = "SELECT station_id, station_name, line, taps_per_minute, crowd_level FROM crowd"
_COMMON["cnt"] = """
SELECT (SELECT count(*) FROM now WHERE mode = 'subway') AS trains, (SELECT count(*) FROM now WHERE mode = 'bus') AS buses,
  (SELECT count(DISTINCT route_short) FROM now) AS routes, 
  (SELECT count(*) FROM al WHERE arrival_time BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-31') AS alerts, (SELECT count(*) FROM crowd) AS crowd_surges"""
_CHECKS["snapshot_counts"] = "SELECT * FROM cnt"
_CHECKS["snapshot_live"] = """
SELECT max(ts) > TIMESTAMP '2024-01-30 23:00:00' AS live FROM events"""
_COMMON["busy"] = """
SELECT mode, route_short, count(*) AS vehicles FROM {v} GROUP BY ALL""".replace("{v}", "now")
_CHECKS["top_routes"] = """
SELECT mode, route_short, vehicles, row_number() OVER (PARTITION BY mode ORDER BY vehicles DESC, route_short) AS position
FROM (SELECT mode, route_short, count(*) AS vehicles FROM month GROUP BY ALL)
QUALIFY position <= CASE mode WHEN 'subway' THEN 15 ELSE 20 END"""
_CHECKS["known_routes"] = """
SELECT DISTINCT mode, route_short AS route, 'R' || lpad(substr(route_short, 2), 12, '0') AS sort_key FROM month"""
_CHECKS["visible_vehicles"] = "SELECT * FROM veh WHERE mode = 'bus' AND route_short = 'R1'"
_CHECKS["anchor_alerts"] = """
SELECT a.curr_trip, a.stop_id, a.alert_type, a.arrival_time, p.lat, p.lon FROM al a JOIN place p ON a.curr_trip = p.trip_id"""
_CHECKS["anchor_forecasts"] = """
SELECT f.curr_trip, f.stop_id, f.forecast_type, f.arrival_time,
  CASE WHEN f.stop_id = 'S0' THEN f.stop_lat ELSE p.lat END AS lat, CASE WHEN f.stop_id = 'S0' THEN f.stop_lon ELSE p.lon END AS lon
FROM fc f JOIN place p ON f.curr_trip = p.trip_id"""


def _board(board: str, key: str, where: str = "true") -> str:
    """The three passes as 24 picks: one per bracket, then up to eight unseen keys, then up to eight of any."""
    return f"""
WITH RECURSIVE r AS (
  SELECT route_id, direction, stop_id, stop_name, trip_id, eta_seconds, {board} AS b, {key} AS key,
    row_number() OVER (PARTITION BY {board} ORDER BY eta_seconds, route_id, stop_id, trip_id) AS id,
    CASE WHEN eta_seconds < 30 THEN 0 WHEN eta_seconds < 120 THEN 1 WHEN eta_seconds < 240 THEN 2 WHEN eta_seconds < 420 THEN 3
      WHEN eta_seconds < 660 THEN 4 WHEN eta_seconds < 960 THEN 5 WHEN eta_seconds < 1300 THEN 6 WHEN eta_seconds < 1800 THEN 7 END AS bracket
  FROM est WHERE eta_seconds >= 0 AND {where}),
s(b, step, seen, chosen) AS (
  SELECT DISTINCT b, 0, []::VARCHAR[], []::BIGINT[] FROM r
  UNION ALL
  SELECT s.b, s.step + 1, list_append(s.seen, arg_min(r.key, r.id)),
    CASE WHEN min(r.id) IS NULL THEN s.chosen ELSE list_append(s.chosen, min(r.id)) END
  FROM s LEFT JOIN r ON r.b = s.b AND len(s.chosen) < 8 AND NOT list_contains(s.chosen, r.id)
    AND CASE WHEN s.step < 8 THEN r.bracket = s.step AND r.key <> '' AND NOT list_contains(s.seen, r.key)
      WHEN s.step < 16 THEN r.eta_seconds >= 30 AND (r.key = '' OR NOT list_contains(s.seen, r.key)) ELSE true END
  WHERE s.step < 24 GROUP BY s.b, s.step, s.seen, s.chosen)
SELECT route_id, direction, stop_id, stop_name, trip_id, eta_seconds, row_number() OVER (PARTITION BY r.b ORDER BY id) AS position
FROM r JOIN s ON r.b = s.b AND s.step = 24 AND list_contains(s.chosen, r.id)"""


_CHECKS["diverse_board_by_stop"] = _board("stop_id", "upper(route_id)")
_CHECKS["diverse_board_global"] = _board("''", "upper(route_id)")
_CHECKS["diverse_board_route"] = _board("''", "stop_name", "route_id = 'R3'")
_CHECKS["service_alerts_by_recency"] = "SELECT * RENAME (date AS ts) FROM sa"
_COMMON["ctx"] = """
SELECT 1 AS section, 0::BIGINT AS ord, 'LIVE FLEET: ' || trains || ' subway trains, ' || buses || ' buses, ' || routes || ' active routes, ' ||
  alerts || ' headway alerts. data_live=' || CASE WHEN (SELECT max(ts) > TIMESTAMP '2024-01-30 23:00:00' FROM events) THEN 'True' ELSE 'False' END AS line FROM cnt
UNION ALL SELECT 2, 0, 'SUBWAY LINES RUNNING: ' || string_agg(route_short || '(' || vehicles || ')', ', ' ORDER BY vehicles DESC, route_short) FROM busy WHERE mode = 'subway' HAVING count(*) > 0
UNION ALL SELECT 3, 0, 'BUS ROUTES RUNNING: ' || string_agg(route_short || '(' || vehicles || ')', ', ' ORDER BY vehicles DESC, route_short) FROM busy WHERE mode = 'bus' HAVING count(*) > 0
UNION ALL SELECT 4, 0, 'HEADWAY ALERTS (route/type/severity @ stop, headway secs):' WHERE (SELECT count(*) FROM al60) > 0
UNION ALL SELECT 4, n, '  - ' || route_id || ' ' || alert_type || ' [' || severity || '] @ ' || stop_name || ' (' || headway_seconds || 's)'
  FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, route_id, direction, stop_id, curr_trip) AS n FROM al60) WHERE n <= 40
UNION ALL SELECT 5, 0, 'FLINK DISPATCHER RECOMMENDATIONS (already issued by the streaming agent):' WHERE (SELECT count(*) FROM dd) > 0
UNION ALL SELECT 5, n, '  - ' || route_id || ': ' || action || ' — ' || dispatcher_note FROM (
  SELECT *, row_number() OVER (ORDER BY epoch_us(arrival_time) // 1000 DESC, route_id, direction, stop_id, dispatcher_note) AS n FROM (
    SELECT * FROM dd ORDER BY arrival_time DESC, route_id, direction, stop_id, curr_trip, prev_trip LIMIT 60)) WHERE n <= 40
UNION ALL SELECT 6, 0, 'NEXT ARRIVALS (route @ stop in N sec):' WHERE (SELECT count(*) FROM board) > 0
UNION ALL SELECT 6, n, '  - ' || route_id || ' @ ' || stop_name || ' in ' || eta_seconds || 's'
  FROM (SELECT *, row_number() OVER (ORDER BY eta_seconds, route_id, stop_id, trip_id) AS n FROM board) WHERE n <= 40
UNION ALL SELECT 7, 0, 'WEATHER: ' || condition || ', ' || CASE WHEN temp_f IS NULL THEN 'N/A' ELSE temp_f || '°F (' || temp_c || '°C)' END ||
  ', rain: ' || precip_mm || 'mm, wind: ' || wind_kph || ' km/h' FROM wnow
UNION ALL SELECT 8, 0, 'STATION PASSENGER SURGES: ' || string_agg(station_name || ' [' || line || '] (' || crowd_level || ', ' || taps_per_minute || ' taps/min)', ', ' ORDER BY station_id)
  FROM (SELECT * FROM crowd ORDER BY station_id LIMIT 5) HAVING count(*) > 0"""
_CHECKS["context_lines"] = "SELECT * FROM ctx"
_CHECKS["context_text"] = "SELECT string_agg(line, chr(10) ORDER BY section, ord) AS text FROM ctx"

_STOPPED = """
  coalesce(e.stop_name, b.stop_name, '') AS stop_name, coalesce(e.stop_lat, b.stop_lat, 0.0) AS stop_lat,
  coalesce(e.stop_lon, b.stop_lon, 0.0) AS stop_lon"""
_DIRECTION = """CASE WHEN right({s}, 1) IN ('N', 'S') THEN right({s}, 1) WHEN right({t}, 1) IN ('N', 'S') THEN right({t}, 1) ELSE 'U' END"""
_BASE = "CASE WHEN right({s}, 1) IN ('N', 'S') THEN left({s}, -1) ELSE {s} END"
_CHECKS["flatten_vehicles"] = f"""
SELECT v.trip_id, v.route_id, {_DIRECTION.format(s='v.stop_id', t='v.trip_id')} AS direction, v.stop_id, v.stop_base, {_STOPPED},
  v.status AS current_status, v.k AS stop_sequence,
  make_timestamp((CASE WHEN k % 5 = 0 THEN secs ELSE secs - 7 END) * 1000000) AS event_time
FROM (SELECT *, {_BASE.format(s='stop_id')} AS stop_base FROM ent WHERE NOT is_update AND trip_id <> '' AND route_id <> '') v
LEFT JOIN st e ON v.stop_id = e.stop_id LEFT JOIN st b ON v.stop_base = b.stop_id"""
_CHECKS["flatten_trip_updates"] = f"""
SELECT u.trip_id, u.route_id, {_DIRECTION.format(s='u.sid', t='u.trip_id')} AS direction, u.sid AS stop_id, u.sid AS stop_base, {_STOPPED},
  arrival AS arrival_epoch, departure AS departure_epoch, make_timestamp(secs * 1000000) AS event_time
FROM (SELECT *, CASE WHEN (k + o) % 9 = 0 THEN '' ELSE 'S' || ((k + o) % 40) END AS sid,
    (CASE WHEN (k + o) % 6 = 0 THEN 0 ELSE secs + 60 * (o + 1) END)::BIGINT AS arrival,
    (CASE WHEN (k + o) % 4 <> 0 THEN secs + 60 * (o + 1) + 20 ELSE 0 END)::BIGINT AS departure
  FROM ent, (VALUES (0), (1), (2)) t(o) WHERE is_update AND trip_id <> '' AND route_id <> '') u
LEFT JOIN st e ON u.sid = e.stop_id LEFT JOIN st b ON u.sid = b.stop_id
WHERE sid <> '' AND (arrival <> 0 OR departure <> 0)"""
_FLAT_BUS = """
SELECT CASE WHEN trip_id = '' THEN route_id || ':' || vehicle_id ELSE trip_id END AS trip_id, route_id, 'R' || (user_id % 20) AS route_short,
  CASE WHEN k % 4 <> 0 THEN (k % 2)::VARCHAR ELSE '' END AS direction, stop_id, lat AS vehicle_lat, lon AS vehicle_lon, bearing,
  status AS current_status, make_timestamp((CASE WHEN k % 5 = 0 THEN secs ELSE secs - 7 END) * 1000000) AS event_time
FROM ent WHERE NOT is_update AND route_id <> '' AND lat <> 0 AND lon <> 0"""
_CHECKS["flatten_buses"] = _FLAT_BUS
_CHECKS["flatten_buses_of_agency"] = _FLAT_BUS + " AND user_id % 3 = 0"
_CHECKS["feed_stats"] = """
SELECT feed, count(*) AS entities, count(*) FILTER (WHERE NOT is_update) AS vehicle_positions,
  count(*) FILTER (WHERE is_update) AS trip_updates FROM ent GROUP BY ROLLUP (feed)"""
_CHECKS["decode_payload"] = """
SELECT CASE WHEN k % 5 = 0 THEN 'KEY' || k ELSE 'ST' || user_id END AS station_id, event_type AS station_name, k AS taps_per_minute
FROM ev WHERE k % 17 <> 0"""
_CHECKS["merge_feeds"] = "SELECT feed, count(*) AS n, max(secs) AS newest FROM ent WHERE feed IN ('G1', 'G5') GROUP BY feed"
_CHECKS["tail_events"] = "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 250"
_CHECKS["stop_identifiers"] = f"""
SELECT stop_id, {_BASE.format(s='stop_id')} AS base, {_DIRECTION.format(s='stop_id', t='trip_id')} AS direction, count(*) AS n
FROM ent WHERE NOT is_update GROUP BY ALL"""
_CHECKS["route_identifiers"] = """
SELECT CASE WHEN route_id = '' THEN '' ELSE 'R' || (user_id % 20) END AS route_short,
  CASE user_id % 3 WHEN 0 THEN 'EAST SIDE' WHEN 1 THEN 'WEST' ELSE '' END AS agency, user_id % 3 = 1 AS is_west, count(*) AS n
FROM ent WHERE NOT is_update GROUP BY ALL"""
_CHECKS["rule_columns"] = f"""
WITH e AS (SELECT k, floor(value * 8)::BIGINT AS s FROM ev),
t AS (SELECT *, CASE WHEN s < 150 THEN 'BUNCHING' WHEN s > 900 THEN 'GAP' ELSE 'NORMAL' END AS kind,
  CASE WHEN k % 3 <> 0 THEN k / 50 ELSE 0 END AS rain, CASE WHEN k % 4 <> 0 THEN k / 2 ELSE 0 END AS wind FROM e)
SELECT kind, CASE WHEN s < 75 OR s > 1500 THEN 'HIGH' WHEN s < 150 OR s > 900 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {_ACTIONS.format(k='kind', h='s')} AS action,
  CASE WHEN s < 150 AND k * 10 >= 150 THEN 'PREDICTED_BUNCHING' WHEN s > 900 AND k * 10 <= 900 THEN 'PREDICTED_GAP' ELSE 'STABLE' END AS forecast,
  CASE WHEN k >= 80 THEN 'RAIN_SHOWERS' WHEN k >= 51 THEN 'DRIZZLE' WHEN k >= 1 THEN 'OVERCAST' ELSE 'CLEAR' END AS condition,
  CASE WHEN rain > 1 OR wind > 30 THEN 'HIGH_WEATHER_DISRUPTION' WHEN rain > 0 OR wind > 15 THEN 'MODERATE_WEATHER_RISK' ELSE 'NORMAL_TRACK_CONDITIONS' END AS risk,
  CASE k % 5 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' ELSE 'IN_TRANSIT_TO' END AS status,
  CASE k % 4 WHEN 0 THEN 'Uptown' WHEN 1 THEN '→' WHEN 2 THEN 'E' ELSE '--' END AS label, count(*) AS n
FROM t GROUP BY ALL"""
_CHECKS["eta_texts"] = """
SELECT trip_id, stop_id, CASE WHEN eta_seconds < 30 THEN 'arriving' WHEN eta_seconds >= 60
    THEN (eta_seconds // 60) || 'm ' || lpad((eta_seconds % 60)::VARCHAR, 2, '0') || 's' ELSE eta_seconds || 's' END AS eta_text,
  CASE direction WHEN 'N' THEN 'Uptown' ELSE 'Downtown' END AS heading FROM est WHERE eta_seconds >= 0"""
_CHECKS["arrival_keys"] = """
SELECT event_id, coalesce(t, c, 'R1-' || coalesce(direction, 'None') || '-' || coalesce(stop_name, 'None')) AS trip_id, c AS curr_trip,
  'R1' AS route_id, direction, coalesce(s, stop_name) AS stop_id, stop_name FROM (
  SELECT event_id, CASE WHEN k % 3 = 2 THEN 'T' || user_id END AS t, CASE WHEN k % 2 = 0 THEN 'C' || user_id END AS c,
    CASE WHEN k % 4 = 0 THEN 'N' END AS direction, CASE WHEN k % 5 <> 0 THEN 'S' || k END AS s, CASE WHEN k % 7 <> 0 THEN 'Stop ' || k END AS stop_name FROM ev)
WHERE coalesce(s, stop_name) IS NOT NULL"""
_CHECKS["eta_at"] = """
SELECT trip_id, stop_id, e AS eta_seconds FROM (
  SELECT *, CASE WHEN eta_seconds % 2 = 0 THEN eta_seconds - 100 ELSE eta_seconds - 200 END AS e FROM est) WHERE e BETWEEN 0 AND 1800"""
_CHECKS["normalize_surges"] = """
SELECT coalesce(sid, name) AS station_id, coalesce(name, sid) AS station_name, line,
  CASE WHEN taps % 5 <> 0 THEN taps ELSE 0 END::INTEGER AS taps_per_minute, CASE WHEN taps % 4 <> 0 THEN crowd_level ELSE 'NORMAL' END AS crowd_level, event_time
FROM (SELECT *, taps_per_minute AS taps, CASE WHEN taps_per_minute % 3 <> 0 THEN station_id END AS sid,
    CASE WHEN taps_per_minute % 7 <> 0 THEN station_name END AS name FROM sg) WHERE coalesce(sid, name) IS NOT NULL"""
_CHECKS["normalize_weather"] = "SELECT temp_c, temp_f, condition, precip_mm, wind_kph, weather_code, event_id FROM wn"
_CHECKS["epoch_times"] = "SELECT event_time, make_timestamp(event_time * 1000) AS seen, event_time // 1000 AS seconds FROM sg"
_CHECKS["trunk_shapes"] = "SELECT * FROM trunk"
_CHECKS["route_shapes"] = "SELECT route_id, shape_id, color, position, lat, lon FROM rsh"
_CHECKS["geojson_features"] = """
WITH p AS (SELECT *, unnest(CASE WHEN position > 0 AND position % 20000 = 0 THEN [position // 20000 - 1, position // 20000] ELSE [position // 20000] END) AS part FROM rsh)
SELECT route_id, 'bus' AS mode, color, part, count(*) AS n_points, arg_min(lon, position) AS first_lon, arg_min(lat, position) AS first_lat,
  arg_max(lon, position) AS last_lon, arg_max(lat, position) AS last_lat
FROM p GROUP BY route_id, color, part HAVING count(*) >= 2"""
_CHECKS["static_files"] = """
SELECT 'stops' AS name, stop_id AS id, stop_name AS detail, CASE WHEN stop_id = 'S3' THEN 0.0 ELSE stop_lat END AS lat,
  CASE WHEN stop_id = 'S3' THEN 0.0 ELSE stop_lon END AS lon FROM st
UNION ALL SELECT 'shapes', shape_id, seq::VARCHAR, lat, lon FROM shp
UNION ALL SELECT 'trips', 'SH' || (o_orderkey % 60), 'R' || (o_custkey % 20), NULL, NULL FROM orders
UNION ALL SELECT 'routes', 'R' || n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE lpad(printf('%X', n_nationkey * 4099), 6, '0') END, NULL, NULL
FROM nation"""
_CHECKS["read_weather_events"] = """
SELECT date_trunc('minute', event_time) AS event_time, temp AS temperature_2m, precip AS precipitation, rain, code AS weather_code,
  wind AS wind_speed_10m FROM wx"""
_CHECKS["read_vehicle_positions"] = "SELECT *, stop_id AS stop_base, right(stop_id, 1)::INTEGER AS stop_sequence FROM pos"
_COMMON["tu_all"] = _COMMON["tu"].replace(" FROM lineitem", """,
  'S' || (l_suppkey % 40) AS stop_base, (1704067200 + (l_orderkey * 7 + l_linenumber * 131) % 4000 - 980)::BIGINT AS departure_epoch
  FROM lineitem""")
_CHECKS["read_trip_updates"] = "SELECT * FROM tu_all"
_CHECKS["read_bus_positions"] = "SELECT *, '' AS stop_id FROM bus"
_CHECKS["read_passenger_surges"] = "SELECT * FROM sg"
_CHECKS["read_feeds"] = """
SELECT 'vehicle_positions' AS name, count(*) AS n FROM pos UNION ALL SELECT 'trip_updates', count(*) FROM tu
UNION ALL SELECT 'bus_positions', count(*) FROM bus UNION ALL SELECT 'passenger_surges', count(*) FROM sg"""
_CHECKS["outbox_file"] = """
SELECT route_id, direction, stop_id, stop_name, alert_type, severity, headway_seconds, action, action AS llm_action, dispatcher_note
FROM dd"""
_CHECKS["bucketed_estimates"] = "SELECT * FROM est"
_CHECKS["keyed_table"] = """
SELECT * FROM tu WHERE arrival_epoch > 0
QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY event_time DESC, arrival_epoch DESC) = 1"""
_CHECKS["stream_arrival_estimates"] = "SELECT * FROM est"
_CHECKS["stream_latest_rows"] = _CHECKS["keyed_table"].replace("*", "trip_id, stop_id, arrival_epoch, event_time", 1)
_CHECKS["stream_upsert"] = _CHECKS["stream_latest_rows"]
_CHECKS["stream_congestion"] = _HOURLY
_CHECKS["stream_rollup"] = _HOURLY
_CHECKS["stream_vehicle_counts"] = """
SELECT route_short, current_status, count(*) AS vehicles FROM (
  SELECT * FROM bus QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY event_time DESC, route_short DESC NULLS LAST,
    current_status DESC NULLS LAST, bearing DESC NULLS LAST) = 1)
GROUP BY route_short, current_status"""
_CHECKS["stream_anomalies"], _CHECKS["stream_trends"] = _CHECKS["anomaly_alerts"], _CHECKS["trend_forecasts"]
_CHECKS["stream_headway"] = "SELECT * FROM hw"
_CHECKS["stream_forecast"] = "SELECT * FROM fc"
_CHECKS["stream_weather_impact"] = _CHECKS["weather_impact"]
_CHECKS["stream_bottlenecks"] = _CHECKS["station_bottlenecks"]
_CHECKS["stream_first_rows"] = "SELECT trip_id, route_id, direction, stop_id, stop_name, stop_lat, stop_lon, event_time FROM arr"
_CHECKS["stream_latest_state"] = """
SELECT sg.*, moment FROM sg, (VALUES (1706572800000), (1706659200000)) AS m(moment)
WHERE event_time <= 1706572800000 AND event_time >= moment - 129600000
QUALIFY row_number() OVER (PARTITION BY moment, station_id, line ORDER BY event_time DESC, taps_per_minute DESC) = 1"""
_CHECKS["stream_pipeline"] = f"""
WITH wi AS ({_CHECKS["weather_impact"]})
SELECT 'weather' AS part, route_id, direction, stop_name, alert_type, severity, headway_seconds, weather_risk_level AS result FROM wi
UNION ALL SELECT 'decision', route_id, direction, stop_name, alert_type, severity, headway_seconds, action FROM act"""
_CHECKS["stream_outbox"] = """
SELECT route_id, direction, stop_id, stop_name, alert_type, severity, headway_seconds, action, '**MONITOR**' AS llm_action,
  alert_type AS dispatcher_note FROM act"""
_CHECKS["stream_decisions"] = """
SELECT route_id, direction, stop_id, curr_trip, prev_trip, stop_name, stop_lat, stop_lon, alert_type, severity, headway_seconds, arrival_time,
  action, '**MONITOR**' AS llm_action, alert_type AS dispatcher_note, headway_seconds || 's' AS rider_message, 'seen' AS reasoning,
  'Action: **MONITOR**' || chr(10) || 'Dispatcher Note: ' || alert_type || chr(10) || 'Rider Message: ' || headway_seconds || 's' ||
  chr(10) || 'Reasoning: seen' AS raw_response FROM act"""


def _needed(sql: str) -> list[str]:
    """Common tables a text mentions, directly or through others, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[A-Za-z_]\w*", todo.pop()))
        for name in _COMMON:
            if name in words and name not in found:
                found.add(name)
                todo.append(_COMMON[name])
    return list(found)


def _ordered(names: list[str]) -> list[str]:
    """Dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _needed(_COMMON[name]):
            if other != name:
                visit(other)
        done.append(name)

    for name in names:
        visit(name)
    return done


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _CHECKS.items():
        common = ", ".join(f"{c} AS ({_COMMON[c].strip()})" for c in _ordered(_needed(sql)))
        body = sql.strip()
        if common and body.startswith("WITH "):
            recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
            body = f"WITH {recursive}{common}, {body[5 + len(recursive):]}"
        elif common:
            body = f"WITH {common} {body}"
        out[name] = body
    return out
