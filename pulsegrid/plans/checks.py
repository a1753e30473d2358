"""Independent SQL for the catalog's queries, run by DuckDB on the same tables.

The statements compute results by brute force (pair tables, zero-filled rows)
where the library works from sums or day blocks, so they check the method too.
"""

from __future__ import annotations

CHECKS: dict[str, str] = {}


def dbl(value: float) -> str:
    """An exact DOUBLE literal."""
    return f"CAST('{value!r}' AS DOUBLE)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def coordinate(low: float, span: float, multiplier: int) -> str:
    return (
        f"{dbl(low)} + {dbl(span)} * CAST((event_id % 1000 * {multiplier}) % 1000 AS DOUBLE)"
        f" / {dbl(1000.0)}"
    )


TRIPS = f"""trips AS MATERIALIZED (
  SELECT event_id AS trip_id, ts AS pickup_ts, ts + to_minutes(event_id % 60) AS dropoff_ts,
    {coordinate(-74.2, 0.55, 7919)} AS pickup_lon,
    {coordinate(40.55, 0.35, 104729)} AS pickup_lat,
    {coordinate(-74.2, 0.55, 15485863)} AS dropoff_lon,
    {coordinate(40.55, 0.35, 32452843)} AS dropoff_lat,
    CAST(user_id % 40 AS INT) AS pickup_zone
  FROM events)"""


#: The first midnight seen in ``events``; every slot id counts from it.
ORIGIN = "(SELECT date_trunc('day', min(ts)) FROM events)"
TEST_START = "(SELECT date_trunc('day', min(ts)) + INTERVAL 21 DAY FROM events)"
#: The Monday of the ISO week in which the test part of a split by week starts.
TEST_MONDAY = "(SELECT date_trunc('week', date_trunc('day', min(ts)) + INTERVAL 21 DAY) FROM events)"
DAY_COUNT = "(SELECT date_diff('day', min(ts), max(ts)) + 1 FROM events)"


def slot(ts: str, width: int = 600) -> str:
    micros = f"CAST(epoch_us({ts}) - epoch_us({ORIGIN}) AS DOUBLE)"
    return f"CAST(trunc({micros} / {dbl(width * 1e6)}) AS INT)"


def cell(value: str, low: float, high: float, n: int) -> str:
    position = f"trunc(({value} - {dbl(low)}) / (({dbl(high)} - {dbl(low)}) / {n}))"
    return f"CASE WHEN {position} BETWEEN 0 AND {n - 1} THEN CAST({position} AS INT) END"


def cell_x(value: str, n: int) -> str:
    return cell(value, -74.15, -73.72, n)


def cell_y(value: str, n: int) -> str:
    return cell(value, 40.58, 40.85, n)


def corner(index: str, low: float, high: float, n: int) -> str:
    return f"({index} * (({dbl(high)} - {dbl(low)}) / {n}) + {dbl(low)})"


def calendar(width: int) -> str:
    """All whole days with all calendar fields, one row per slot."""
    per_day = 86400 // width
    return f"""calendar AS MATERIALIZED (
  SELECT slot_id, slot_start, slot_start + to_seconds({width}) AS slot_end,
    CAST(month(slot_start) AS INT) AS month, CAST(isoyear(slot_start) AS INT) AS year, CAST(weekofyear(slot_start) AS INT) AS week,
    CAST(day(slot_start) AS INT) AS day, CAST(isodow(slot_start) - 1 AS INT) AS day_of_week,
    CAST(slot_id % {per_day} AS INT) AS time_of_day_code,
    CAST(hour(slot_start) AS INT) AS hour, CAST(minute(slot_start) AS INT) AS minute
  FROM (SELECT CAST(i AS INT) AS slot_id, {ORIGIN} + to_seconds(i * {width}) AS slot_start
        FROM (SELECT unnest(range({DAY_COUNT} * {per_day})) AS i)))"""


def zone_demand(width: int = 600) -> str:
    return f"""demand AS MATERIALIZED (
  SELECT {slot('pickup_ts', width)} AS slot_id, pickup_zone AS zone_id, count(*) AS demand
  FROM trips GROUP BY 1, 2)"""


def cells(n: int) -> str:
    return f"""cells AS MATERIALIZED (
  SELECT trip_id, pickup_ts, dropoff_ts,
    {cell_x('pickup_lon', n)} AS pickup_x, {cell_y('pickup_lat', n)} AS pickup_y,
    {cell_x('dropoff_lon', n)} AS dropoff_x, {cell_y('dropoff_lat', n)} AS dropoff_y
  FROM trips)"""


INSIDE = """inside AS MATERIALIZED (
  SELECT * FROM cells WHERE pickup_x IS NOT NULL AND pickup_y IS NOT NULL
    AND dropoff_x IS NOT NULL AND dropoff_y IS NOT NULL)"""


def cell_demand(width: int = 600, n: int = 5) -> str:
    return f"""demand AS MATERIALIZED (
  SELECT {slot('pickup_ts', width)} AS slot_id, CAST(pickup_x * {n} + pickup_y AS INT) AS zone_id,
    count(*) AS demand
  FROM inside GROUP BY 1, 2)"""


DENSE = f"""dense AS MATERIALIZED (
  SELECT s.slot_id, z.zone_id, coalesce(d.demand, 0) AS demand, s.week, s.day, s.day_of_week,
    s.time_of_day_code, s.hour, s.minute, s.slot_start < {TEST_MONDAY} AS before_test
  FROM calendar s CROSS JOIN (SELECT DISTINCT zone_id FROM demand) z
  LEFT JOIN demand d ON d.slot_id = s.slot_id AND d.zone_id = z.zone_id)"""

SPARSE = f"""sparse AS MATERIALIZED (
  SELECT d.slot_id, d.zone_id, d.demand, s.month, s.week, s.day, s.day_of_week,
    s.time_of_day_code, s.hour, s.minute, s.year, s.slot_start < {TEST_MONDAY} AS before_test
  FROM demand d JOIN calendar s ON d.slot_id = s.slot_id)"""

CENTROIDS = f"""centroids AS MATERIALIZED (
  SELECT CAST(x * 12 + y AS INT) AS zone_id, (min(pickup_lon) + max(pickup_lon)) / 2 AS centroid_lon,
    (min(pickup_lat) + max(pickup_lat)) / 2 AS centroid_lat
  FROM (SELECT *, {cell('pickup_lon', -74.2, -73.65, 10)} AS x,
          {cell('pickup_lat', 40.55, 40.9, 12)} AS y FROM trips)
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)"""


def nearest(end: str) -> str:
    distance = (
        f"(c.centroid_lon - t.{end}_lon) * (c.centroid_lon - t.{end}_lon)"
        f" + (c.centroid_lat - t.{end}_lat) * (c.centroid_lat - t.{end}_lat)"
    )
    return f"""{end}s AS MATERIALIZED (
  SELECT trip_id, zone_id AS {end}_zone FROM (
    SELECT t.trip_id, c.zone_id,
      row_number() OVER (PARTITION BY t.trip_id ORDER BY {distance}, c.zone_id) AS rn
    FROM trips t CROSS JOIN centroids c) WHERE rn = 1)"""


LOCATED = """located AS MATERIALIZED (
  SELECT t.trip_id, t.pickup_ts, t.dropoff_ts, p.pickup_zone, d.dropoff_zone
  FROM (SELECT trip_id, pickup_ts, dropoff_ts FROM trips) t
  JOIN pickups p ON p.trip_id = t.trip_id JOIN dropoffs d ON d.trip_id = t.trip_id)"""

ZONING = (TRIPS, CENTROIDS, nearest("pickup"), nearest("dropoff"), LOCATED)


def located_demand(width: int) -> str:
    return f"""demand AS MATERIALIZED (
  SELECT {slot('pickup_ts', width)} AS slot_id, pickup_zone AS zone_id, count(*) AS demand
  FROM located GROUP BY 1, 2)"""


def flags(lon: str, lat: str) -> str:
    manhattan = (
        f"{lon} > {dbl(-74.025)} AND {lon} < {dbl(-73.975)}"
        f" AND {lat} > {dbl(40.705)} AND {lat} < {dbl(40.75)}"
    )
    airport = (
        f"{lon} > {dbl(-73.81)} AND {lon} < {dbl(-73.77)}"
        f" AND {lat} > {dbl(40.64)} AND {lat} < {dbl(40.663)}"
    )
    return (
        f"CASE WHEN {manhattan} THEN 1 ELSE 0 END AS is_manhattan,\n"
        f"    CASE WHEN {manhattan} THEN 0 WHEN {airport} THEN 1 ELSE 0 END AS is_airport"
    )


FLAGS = f"""flags AS (
  SELECT zone_id, {flags('centroid_lon', 'centroid_lat')} FROM centroids)"""

CALENDAR_COLUMNS = "time_of_day_code, day_of_week, day, week, hour, minute"


def grid_features(source: str, more: str = "") -> str:
    """Feature rows of a table with a flattened 5 x 5 cell id."""
    lon = corner("(zone_id // 5)", -74.15, -73.72, 5)
    lat = corner("(zone_id % 5)", 40.58, 40.85, 5)
    return f"""SELECT slot_id, CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y,
    {more}{CALENDAR_COLUMNS}, {flags(lon, lat)}, demand
  FROM {source}"""


def scores(rows: str, keys: tuple[str, ...] = ("zone_id",), pooled: bool = True,
           digits: int | None = 6) -> str:
    """RMSE and R2 per key of ``prediction`` against ``demand``, and pooled."""
    rmse, r2 = "sqrt(sse / n)", "1 - sse / sst"
    if digits is not None:
        rmse, r2 = f"round({rmse}, {digits})", f"round({r2}, {digits})"

    def one(columns: str, group: str) -> str:
        return f"""SELECT {columns} n, {rmse} AS rmse, CASE WHEN sst > 0 THEN {r2} END AS r2
  FROM (SELECT {columns} count(*) AS n, sum((prediction - demand) * (prediction - demand)) AS sse,
          var_pop(demand) * count(*) AS sst
        FROM {rows} {group})"""

    text = one("".join(f"{k}, " for k in keys), f"GROUP BY {', '.join(keys)}" if keys else "")
    if pooled and keys:
        total = one("", "")
        nulls = "".join(f"CAST(NULL AS INT) AS {k}, " for k in keys)
        text += f"\n  UNION ALL SELECT {nulls} n, rmse, r2 FROM ({total})"
    return text


def check(name: str, *parts: str, sql: str) -> None:
    CHECKS[name] = (with_(*parts) if parts else "") + sql


SPLIT = 21 * 144
ZONE_MODEL = (TRIPS, zone_demand(), calendar(600), DENSE)
ZONE_HOURLY = (TRIPS, zone_demand(3600), calendar(3600), DENSE)
CELL_MODEL = (TRIPS, cells(5), INSIDE, cell_demand(), calendar(600), DENSE)
CELL_HOURLY = (TRIPS, cells(5), INSIDE, cell_demand(3600), calendar(3600), DENSE)
ZONE_SPARSE = (TRIPS, zone_demand(), calendar(600), SPARSE)

# --- sources and sinks -----------------------------------------------------

TRIP_TIMES = f"""SELECT trip_id, {slot('pickup_ts')} AS pickup_slot,
  {slot('dropoff_ts')} AS dropoff_slot FROM trips"""

check("src_csv_or_parquet", TRIPS, sql=f"""
SELECT trip_id, pickup_ts, dropoff_ts, round(pickup_lon, 6) AS pickup_lon,
  round(pickup_lat, 6) AS pickup_lat, pickup_slot, dropoff_slot
FROM trips JOIN ({TRIP_TIMES}) USING (trip_id)""")
check("src_cell_partition", *CELL_HOURLY, sql=f"""
SELECT * FROM ({grid_features('dense')}) WHERE cell_x = 2 AND cell_y = 2""")
check("sink_roundtrip", TRIPS, zone_demand(), sql="SELECT slot_id, zone_id, demand FROM demand")
check("sink_by_date", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS trip_date, count(*) AS cnt FROM events GROUP BY 1""")
check("grid_meta", TRIPS, sql=f"""
SELECT {dbl(-74.15)} AS lon_min, {dbl(-73.72)} AS lon_max, {dbl(40.58)} AS lat_min,
  {dbl(40.85)} AS lat_max, 25 AS nx, 25 AS ny, count(*) AS trips_inside
FROM trips WHERE {cell_x('pickup_lon', 25)} IS NOT NULL AND {cell_y('pickup_lat', 25)} IS NOT NULL""")
check("zone_groups", *ZONE_SPARSE, sql=f"""
SELECT zone_id, count(*) FILTER (WHERE before_test) AS n_train,
  count(*) FILTER (WHERE NOT before_test) AS n_test FROM sparse GROUP BY 1""")

# --- time ------------------------------------------------------------------

check("time_slots", calendar(600), sql="SELECT slot_id, slot_start, slot_end FROM calendar")
check("time_slots_year", sql="""
SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS slot_id, t AS slot_start,
  t + INTERVAL 6 HOUR AS slot_end
FROM (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)),
        date_trunc('day', max(o_orderdate)) + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS t FROM orders)""")
check("assign_slot", TRIPS, sql=TRIP_TIMES)
check("extend_slots", calendar(600), sql="""
SELECT slot_id, slot_start, slot_end, day_of_week, time_of_day_code, month FROM calendar""")
check("slot_calendar", calendar(600), sql="SELECT * FROM calendar")
for name, side in (("weekday_day_counts", "<"), ("weekday_day_counts_test", ">=")):
    check(name, calendar(600), sql=f"""
SELECT day_of_week, count(DISTINCT CAST(slot_start AS DATE)) AS days FROM calendar
WHERE slot_start {side} {TEST_START} GROUP BY 1""")
check("calendar_lookup", *ZONE_SPARSE, sql="""
SELECT DISTINCT year, week, day_of_week, time_of_day_code, day, hour, minute FROM sparse""")
for unit, table, column, part in (
    ("month", "orders", "o_orderdate", "month(o_orderdate)"),
    ("week", "orders", "o_orderdate", "weekofyear(o_orderdate)"),
    ("weekday", "orders", "o_orderdate", "isodow(o_orderdate)"),
    ("hour", "events", "ts", "hour(ts)"),
):
    check(f"profile_{unit}", sql=f"""
SELECT CAST({part} AS INT) AS {unit}, count({column}) AS cnt FROM {table} GROUP BY 1""")

# --- space -----------------------------------------------------------------

CELL_COLUMNS = "trip_id, pickup_x, pickup_y, dropoff_x, dropoff_y"
check("grid_assign", TRIPS, cells(25), sql=f"SELECT {CELL_COLUMNS} FROM cells")
check("grid_assign_fine", TRIPS, cells(100), sql=f"SELECT {CELL_COLUMNS} FROM cells")
check("grid_cell_id", TRIPS, cells(100), sql="""
SELECT trip_id, CAST(pickup_x * 100 + pickup_y AS INT) AS pickup_zone,
  CAST(dropoff_x * 100 + dropoff_y AS INT) AS dropoff_zone FROM cells""")
check("grid_cell_origin", TRIPS, cells(25), sql=f"""
SELECT DISTINCT pickup_x AS cell_x, pickup_y AS cell_y,
  round({corner('pickup_x', -74.15, -73.72, 25)}, 6) AS lon,
  round({corner('pickup_y', 40.58, 40.85, 25)}, 6) AS lat
FROM cells WHERE pickup_x IS NOT NULL AND pickup_y IS NOT NULL""")
check("nearest_centroid", *ZONING, sql="SELECT trip_id, pickup_zone, dropoff_zone FROM located")
check("nearest_centroid_points", sql="""
WITH parts AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  means AS (SELECT label AS zone_id, i, round(avg(x), 6) AS c FROM parts GROUP BY 1, 2),
  pairs AS (SELECT p.vec_id, p.label, m.zone_id, sum((p.x - m.c) * (p.x - m.c)) AS d2
    FROM parts p JOIN means m ON m.i = p.i GROUP BY 1, 2, 3)
SELECT vec_id, label, zone_id FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, zone_id) AS rn FROM pairs)
WHERE rn = 1""")
check("zone_flags", TRIPS, CENTROIDS, FLAGS, sql="SELECT * FROM flags")
check("centroid_demand", *ZONING, sql="""
SELECT c.zone_id, c.centroid_lon, c.centroid_lat, count(*) AS cnt
FROM located l JOIN centroids c ON l.pickup_zone = c.zone_id WHERE c.zone_id < 60 GROUP BY ALL""")
HEAT_BASE = (TRIPS, cells(5), INSIDE, cell_demand())
check("grid_heat", *HEAT_BASE, sql=f"""
SELECT *, round(pow(2, log10(cnt)), 6) AS bubble FROM (
  SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y,
    round({corner('(zone_id // 5)', -74.15, -73.72, 5)}, 6) AS lon,
    round({corner('(zone_id % 5)', 40.58, 40.85, 5)}, 6) AS lat,
    CAST(sum(demand) AS BIGINT) AS cnt FROM demand GROUP BY ALL)""")
check("grid_heat_rows", *HEAT_BASE, sql="""
SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, count(*) AS cnt,
  round(pow(2, log10(count(*))), 6) AS bubble FROM demand GROUP BY 1, 2""")
check("nonzero_points", TRIPS, sql="""
SELECT trip_id, round(pickup_lon, 6) AS pickup_lon, round(pickup_lat, 6) AS pickup_lat
FROM trips WHERE trip_id % 50 <> 0 AND pickup_lon <> 0 AND pickup_lat <> 0""")
OBSERVED = """
SELECT s.slot_id, z.zone_id, coalesce(d.demand, 0) AS demand
FROM (SELECT DISTINCT slot_id FROM demand) s CROSS JOIN (SELECT DISTINCT zone_id FROM demand) z
LEFT JOIN demand d ON d.slot_id = s.slot_id AND d.zone_id = z.zone_id"""
check("zoning_centroids", *ZONING, located_demand(3600), sql=OBSERVED)


def cell_counts(width: int) -> str:
    return f"""
SELECT {slot('pickup_ts', width)} AS slot_id, pickup_x AS cell_x, pickup_y AS cell_y,
  count(*) AS demand FROM inside GROUP BY 1, 2, 3"""


check("zoning_grid", TRIPS, cells(25), INSIDE, sql=cell_counts(600))

# --- projections, filters, splits ------------------------------------------

check("feat_drop", *ZONE_SPARSE, sql=f"SELECT {CALENDAR_COLUMNS}, demand FROM sparse")
check("filter_zone", TRIPS, zone_demand(), sql="SELECT * FROM demand WHERE zone_id = 7")
check("split_by_week", *ZONE_SPARSE, sql=f"""
SELECT slot_id, zone_id, week, demand, before_test AS is_train FROM sparse""")
check("groups_min_rows", TRIPS, zone_demand(), sql="""
SELECT zone_id, count(*) AS n FROM demand GROUP BY 1 HAVING count(*) >= 10""")
check("groups_train_test", TRIPS, zone_demand(), sql=f"""
SELECT * FROM (SELECT zone_id, count(*) FILTER (WHERE slot_id < {SPLIT}) AS n_train,
    count(*) FILTER (WHERE slot_id >= {SPLIT}) AS n_test FROM demand GROUP BY 1)
WHERE n_train >= 5 AND n_test >= 3""")
check("index_slice", TRIPS, zone_demand(), sql="""
SELECT * FROM (SELECT row_number() OVER (ORDER BY slot_id, zone_id) - 1 AS row_index,
    slot_id, zone_id, demand FROM demand) WHERE row_index >= 500 AND row_index < 1500""")
check("split_first_n", *ZONE_HOURLY, sql="""
SELECT slot_id, zone_id, demand,
  row_number() OVER (PARTITION BY zone_id ORDER BY slot_id) <= 504 AS is_train FROM dense""")
check("split_leading_fraction", TRIPS, zone_demand(), sql=f"""
SELECT slot_id, zone_id, demand, row_number() OVER (PARTITION BY zone_id ORDER BY slot_id)
  > trunc(count(*) OVER (PARTITION BY zone_id) * {dbl(0.1667)}) AS is_train FROM demand""")
check("split_by_key", TRIPS, zone_demand(), sql="""
SELECT slot_id, zone_id, demand, slot_id % 100 < 70 AS is_train FROM demand""")
check("top_demand", TRIPS, zone_demand(), sql="""
SELECT zone_id, CAST(sum(demand) AS BIGINT) AS demand FROM demand
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
CELL_SPARSE = (TRIPS, cells(5), INSIDE, cell_demand(), calendar(600), SPARSE)
check("union_cells", *CELL_SPARSE, sql=grid_features("sparse"))

# --- joins, demand, look-ups -----------------------------------------------

check("combine_cluster", *ZONING, sql=f"""
SELECT trip_id, pickup_zone, dropoff_zone, {slot('pickup_ts')} AS pickup_slot,
  {slot('dropoff_ts')} AS dropoff_slot FROM located""")
check("grid_combined", TRIPS, cells(25), INSIDE, sql=f"""
SELECT {CELL_COLUMNS}, {slot('pickup_ts')} AS pickup_slot, {slot('dropoff_ts')} AS dropoff_slot
FROM inside""")
check("demand_cluster", TRIPS, zone_demand(), sql="SELECT * FROM demand")
check("demand_grid", TRIPS, cells(25), INSIDE, sql=cell_counts(3600))
check("demand_grid_flat", TRIPS, cells(100), INSIDE, sql=f"""
SELECT {slot('pickup_ts')} AS slot_id, CAST(pickup_x * 100 + pickup_y AS INT) AS zone_id,
  count(*) AS demand FROM inside GROUP BY 1, 2""")
check("demand_calendar", *ZONE_SPARSE, sql="""
SELECT slot_id, zone_id, month, day_of_week, time_of_day_code, demand FROM sparse""")
check("demand_slots", TRIPS, zone_demand(), calendar(600), sql="""
SELECT d.slot_id, d.zone_id, d.demand, s.slot_start, s.slot_end
FROM demand d JOIN calendar s ON d.slot_id = s.slot_id""")
check("densify_demand", TRIPS, zone_demand(3600), sql=OBSERVED)
check("densify_calendar", *ZONE_HOURLY, sql="SELECT slot_id, zone_id, demand FROM dense")
FLAGGED = f"""SELECT r.slot_id, r.zone_id, {CALENDAR_COLUMNS},
  coalesce(f.is_manhattan, 0) AS is_manhattan, coalesce(f.is_airport, 0) AS is_airport, r.demand"""
check("dense_features", *ZONE_HOURLY, CENTROIDS, FLAGS, sql=f"""
{FLAGGED} FROM dense r LEFT JOIN flags f ON f.zone_id = r.zone_id""")
check("lookup_demand", TRIPS, zone_demand(), sql=f"""
SELECT k.trip_id, k.slot_id, k.zone_id, coalesce(d.demand, 0) AS demand
FROM (SELECT trip_id, {slot('dropoff_ts')} AS slot_id, pickup_zone AS zone_id FROM trips) k
LEFT JOIN demand d ON d.slot_id = k.slot_id AND d.zone_id = k.zone_id""")
check("lookup_features", *ZONE_SPARSE, sql=f"""
SELECT s.year, s.week, s.day_of_week, s.time_of_day_code, s.zone_id, s.slot_id, s.day, s.hour, s.minute,
  s.demand
FROM sparse s WHERE EXISTS (SELECT 1 FROM trips t
  WHERE {slot('t.dropoff_ts')} = s.slot_id AND t.pickup_zone = s.zone_id)""")
check("lookup_features_grid", *CELL_SPARSE, sql=f"""
SELECT f.* FROM ({grid_features('sparse', 'year, ')}) f WHERE EXISTS (SELECT 1 FROM inside t
  WHERE {slot('t.dropoff_ts')} = f.slot_id AND t.dropoff_x = f.cell_x AND t.dropoff_y = f.cell_y)""")
check("distinct_zones", TRIPS, sql="SELECT DISTINCT pickup_zone AS zone_id FROM trips")
check("zone_counts", TRIPS, sql="""
SELECT pickup_zone AS zone_id, count(*) AS cnt FROM trips GROUP BY 1""")

# --- features --------------------------------------------------------------

ALL_ZONES_DENSE = f"""dense AS MATERIALIZED (
  SELECT s.*, z.zone_id, coalesce(d.demand, 0) AS demand, s.slot_start < {TEST_MONDAY} AS before_test
  FROM calendar s CROSS JOIN (SELECT zone_id FROM zones) z
  LEFT JOIN demand d ON d.slot_id = s.slot_id AND d.zone_id = z.zone_id)"""
check("features_cluster", *ZONING, located_demand(3600), calendar(3600),
      "zones AS (SELECT zone_id FROM centroids)", ALL_ZONES_DENSE, FLAGS, sql=f"""
{FLAGGED} FROM dense r LEFT JOIN flags f ON f.zone_id = r.zone_id""")
check("features_grid", TRIPS, cells(5), INSIDE, cell_demand(3600), calendar(3600),
      "zones AS (SELECT CAST(range AS INT) AS zone_id FROM range(25))", ALL_ZONES_DENSE,
      sql=grid_features("dense"))
SPARSE_FLAGGED = (*ZONING, located_demand(600), calendar(600), SPARSE, FLAGS)
check("features_sparse", *SPARSE_FLAGGED, sql=f"""
{FLAGGED}, r.month FROM sparse r LEFT JOIN flags f ON f.zone_id = r.zone_id""")
check("zone_train_test", *ZONE_SPARSE, sql=f"""
SELECT {CALENDAR_COLUMNS}, demand, before_test AS is_train FROM sparse WHERE zone_id = 12""")
VECTOR = ("time_of_day_code", "zone_id", "day_of_week", "day", "week", "hour", "minute",
          "is_manhattan", "is_airport")
check("assemble_features", *SPARSE_FLAGGED, sql=f"""
SELECT slot_id, zone_id, {', '.join(f'CAST({c} AS DOUBLE) AS f{i}' for i, c in enumerate(VECTOR))}
FROM ({FLAGGED} FROM sparse r LEFT JOIN flags f ON f.zone_id = r.zone_id)""")

# --- profiles: every prediction is scored row by row on zero-filled rows ----

DAYS = f"""days AS (
  SELECT day_of_week, count(DISTINCT day) AS days FROM calendar WHERE slot_id < {SPLIT} GROUP BY 1)"""
ZONES = "n_zones AS (SELECT count(DISTINCT zone_id) AS z FROM demand)"
GLOBAL_MEAN = f"""profile AS MATERIALIZED (
  SELECT s.day_of_week, s.hour,
    sum(CASE WHEN s.slot_id < {SPLIT} THEN s.demand ELSE 0 END) / CAST(max(d.days) * 6 * max(z) AS DOUBLE)
      AS prediction
  FROM sparse s JOIN days d ON d.day_of_week = s.day_of_week CROSS JOIN n_zones GROUP BY 1, 2)"""
GLOBAL_SCORED = f"""global_mean AS MATERIALIZED (
  SELECT t.zone_id, t.demand, coalesce(p.prediction, 0) AS prediction
  FROM dense t LEFT JOIN profile p ON p.day_of_week = t.day_of_week AND p.hour = t.hour
  WHERE t.slot_id >= {SPLIT})"""
ZONE_MEAN = f"""zone_profile AS MATERIALIZED (
  SELECT zone_id, day_of_week, hour, avg(demand) AS prediction
  FROM dense WHERE slot_id < {SPLIT} GROUP BY 1, 2, 3)"""
ZONE_SCORED = f"""zone_mean AS MATERIALIZED (
  SELECT t.slot_id, t.zone_id, t.demand, p.prediction
  FROM dense t JOIN zone_profile p ON p.zone_id = t.zone_id AND p.day_of_week = t.day_of_week
    AND p.hour = t.hour WHERE t.slot_id >= {SPLIT})"""
GLOBAL_PARTS = (*ZONE_MODEL, SPARSE, DAYS, ZONES, GLOBAL_MEAN, GLOBAL_SCORED)

check("mean_profile_global", *GLOBAL_PARTS, sql=scores("global_mean"))
check("mean_profile_global_table", *ZONE_SPARSE, DAYS, ZONES, GLOBAL_MEAN, sql="""
SELECT day_of_week, hour, round(prediction, 6) AS prediction FROM profile""")
check("mean_profile_zone", *ZONE_MODEL, ZONE_MEAN, ZONE_SCORED, sql=scores("zone_mean"))
check("report_metrics", *ZONE_MODEL, ZONE_MEAN, ZONE_SCORED, sql=f"""
SELECT 'zone_mean' AS model, *, {SPLIT} AS n_train_slots, CAST((SELECT count(*) FROM calendar) - {SPLIT} AS INT) AS n_test_slots
FROM ({scores('zone_mean')})""")
check("mean_profile_cell", *CELL_MODEL, ZONE_MEAN, ZONE_SCORED, sql=f"""
SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, n, rmse, r2
FROM ({scores('zone_mean')})""")
HOURLY_SPLIT = 21 * 24
check("mean_profile_predict", *ZONE_HOURLY, sql=f"""
SELECT t.slot_id, t.zone_id, t.demand, round(p.prediction, 6) AS prediction
FROM dense t JOIN (SELECT zone_id, day_of_week, hour, avg(demand) AS prediction FROM dense
    WHERE slot_id < {HOURLY_SPLIT} GROUP BY 1, 2, 3) p
  ON p.zone_id = t.zone_id AND p.day_of_week = t.day_of_week AND p.hour = t.hour
WHERE t.slot_id >= {HOURLY_SPLIT}""")
ROW_MEANS = f"""row_means AS MATERIALIZED (
  SELECT zone_id, day_of_week, hour, avg(demand) AS prediction
  FROM sparse WHERE slot_id < {SPLIT} GROUP BY 1, 2, 3)"""
check("mean_rows_zone", *ZONE_SPARSE, ROW_MEANS, f"""scored AS (
  SELECT t.zone_id, t.demand, coalesce(p.prediction, 0) AS prediction
  FROM sparse t LEFT JOIN row_means p ON p.zone_id = t.zone_id AND p.day_of_week = t.day_of_week
    AND p.hour = t.hour WHERE t.slot_id >= {SPLIT})""", sql=scores("scored"))
MEAN_OF_MEANS = """pooled AS MATERIALIZED (
  SELECT c.day_of_week, c.hour, coalesce(sum(r.prediction), 0)
      / (SELECT count(DISTINCT zone_id) FROM row_means) AS prediction
  FROM (SELECT DISTINCT day_of_week, hour FROM sparse) c
  LEFT JOIN row_means r ON r.day_of_week = c.day_of_week AND r.hour = c.hour GROUP BY 1, 2)"""
check("mean_of_means", *ZONE_SPARSE, ROW_MEANS, MEAN_OF_MEANS, sql="""
SELECT day_of_week, hour, round(prediction, 6) AS prediction FROM pooled""")
check("mean_of_means_scored", *ZONE_SPARSE, ROW_MEANS, MEAN_OF_MEANS, f"""scored AS (
  SELECT t.demand, p.prediction FROM sparse t
  JOIN pooled p ON p.day_of_week = t.day_of_week AND p.hour = t.hour
  WHERE t.slot_id >= {SPLIT})""", sql=scores("scored", ()))
check("constant_rmse", TRIPS, zone_demand(), sql="""
SELECT CAST(c AS DOUBLE) AS constant, round(sqrt(avg(pow(c - demand, 2))), 6) AS rmse
FROM demand CROSS JOIN (VALUES (0), (1)) AS v(c) WHERE slot_id % 100 >= 70 GROUP BY c""")

# --- linear models ---------------------------------------------------------


def line(keys: str, feature: str, extra: str = "") -> str:
    return f"""model AS MATERIALIZED (
  SELECT {keys}, count(*) AS n_train, coalesce(regr_slope(demand, {feature}), 0) AS slope,
    coalesce(regr_intercept(demand, {feature}), avg(demand)) AS intercept
  FROM dense WHERE before_test GROUP BY {keys})"""


def line_scored(feature: str) -> str:
    return f"""line AS MATERIALIZED (
  SELECT t.zone_id, t.demand, m.intercept + m.slope * t.{feature} AS prediction
  FROM dense t JOIN model m ON m.zone_id = t.zone_id WHERE NOT t.before_test)"""


check("ols_zone", *ZONE_MODEL, line("zone_id", "time_of_day_code"), sql="""
SELECT zone_id, n_train, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM model""")
LINE = (line("zone_id", "time_of_day_code"), line_scored("time_of_day_code"))
check("ols_zone_scored", *ZONE_MODEL, *LINE, sql=scores("line"))
check("ols_cell", *CELL_HOURLY, *LINE, sql=f"""
SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, n, rmse, r2
FROM ({scores('line')})""")


def two_features(keys: str) -> str:
    """Closed form of least squares on weekday and time of day."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""two AS MATERIALIZED (
  SELECT {lead} n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2 FROM (
    SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1,
      (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2
    FROM (SELECT {lead} count(*) AS n, avg(demand) AS my, avg(day_of_week) AS m1,
        avg(time_of_day_code) AS m2, var_pop(day_of_week) AS c11,
        var_pop(time_of_day_code) AS c22, covar_pop(day_of_week, time_of_day_code) AS c12,
        covar_pop(day_of_week, demand) AS c1y, covar_pop(time_of_day_code, demand) AS c2y
      FROM dense WHERE before_test {group})))"""


check("ols_zone_two", *ZONE_MODEL, two_features("zone_id"), sql="""
SELECT zone_id, n, round(intercept, 6) AS intercept, round(b1, 6) AS b_day_of_week,
  round(b2, 6) AS b_time_of_day_code FROM two""")
check("ols_global_exact", *ZONE_MODEL, two_features(""), f"""scored AS (
  SELECT t.demand, intercept + b1 * t.day_of_week + b2 * t.time_of_day_code AS prediction
  FROM dense t CROSS JOIN two WHERE NOT t.before_test)""", sql=scores("scored", ()))


def solved(keys: list[str], features: list[str]) -> list[str]:
    """Normal equations solved by elimination, one statement per pivot.

    Columns ``a_i_j`` hold row ``i`` of the system; column ``p`` is the right
    hand side. Features are centred per group, so no pivot is tiny.
    """
    p = len(features)
    lead = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    means = ", ".join(f"avg({f}) AS m_{i}" for i, f in enumerate([*features, "demand"]))
    columns = [*features, "demand"]
    first = ", ".join(
        f"covar_pop({columns[j]}, {columns[i]}) AS a_{i}_{j}" for i in range(p) for j in range(p + 1)
    )
    parts = [f"""step_0 AS MATERIALIZED (
  SELECT {lead} {means}, {first} FROM dense WHERE before_test {group})"""]
    kept = lead + ", ".join(f"m_{i}" for i in range(p + 1))
    for pivot in range(p):
        entries = []
        for i in range(p):
            for j in range(p + 1):
                value = f"a_{pivot}_{j} / a_{pivot}_{pivot}"
                if i != pivot:
                    value = f"a_{i}_{j} - a_{i}_{pivot} * a_{pivot}_{j} / a_{pivot}_{pivot}"
                entries.append(f"{value} AS a_{i}_{j}")
        parts.append(f"""step_{pivot + 1} AS MATERIALIZED (
  SELECT {kept}, {', '.join(entries)} FROM step_{pivot})""")
    terms = "".join(f" + m.a_{i}_{p} * (t.{f} - m.m_{i})" for i, f in enumerate(features))
    on = " AND ".join(f"t.{k} = m.{k}" for k in keys) or "true"
    parts.append(f"""fitted AS MATERIALIZED (
  SELECT t.zone_id, t.demand, m.m_{p}{terms} AS prediction
  FROM dense t JOIN step_{p} m ON {on} WHERE NOT t.before_test)""")
    return parts


# a basis of the six calendar features, which are collinear (hour and minute
# make up the time of day, week and weekday the day of this month)
BASIS = ["time_of_day_code", "hour", "day_of_week", "week"]
check("ols_zone_multi", *ZONE_MODEL, *solved(["zone_id"], BASIS), sql=scores("fitted"))
# on hourly slots the time of day is the hour
check("ols_cell_multi", *CELL_HOURLY, *solved(["zone_id"], ["hour", "day_of_week", "week"]), sql=f"""
SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, n, rmse, r2
FROM ({scores('fitted')})""")
GLOBAL_ROWS = (
    *ZONING, located_demand(3600), calendar(3600), "zones AS (SELECT zone_id FROM centroids)",
    ALL_ZONES_DENSE.replace("dense AS", "unflagged AS", 1), FLAGS,
    f"dense AS MATERIALIZED ({FLAGGED}, r.before_test FROM unflagged r LEFT JOIN flags f ON f.zone_id = r.zone_id)",
)
check("ols_global_zones", *GLOBAL_ROWS,
      *solved([], ["hour", "zone_id", "day_of_week", "week", "is_manhattan", "is_airport"]),
      sql=scores("fitted"))

# --- trees -----------------------------------------------------------------


def tree_levels(keys: list[str], features: list[str], depth: int) -> list[str]:
    """Exact regression trees, one statement per level."""
    lead = "".join(f"{k}, " for k in keys)
    same = " AND ".join([*(f"r.{k} = b.{k}" for k in keys), "r.node_id = b.node_id"])
    pairs = ", ".join(f"{{'f': '{f}', 'v': CAST({f} AS DOUBLE)}}" for f in features)
    value = "CASE b.feature " + " ".join(f"WHEN '{f}' THEN r.{f}" for f in features) + " END"
    parts = [f"rows_0 AS MATERIALIZED (SELECT *, 1 AS node_id FROM dense WHERE before_test)"]
    for level in range(depth):
        parts.append(f"""hist_{level} AS MATERIALIZED (
  SELECT {lead} node_id, p.f AS feature, p.v AS value, count(*) AS c,
    CAST(sum(demand) AS DOUBLE) AS s, CAST(sum(demand * demand) AS DOUBLE) AS s2
  FROM rows_{level}, unnest([{pairs}]) AS u(p) GROUP BY ALL)""")
        parts.append(f"""cuts_{level} AS MATERIALIZED (
  SELECT *, round(gain / nullif((total2 - total * total / n) / n, 0), 9) AS share
  FROM (SELECT *, (sl * sl / nl + (total - sl) * (total - sl) / nullif(n - nl, 0)
      - total * total / n) / n AS gain
  FROM (SELECT {lead} node_id, feature, value,
      CAST(sum(c) OVER w AS BIGINT) AS n, sum(s) OVER w AS total, sum(s2) OVER w AS total2,
      CAST(sum(c) OVER o AS BIGINT) AS nl, sum(s) OVER o AS sl
    FROM hist_{level}
    WINDOW w AS (PARTITION BY {lead} node_id, feature),
      o AS (PARTITION BY {lead} node_id, feature ORDER BY value))))""")
        parts.append(f"""best_{level} AS MATERIALIZED (
  SELECT {lead} node_id, {level} AS depth, n, total,
    CASE WHEN share > 0 THEN feature END AS feature,
    CASE WHEN share > 0 THEN value END AS threshold, CASE WHEN share > 0 THEN gain END AS gain, nl, sl
  FROM (SELECT *, row_number() OVER (PARTITION BY {lead} node_id
      ORDER BY CASE WHEN share > 0 THEN share ELSE 0 END DESC, feature, value) AS rn
    FROM cuts_{level}) WHERE rn = 1)""")
        parts.append(f"""rows_{level + 1} AS MATERIALIZED (
  SELECT r.* REPLACE (r.node_id * 2 + CASE WHEN {value} > b.threshold THEN 1 ELSE 0 END AS node_id)
  FROM rows_{level} r JOIN best_{level} b ON {same} WHERE b.feature IS NOT NULL)""")
    inner = " UNION ALL ".join(
        f"SELECT {lead} node_id, depth, feature, threshold, n, total FROM best_{i}"
        for i in range(depth)
    )
    parts.append(f"""nodes AS MATERIALIZED (
  SELECT {lead} node_id, depth, feature, threshold, n, total / n AS prediction
  FROM ({inner})
  UNION ALL
  SELECT {lead} node_id, {depth}, NULL, NULL, count(*),
    CAST(sum(demand) AS DOUBLE) / count(*)
  FROM rows_{depth} GROUP BY {lead} node_id)""")
    return parts


def tree_scored(keys: list[str], features: list[str], depth: int) -> str:
    """Test rows sent down the tree, one step per level."""
    lead = " AND ".join(f"t.{k} = n.{k}" for k in keys) or "true"
    value = "CASE n.feature " + " ".join(f"WHEN '{f}' THEN t.{f}" for f in features) + " END"
    source = f"(SELECT *, 1 AS node_id FROM dense WHERE NOT before_test)"
    for level in range(depth):
        source = f"""(SELECT t.* REPLACE (CASE WHEN n.feature IS NULL THEN t.node_id
      ELSE t.node_id * 2 + CASE WHEN {value} > n.threshold THEN 1 ELSE 0 END END AS node_id)
    FROM {source} t LEFT JOIN nodes n ON {lead} AND t.node_id = n.node_id AND n.depth = {level})"""
    return f"""tree AS MATERIALIZED (
  SELECT t.zone_id, t.demand, n.prediction FROM {source} t
  JOIN nodes n ON {lead} AND t.node_id = n.node_id)"""


CALENDAR_FEATURES = ["day", "day_of_week", "hour", "minute", "time_of_day_code", "week"]
NODE_COLUMNS = "node_id, depth, feature, threshold, n, round(prediction, 6) AS prediction"
TREE = tree_levels(["zone_id"], CALENDAR_FEATURES, 3)
TREE_SCORED = tree_scored(["zone_id"], CALENDAR_FEATURES, 3)
check("tree_split_zone", *ZONE_MODEL, *TREE, sql="""
SELECT zone_id, n, feature, threshold, round(gain, 6) AS gain FROM best_0""")
check("tree_zone_depth3", *ZONE_MODEL, *TREE, sql=f"SELECT zone_id, {NODE_COLUMNS} FROM nodes")
check("tree_zone_scored", *ZONE_MODEL, *TREE, TREE_SCORED, sql=scores("tree"))
# cell position and flags are constant within a cell and can never split it
check("tree_cell_scored", *CELL_HOURLY, *TREE, TREE_SCORED, sql=f"""
SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, n, rmse, r2
FROM ({scores('tree')})""")
check("tree_all_zones", *ZONE_MODEL,
      *tree_levels([], sorted([*CALENDAR_FEATURES, "zone_id"]), 3),
      sql=f"SELECT {NODE_COLUMNS} FROM nodes")
SWEEP = [2, 3, 4, 5, 6, 7, 8, 10]
check("tree_depth_sweep", *ZONE_HOURLY, *tree_levels(["zone_id"], CALENDAR_FEATURES, max(SWEEP)),
      *[tree_scored(["zone_id"], CALENDAR_FEATURES, depth).replace(
          "tree AS MATERIALIZED", f"tree_{depth} AS MATERIALIZED") for depth in SWEEP],
      sql="\nUNION ALL\n".join(
          f"SELECT {depth} AS max_depth, * FROM ({scores(f'tree_{depth}')})" for depth in SWEEP))

# --- evaluation, comparison, distribution ----------------------------------


def zscore(column: str) -> str:
    window = "OVER (PARTITION BY zone_id)"
    return (
        f"round(coalesce(({column} - avg({column}) {window})"
        f" / nullif(stddev_pop({column}) {window}, 0), 0), 6) AS {column}_z"
    )


check("zscore_zone", *ZONE_HOURLY, sql=f"""
SELECT slot_id, zone_id, {zscore('time_of_day_code')}, {zscore('day_of_week')}, {zscore('demand')}
FROM dense""")
HOUR_LINE = (*ZONE_MODEL, line("zone_id", "hour"), line_scored("hour"))
check("eval_rmse", *HOUR_LINE, sql=f"""
SELECT zone_id, n, rmse FROM ({scores('line', pooled=False)})""")
check("eval_r2", *HOUR_LINE, sql=f"""
SELECT zone_id, n, r2 FROM ({scores('line', pooled=False)})""")
check("eval_rollup", *HOUR_LINE, sql=scores("line"))
DESCRIBE = """count(demand) AS cnt, round(avg(demand), 6) AS mean,
  round(stddev_samp(demand), 6) AS stddev, min(demand) AS min, max(demand) AS max FROM dense"""
check("describe_zone", *ZONE_MODEL, sql=f"SELECT zone_id, {DESCRIBE} GROUP BY zone_id")
check("describe_all", *ZONE_MODEL, sql=f"SELECT {DESCRIBE}")

MODELS = ["tree", "line", "zone_mean", "global_mean"]
METRICS = (
    *ZONE_MODEL, SPARSE, DAYS, ZONES, GLOBAL_MEAN, GLOBAL_SCORED, ZONE_MEAN, ZONE_SCORED, *LINE,
    *TREE, TREE_SCORED,
    "metrics AS MATERIALIZED (" + "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, {i} AS rank, * FROM ({scores(m, pooled=False, digits=None)})"
        for i, m in enumerate(MODELS)
    ) + ")",
)
check("metric_summary", *METRICS, sql="""
SELECT model, count(*) AS zones, round(avg(rmse), 6) AS rmse_mean,
  round(stddev_pop(rmse), 6) AS rmse_std, round(avg(r2), 6) AS r2_mean,
  round(stddev_pop(r2), 6) AS r2_std FROM metrics GROUP BY 1""")
PAIRS = """pairs AS (
  SELECT a.model AS model_a, b.model AS model_b, a.r2 AS ra, b.r2 AS rb
  FROM metrics a JOIN metrics b ON a.zone_id = b.zone_id AND a.rank < b.rank)"""
check("compare_pair", *METRICS, PAIRS, sql="""
SELECT model_a, model_b,
  round(avg(CASE WHEN ra > rb THEN 1.0 WHEN ra = rb THEN 0.5 ELSE 0.0 END)
    FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL), 6) AS a_share,
  round(avg(CASE WHEN rb > ra THEN 1.0 WHEN ra = rb THEN 0.5 ELSE 0.0 END)
    FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL), 6) AS b_share,
  count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS zones,
  count(*) FILTER (WHERE ra IS NULL OR rb IS NULL) AS left_out
FROM pairs GROUP BY 1, 2""")
check("compare_all", *METRICS, sql="""
SELECT m.model, count(w.zone_id) AS wins, round(count(w.zone_id) / CAST(max(t.zones) AS DOUBLE), 6) AS share
FROM (SELECT DISTINCT model FROM metrics) m
CROSS JOIN (SELECT count(DISTINCT zone_id) AS zones FROM metrics WHERE r2 IS NOT NULL) t
LEFT JOIN (SELECT model, zone_id FROM (SELECT *, row_number() OVER (PARTITION BY zone_id
    ORDER BY r2 DESC, rank) AS rn FROM metrics WHERE r2 IS NOT NULL) WHERE rn = 1) w
  ON w.model = m.model GROUP BY m.model""")
check("compare_margin", *METRICS, PAIRS, sql="""
SELECT model_a, model_b, round(sum(greatest(ra, -1) - greatest(rb, -1)), 6) AS margin_sum,
  round(avg(greatest(ra, -1) - greatest(rb, -1)), 6) AS margin_mean, count(*) AS zones
FROM pairs WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1, 2""")

DAILY = (TRIPS, zone_demand(86400))
check("demand_hist", *DAILY, """edges AS (
  SELECT CAST(min(demand) AS DOUBLE) AS low, (max(demand) - min(demand)) / CAST(20 AS DOUBLE) AS width,
    count(*) AS n FROM demand)""", sql="""
SELECT CAST(b.range AS INT) AS bin, round(low + width * b.range, 6) AS bin_start,
  count(d.demand) AS cnt, round(count(d.demand) / (max(n) * max(width)), 6) AS density
FROM range(20) b CROSS JOIN edges
LEFT JOIN demand d ON d.demand >= low + width * b.range
  AND (d.demand < low + width * (b.range + 1) OR b.range = 19)
GROUP BY b.range, low, width""")
check("fit_exponential", *DAILY, sql="""
SELECT x, round(m, 6) AS mean, round(exp(-x / m) / m, 6) AS density
FROM (SELECT avg(demand) AS m, max(demand) AS largest FROM demand),
  unnest(generate_series(0, largest)) AS u(x)""")
check("fit_pareto", *DAILY, sql="""
SELECT x, round(xm, 6) AS xm, round(alpha, 6) AS alpha,
  round(CASE WHEN x >= xm THEN alpha * pow(xm, alpha) / pow(x, alpha + 1) ELSE 0 END, 6) AS density
FROM (SELECT max(xm) AS xm, count(*) / sum(ln(demand) - ln(xm)) AS alpha, max(demand) AS largest
      FROM demand, (SELECT CAST(min(demand) AS DOUBLE) AS xm FROM demand)),
  unnest(generate_series(0, largest)) AS u(x)""")

# --- one model for all, scored apart ----------------------------------------

check("ols_zone_layout", *GLOBAL_ROWS, *solved(["zone_id"], ["hour", "day_of_week", "week"]),
      sql=scores("fitted"))
ALL_CELLS = (
    *CELL_HOURLY[:-1], DENSE.replace("dense AS", "unplaced AS"),
    f"""dense AS MATERIALIZED (
  SELECT *, CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y,
    {flags(corner('(zone_id // 5)', -74.15, -73.72, 5), corner('(zone_id % 5)', 40.58, 40.85, 5))}
  FROM unplaced)""",
)
PER_CELL = "SELECT CAST(zone_id // 5 AS INT) AS cell_x, CAST(zone_id % 5 AS INT) AS cell_y, n, rmse, r2 FROM ({})"
# no corner of these cells lies at the airport
check("ols_global_cells", *ALL_CELLS,
      *solved([], ["hour", "day_of_week", "week", "cell_x", "cell_y", "is_manhattan"]),
      sql=PER_CELL.format(scores("fitted")))
CELL_FEATURES = sorted([*CALENDAR_FEATURES, "cell_x", "cell_y", "is_airport", "is_manhattan"])
check("tree_global_cells", *ALL_CELLS, *tree_levels([], CELL_FEATURES, 3), tree_scored([], CELL_FEATURES, 3),
      sql=PER_CELL.format(scores("tree")))
GLOBAL_FEATURES = sorted([*CALENDAR_FEATURES, "zone_id", "is_airport", "is_manhattan"])
check("tree_global_zones", *GLOBAL_ROWS, *tree_levels([], GLOBAL_FEATURES, 5), tree_scored([], GLOBAL_FEATURES, 5),
      sql=scores("tree"))

# --- what must hold for random and iterative operators -----------------------

check("bernoulli_facts", TRIPS, sql="""
SELECT pickup_zone AS zone_id, count(*) AS n, true AS once, true AS fair FROM trips GROUP BY 1""")
check("split_random_facts", TRIPS, zone_demand(), sql="SELECT *, 1 AS parts, true AS fair FROM demand")
check("kmeans_facts", sql="""
SELECT CAST(range AS INT) AS zone_id, true AS is_mean, (SELECT count(*) FROM events) AS n_points FROM range(8)""")
check("zoning_clusters_facts", TRIPS, sql=f"""
SELECT {slot('pickup_ts', 3600)} AS slot_id, 20 AS n, 20 AS zones, count(*) AS demand FROM trips GROUP BY 1""")
TESTED = """
SELECT zone_id, count(*) AS n, true AS better{more} FROM {rows} GROUP BY 1
UNION ALL SELECT NULL, count(*), true{more} FROM {rows}"""
check("tree_global_facts", *GLOBAL_ROWS, sql=TESTED.format(
    rows=f"(SELECT zone_id FROM dense WHERE NOT before_test)", more=", true AS leaf_means"))
check("tree_default_facts", TRIPS, zone_demand(), sql=TESTED.format(rows="demand", more=", true AS leaf_means"))
check("forest_facts", TRIPS, zone_demand(), sql=TESTED.format(rows="demand", more=""))
check("mlp_cell_facts", *CELL_HOURLY, sql=f"""
SELECT zone_id, count(*) FILTER (WHERE before_test) AS n_train,
  count(*) FILTER (WHERE NOT before_test) AS n_test, true AS finite
FROM dense GROUP BY 1 HAVING n_train >= 5 AND n_test >= 3""")
check("mlp_leading_facts", TRIPS, zone_demand(), sql="""
SELECT zone_id, n - held AS n_train, held AS n_test, true AS finite
FROM (SELECT zone_id, count(*) AS n, CAST(floor(count(*) * 0.1667) AS BIGINT) AS held FROM demand GROUP BY 1)
WHERE n - held >= 5 AND held >= 3""")
REPORTED = f"{SPLIT} AS n_train_slots, CAST((SELECT count(*) FROM calendar) - {SPLIT} AS INT) AS n_test_slots"
check("predictors_by_name", *ZONE_MODEL, *TREE, TREE_SCORED, *solved(["zone_id"], BASIS), sql=f"""
SELECT 'decision_tree' AS model, *, {REPORTED} FROM ({scores('tree')})
UNION ALL SELECT 'linear_regression', *, {REPORTED} FROM ({scores('fitted')})""")
check("sql_over_views", TRIPS, sql="""
SELECT strftime(pickup_ts, '%Y-%m-%d') AS day, count(*) AS n, max(dropoff_ts) AS last FROM trips GROUP BY 1""")
check("demand_kept_on_disk", TRIPS, zone_demand(), sql="""
SELECT *, CAST(sum(demand) OVER (PARTITION BY zone_id) AS BIGINT) AS total FROM demand""")

# --- choices by hashed keys: the same rows in every engine -----------------------


def toss(seed: int, *key: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5({parts} || ':{seed}'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


check("bernoulli_sample", TRIPS, sql=f"SELECT * FROM trips WHERE {toss(11, 'trip_id')} < {dbl(0.25)}")
check("split_random", TRIPS, zone_demand(), sql=f"""
SELECT *, {toss(5, 'slot_id', 'zone_id')} < {dbl(0.7)} AS is_train FROM demand""")


def kmeans(points: str, k: str, seed: int, steps: int) -> list[str]:
    """Every step of k-means by all pairs of places and centroids."""
    parts = [f"""places AS MATERIALIZED (
  SELECT pickup_lon AS lon, pickup_lat AS lat, count(*) AS n FROM {points} GROUP BY 1, 2)""", f"""centroids_0 AS MATERIALIZED (
  SELECT CAST(rn - 1 AS INT) AS zone_id, lon, lat
  FROM (SELECT *, row_number() OVER (ORDER BY {toss(seed, 'lon', 'lat')}, lon, lat) AS rn FROM places) WHERE rn <= {k})"""]
    for i in range(steps):
        parts.append(f"""centroids_{i + 1} AS MATERIALIZED (
  SELECT c.zone_id, coalesce(m.lon, c.lon) AS lon, coalesce(m.lat, c.lat) AS lat FROM centroids_{i} c
  LEFT JOIN (SELECT zone_id, round(sum(lon * n) / sum(n), 9) AS lon, round(sum(lat * n) / sum(n), 9) AS lat FROM (
      SELECT p.*, c.zone_id, row_number() OVER (PARTITION BY p.lon, p.lat ORDER BY
        (c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat), c.zone_id) AS rn
      FROM places p CROSS JOIN centroids_{i} c) WHERE rn = 1 GROUP BY 1) m ON m.zone_id = c.zone_id)""")
    return parts


SAMPLED = f"sampled AS MATERIALIZED (SELECT * FROM trips WHERE {toss(7, 'trip_id')} < {dbl(0.5)})"
check("kmeans_train", TRIPS, SAMPLED, *kmeans("sampled", "(SELECT greatest(count(*) // 50, 1) FROM sampled)", 7, 4), sql="""
SELECT zone_id, lon AS centroid_lon, lat AS centroid_lat FROM centroids_4""")
check("centroid_table", TRIPS, *kmeans("trips", "8", 3, 4), sql="""
SELECT zone_id, round(lon, 3) AS centroid_lon, round(lat, 3) AS centroid_lat FROM centroids_4""")
check("zoning_clusters", TRIPS, SAMPLED, *kmeans("sampled", "20", 7, 4),
      "centroids AS (SELECT zone_id, lon AS centroid_lon, lat AS centroid_lat FROM centroids_4)", nearest("pickup"), """located AS (
  SELECT t.pickup_ts, p.pickup_zone FROM (SELECT trip_id, pickup_ts FROM trips) t JOIN pickups p USING (trip_id))""",
      located_demand(3600), sql=OBSERVED)
