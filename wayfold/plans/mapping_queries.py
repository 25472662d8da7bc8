"""Queries over contracts and mappings, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import contracts as ct
from wayfold.operators import mapping as mp
from wayfold.plans.ingest_queries import raw
from wayfold.sources.fixtures import TEL, telemetry


def _cents(x: Column) -> Column:
    """A non-negative number with two decimals, as JSON text."""
    n = F.round(x * 100).cast("long")
    return F.concat((n / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def payloads(s: SparkSession, d: str) -> DataFrame:
    """A vendor payload of each event: some with defects, some with literal dotted keys, some of vendor B without "state".

    The events are few bytes in few row groups, but each payload takes long to make and read: they are dealt out before.
    """
    t = telemetry(s, d).repartition("event_id")
    time = F.when(F.col("event_id") % 59 == 0, "soon").otherwise(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    speed = F.when(F.col("event_id") % 43 == 0, '"fast"').otherwise(_cents(F.when(F.col("event_id") % 47 == 0, F.col("speed_kmh") + 400).otherwise(F.col("speed_kmh"))))
    lat = F.when(F.col("event_id") % 53 == 0, "195").otherwise(F.concat(F.lit("51."), F.lpad((5000 + F.col("k") * 2).cast("string"), 4, "0")))
    lon = F.concat(F.lit("-0."), F.lpad((1200 - F.col("event_id") % 100).cast("string"), 4, "0"))
    soc = (100 - F.col("k")).cast("string")
    share = F.concat(F.lit("0."), F.lpad((100 - F.col("k") - F.when(F.col("k") == 0, 1).otherwise(0)).cast("string"), 2, "0"))
    flag = lambda c: F.when(c, "true").otherwise("false")
    stamp = F.when(F.col("event_id") % 41 == 0, F.lit("")).otherwise(F.concat(F.lit(',"timestamp":"'), time, F.lit('"')))
    running = F.when(F.col("event_type") == "error", "stopped").when(F.col("event_type") == "signup", "towed").otherwise("running")
    more = F.concat(F.lit(',"altitude":'), F.when(F.col("event_id") % 37 == 0, 9500).otherwise(F.col("k") * 20).cast("string"), F.lit(',"heading":'), F.when(F.col("event_id") % 61 == 0, 365).otherwise(F.col("event_id") % 360).cast("string"))
    fault = lambda name: F.coalesce(F.concat(F.lit(f',"{name}":"'), "fault_code", F.lit('"')), F.lit(""))
    a1 = F.concat(F.lit('{"speed_mph":'), speed, F.lit(',"charge_fraction":'), share, F.lit(',"lat":'), lat, F.lit(',"lon":'), lon, F.lit(',"odo_miles":'), F.col("k").cast("string"), F.lit(',"harsh_brake":'), flag(F.col("harsh_brake")), F.lit(',"status":"'), running, F.lit('"'), more, fault("fault_code"), stamp, F.lit("}"))
    meta = F.concat(F.lit(',"metadata":{"timestamp":"'), time, F.lit('","odo_miles":'), F.col("k").cast("string"), F.lit(',"status":"'), running, F.lit('"'), fault("fault_code"), F.lit("}}"))
    a2 = F.concat(F.lit('{"data":{"speed_mph":'), speed, F.lit(',"charge_fraction":'), share, F.lit(',"lat":'), lat, F.lit(',"lon":'), lon, F.lit("}"), meta)
    dotted = F.concat(F.lit('{"data.speed_mph":'), speed, F.lit(',"data.charge_fraction":'), share, F.lit(',"data.lat":'), lat, F.lit(',"data.lon":'), lon, F.lit(',"data":{"speed_mph":1}'), meta)
    state = F.concat(F.lit('"velocity_kmh":'), speed, F.lit(',"battery_pct":'), soc, F.lit(',"gps_lat":'), lat, F.lit(',"gps_lon":'), lon, F.lit(',"ignition":'), flag(F.col("ignition") == "ON"), F.lit(',"distance_km":'), F.col("k").cast("string"), F.lit(',"gps_heading":'), (F.col("event_id") % 360).cast("string"), F.lit(',"harsh_braking":'), flag(F.col("harsh_brake")), F.lit(',"charging":'), flag(F.col("charging")), fault("fault"))
    wrapped = F.when(F.col("event_id") % 31 == 0, F.concat(F.lit("{"), state)).otherwise(F.concat(F.lit('{"state":{'), state, F.lit("}")))
    b1 = F.concat(wrapped, F.lit(',"time_measured":'), F.expr("cast(t_us div 1000 as string)"), F.lit("}"))
    odometer = F.when(F.col("event_id") % 67 == 0, -5).otherwise(F.col("k")).cast("string")
    c1 = F.concat(F.lit('{"vehicle_id":"'), F.col("vehicle_id").cast("string"), F.lit('","speed":'), speed, F.lit(',"soc":'), soc, F.lit(',"lat":'), lat, F.lit(',"lon":'), lon, F.lit(',"odometer":'), odometer, F.lit(',"status":"'), F.when(F.col("event_type") == "error", "PARKED").when(F.col("event_type") == "signup", "IDLE").otherwise("MOVING"), F.lit('"'), stamp, F.lit("}"))
    body = F.when((F.col("vendor") == "A") & (F.col("k") % 2 == 0), a1).when((F.col("vendor") == "A") & (F.col("event_id") % 29 == 0), dotted).when(F.col("vendor") == "A", a2).when(F.col("vendor") == "B", b1).otherwise(c1)
    return ct.once(t, ["event_id", "vehicle_id", "fleet_id", "connection_id", "vendor", "t_us", "k"], {"payload": body})


_C = "((round({0} * 100)::BIGINT // 100) || '.' || lpad((round({0} * 100)::BIGINT % 100)::VARCHAR, 2, '0'))"
PAY = f"""{TEL}, q AS (SELECT *, CASE WHEN event_id % 59 = 0 THEN 'soon' ELSE strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') END AS tm,
    CASE WHEN event_id % 43 = 0 THEN '"fast"' WHEN event_id % 47 = 0 THEN {_C.format('(speed_kmh + 400)')} ELSE {_C.format('speed_kmh')} END AS sp,
    CASE WHEN event_id % 53 = 0 THEN '195' ELSE '51.' || lpad((5000 + k * 2)::VARCHAR, 4, '0') END AS la, '-0.' || lpad((1200 - event_id % 100)::VARCHAR, 4, '0') AS lo, (100 - k)::VARCHAR AS so,
    '0.' || lpad((100 - k - CASE WHEN k = 0 THEN 1 ELSE 0 END)::VARCHAR, 2, '0') AS fr FROM tel),
q2 AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN '' ELSE ',"timestamp":"' || tm || '"' END AS stamp, CASE event_type WHEN 'error' THEN 'stopped' WHEN 'signup' THEN 'towed' ELSE 'running' END AS run,
    coalesce(',"fault_code":"' || fault_code || '"', '') AS fc FROM q),
q3 AS (SELECT *, '{{"speed_mph":' || sp || ',"charge_fraction":' || fr || ',"lat":' || la || ',"lon":' || lo AS place, ',"metadata":{{"timestamp":"' || tm || '","odo_miles":' || k || ',"status":"' || run || '"' || fc || '}}}}' AS meta,
    '"velocity_kmh":' || sp || ',"battery_pct":' || so || ',"gps_lat":' || la || ',"gps_lon":' || lo || ',"ignition":' || CASE WHEN ignition = 'ON' THEN 'true' ELSE 'false' END || ',"distance_km":' || k || ',"gps_heading":' || (event_id % 360)
        || ',"harsh_braking":' || harsh_brake::VARCHAR || ',"charging":' || charging::VARCHAR || coalesce(',"fault":"' || fault_code || '"', '') AS state FROM q2),
pay AS MATERIALIZED (SELECT event_id, vehicle_id, fleet_id, connection_id, vendor, t_us, k, CASE WHEN vendor = 'A' AND k % 2 = 0 THEN
      place || ',"odo_miles":' || k || ',"harsh_brake":' || harsh_brake::VARCHAR || ',"status":"' || run || '","altitude":' || CASE WHEN event_id % 37 = 0 THEN 9500 ELSE k * 20 END || ',"heading":' || CASE WHEN event_id % 61 = 0 THEN 365 ELSE event_id % 360 END || fc || stamp || '}}'
    WHEN vendor = 'A' AND event_id % 29 = 0 THEN '{{"data.speed_mph":' || sp || ',"data.charge_fraction":' || fr || ',"data.lat":' || la || ',"data.lon":' || lo || ',"data":{{"speed_mph":1}}' || meta
    WHEN vendor = 'A' THEN '{{"data":' || place || '}}' || meta
    WHEN vendor = 'B' THEN CASE WHEN event_id % 31 = 0 THEN '{{' || state ELSE '{{"state":{{' || state || '}}' END || ',"time_measured":' || (t_us // 1000) || '}}'
    ELSE '{{"vehicle_id":"' || vehicle_id || '","speed":' || sp || ',"soc":' || so || ',"lat":' || la || ',"lon":' || lo || ',"odometer":' || CASE WHEN event_id % 67 = 0 THEN -5 ELSE k END || ',"status":"' || CASE event_type WHEN 'error' THEN 'PARKED' WHEN 'signup' THEN 'IDLE' ELSE 'MOVING' END || '"' || stamp || '}}' END AS payload FROM q3)"""


def _at(path: str) -> str:
    """The value at a path: the literal key first."""
    walked = f"json_extract(payload, '{ct.json_path(path)}')"
    return f"CASE WHEN json_exists(payload, '$.\"{path}\"') THEN json_extract(payload, '$.\"{path}\"') ELSE {walked} END" if "." in path else walked


def _type(path: str) -> str:
    return f"(CASE json_type({_at(path)}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'other' WHEN 'ARRAY' THEN 'other' WHEN 'NULL' THEN NULL ELSE CASE WHEN json_type({_at(path)}) IS NOT NULL THEN 'number' END END)"


def _text(path: str) -> str:
    return f"(({_at(path)}) ->> '$')"


#: The contracts as SQL rows, typed out: vendor, version, position, path, type, required, time, place, lower and upper bound.
CONTRACT_ROWS = """('A', '2', 0, 'data.speed_mph', 'number', true, false, false, 0, 250), ('A', '2', 1, 'data.charge_fraction', 'number', true, false, false, 0, 1), ('A', '2', 2, 'data.lat', 'number', true, false, true, -90, 90),
    ('A', '2', 3, 'data.lon', 'number', true, false, true, -180, 180), ('A', '2', 4, 'metadata.timestamp', 'string', true, true, false, NULL, NULL), ('A', '2', 5, 'metadata.odo_miles', 'number', false, false, false, 0, NULL),
    ('A', '2', 6, 'metadata.status', 'string', false, false, false, NULL, NULL), ('A', '2', 7, 'metadata.fault_code', 'string', false, false, false, NULL, NULL),
    ('A', '1', 0, 'speed_mph', 'number', true, false, false, 0, 250), ('A', '1', 1, 'charge_fraction', 'number', true, false, false, 0, 1), ('A', '1', 2, 'timestamp', 'string', true, true, false, NULL, NULL),
    ('A', '1', 3, 'lat', 'number', false, false, true, -90, 90), ('A', '1', 4, 'lon', 'number', false, false, true, -180, 180), ('A', '1', 5, 'odo_miles', 'number', false, false, false, 0, NULL), ('A', '1', 6, 'status', 'string', false, false, false, NULL, NULL),
    ('A', '1', 7, 'altitude', 'number', false, false, false, NULL, NULL), ('A', '1', 8, 'heading', 'number', false, false, false, NULL, NULL), ('A', '1', 9, 'harsh_brake', 'boolean', false, false, false, NULL, NULL), ('A', '1', 10, 'fault_code', 'string', false, false, false, NULL, NULL),
    ('B', '1', 0, 'state.velocity_kmh', 'number', true, false, false, 0, 350), ('B', '1', 1, 'state.battery_pct', 'number', true, false, false, 0, 100), ('B', '1', 2, 'state.gps_lat', 'number', true, false, true, -90, 90),
    ('B', '1', 3, 'state.gps_lon', 'number', true, false, true, -180, 180), ('B', '1', 4, 'time_measured', 'number', true, true, false, NULL, NULL), ('B', '1', 5, 'state.distance_km', 'number', false, false, false, NULL, NULL),
    ('B', '1', 6, 'state.ignition', 'boolean', false, false, false, NULL, NULL), ('B', '1', 7, 'state.gps_heading', 'number', false, false, false, NULL, NULL), ('B', '1', 8, 'state.harsh_braking', 'boolean', false, false, false, NULL, NULL),
    ('B', '1', 9, 'state.charging', 'boolean', false, false, false, NULL, NULL), ('B', '1', 10, 'state.fault', 'string', false, false, false, NULL, NULL),
    ('C', '1', 0, 'vehicle_id', 'string', true, false, false, NULL, NULL), ('C', '1', 1, 'timestamp', 'string', true, true, false, NULL, NULL), ('C', '1', 2, 'speed', 'number', true, false, false, 0, 300), ('C', '1', 3, 'soc', 'number', true, false, false, 0, 100),
    ('C', '1', 4, 'odometer', 'number', false, false, false, 0, NULL), ('C', '1', 5, 'lat', 'number', false, false, true, -90, 90), ('C', '1', 6, 'lon', 'number', false, false, true, -180, 180), ('C', '1', 7, 'status', 'string', false, false, false, NULL, NULL)"""
#: The rules, typed out: vendor, version, position, path, signal, factor of numbers, codes of texts, range.
RULE_ROWS = """('A', '1', 0, 'speed_mph', 'vehicle_speed', 1.60934, NULL, 0, 300), ('A', '1', 1, 'charge_fraction', 'battery_soc', 100, NULL, 0, 100), ('A', '1', 2, 'odo_miles', 'odometer', 1.60934, NULL, 0, 2000000),
    ('A', '1', 3, 'status', 'ignition_status', NULL, '{"running":"ON","stopped":"OFF"}', NULL, NULL), ('A', '1', 4, 'lat', 'latitude', 1, NULL, -90, 90), ('A', '1', 5, 'lon', 'longitude', 1, NULL, -180, 180), ('A', '1', 6, 'altitude', 'altitude', 1, NULL, -500, 9000),
    ('A', '1', 7, 'heading', 'heading', 1, NULL, 0, 360), ('A', '1', 8, 'harsh_brake', 'harsh_brake', NULL, '{"true":"YES","false":"NO"}', NULL, NULL), ('A', '1', 9, 'fault_code', 'fault_code', NULL, NULL, NULL, NULL), ('A', '1', 10, 'timestamp', 'event_time', NULL, NULL, NULL, NULL),
    ('B', '1', 0, 'state.velocity_kmh', 'vehicle_speed', 1, NULL, 0, 300), ('B', '1', 1, 'state.battery_pct', 'battery_soc', 1, NULL, 0, 100), ('B', '1', 2, 'state.distance_km', 'odometer', 1, NULL, 0, 2000000), ('B', '1', 3, 'state.ignition', 'ignition_status', NULL, '{"true":"ON","false":"OFF"}', NULL, NULL),
    ('B', '1', 4, 'state.gps_lat', 'latitude', 1, NULL, -90, 90), ('B', '1', 5, 'state.gps_lon', 'longitude', 1, NULL, -180, 180), ('B', '1', 6, 'state.gps_heading', 'heading', 1, NULL, 0, 360), ('B', '1', 7, 'state.harsh_braking', 'harsh_brake', NULL, '{"true":"YES","false":"NO"}', NULL, NULL),
    ('B', '1', 8, 'state.charging', 'charging_state', NULL, '{"true":"CHARGING","false":"NOT_CHARGING"}', NULL, NULL), ('B', '1', 9, 'state.fault', 'fault_code', NULL, NULL, NULL, NULL),
    ('A', '2', 0, 'data.speed_mph', 'vehicle_speed', 1.60934, NULL, 0, 300), ('A', '2', 1, 'data.charge_fraction', 'battery_soc', 100, NULL, 0, 100), ('A', '2', 2, 'metadata.odo_miles', 'odometer', 1.60934, NULL, 0, 2000000),
    ('A', '2', 3, 'metadata.status', 'ignition_status', NULL, '{"running":"ON","stopped":"OFF"}', NULL, NULL), ('A', '2', 4, 'data.lat', 'latitude', 1, NULL, -90, 90), ('A', '2', 5, 'data.lon', 'longitude', 1, NULL, -180, 180), ('A', '2', 6, 'metadata.timestamp', 'event_time', NULL, NULL, NULL, NULL),
    ('A', '2', 7, 'metadata.fault_code', 'fault_code', NULL, NULL, NULL, NULL),
    ('C', '1', 0, 'speed', 'vehicle_speed', 1, NULL, 0, 300), ('C', '1', 1, 'soc', 'battery_soc', 1, NULL, 0, 100), ('C', '1', 2, 'odometer', 'odometer', 1, NULL, 0, 2000000), ('C', '1', 3, 'lat', 'latitude', 1, NULL, -90, 90), ('C', '1', 4, 'lon', 'longitude', 1, NULL, -180, 180),
    ('C', '1', 5, 'timestamp', 'event_time', NULL, NULL, NULL, NULL), ('C', '1', 6, 'status', 'ignition_status', NULL, '{"MOVING":"ON","IDLE":"ON","PARKED":"OFF","CHARGING":"OFF"}', NULL, NULL)"""
#: The value at a path of the table x: the literal key first, and vendor B's paths also without "state.".
_FOUND = """CASE WHEN json_exists(payload, '$."' || path || '"') THEN json_extract(payload, '$."' || path || '"') ELSE json_extract(payload, '$.' || path) END"""
_LOOSE = """CASE WHEN vendor = 'B' AND starts_with(path, 'state.') AND (v IS NULL OR json_type(v) = 'NULL') THEN json_extract(payload, '$.' || substr(path, 7)) ELSE v END"""


def _detect() -> str:
    """Each payload against the fields of each contract of its vendor, as rows."""
    return f"""{PAY}, ctr(vendor, version, pos, path, type, req, tm, place, lo, hi) AS (VALUES {CONTRACT_ROWS}),
        f0 AS (SELECT event_id, payload, ctr.*, {_FOUND} AS v FROM pay JOIN ctr USING (vendor)), f1 AS (SELECT * EXCLUDE (v), {_LOOSE} AS v FROM f0),
        f2 AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'other' WHEN 'ARRAY' THEN 'other' WHEN 'NULL' THEN NULL ELSE CASE WHEN v IS NOT NULL THEN 'number' END END AS kind, v ->> '$' AS txt FROM f1),
        f3 AS (SELECT *, CASE WHEN kind IS NULL THEN NULL WHEN kind <> type THEN CASE type WHEN 'number' THEN 'INVALID_VALUE' ELSE 'TYPE_ERROR' END
            WHEN type = 'number' AND (txt::DOUBLE < lo OR txt::DOUBLE > hi) THEN CASE WHEN place THEN 'INVALID_COORDINATES' ELSE 'INVALID_VALUE' END
            WHEN tm AND NOT CASE WHEN type = 'number' THEN txt::DOUBLE > 0 ELSE length(txt) > 5 AND try_cast(txt AS TIMESTAMPTZ) IS NOT NULL END THEN 'INVALID_TIME' END || ':' || path AS err FROM f2),
        fit AS (SELECT event_id, version, coalesce(arg_min(err, pos) FILTER (err IS NOT NULL), 'OK') AS verdict FROM f3 GROUP BY 1, 2 HAVING bool_and(NOT req OR kind IS NOT NULL)),
        det AS MATERIALIZED (SELECT pay.*, best.version, coalesce(best.verdict, 'SCHEMA_CHANGE:') AS verdict FROM pay LEFT JOIN (SELECT event_id, max(version) AS version, arg_max(verdict, version) AS verdict FROM fit GROUP BY 1) best USING (event_id))"""


def _normal(det: str = "det") -> str:
    """The rules of the version that decided, as rows."""
    number = ", ".join(f"max(num) FILTER (signal = '{s}') AS {s}" for s in mp.NUMERIC)
    text = ", ".join(f"max(txt) FILTER (signal = '{s}') AS {s}" for s in mp.TEXT)
    return f"""{_detect()}, rl(vendor, version, pos, path, signal, factor, codes, lo, hi) AS (VALUES {RULE_ROWS}),
        r0 AS (SELECT event_id, payload, rl.*, {_FOUND} AS v FROM {det} d JOIN rl USING (vendor, version) WHERE verdict = 'OK'), r1 AS (SELECT * EXCLUDE (v), {_LOOSE} AS v FROM r0),
        r2 AS (SELECT *, try_cast(v ->> '$' AS DOUBLE) * factor::DOUBLE AS num, coalesce(json_extract_string(codes, '$.' || (v ->> '$')), v ->> '$') AS txt FROM r1 WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
        r3 AS (SELECT *, CASE WHEN factor IS NULL THEN NULL WHEN num IS NULL THEN 'TYPE_ERROR' WHEN num < lo OR num > hi THEN CASE WHEN signal IN ('latitude', 'longitude') THEN 'INVALID_COORDINATES' ELSE 'INVALID_VALUE' END END || ':' || signal AS err FROM r2),
        sig AS (SELECT event_id, {number}, {text}, arg_min(err, pos) FILTER (err IS NOT NULL) AS err FROM r3 GROUP BY 1),
        norm AS MATERIALIZED (SELECT d.* EXCLUDE (verdict), coalesce(err, verdict) AS verdict, {', '.join((*mp.NUMERIC, *mp.TEXT))} FROM {det} d LEFT JOIN sig USING (event_id))"""


DETECTED, NORMAL = _detect(), _normal()


def detected(s: SparkSession, d: str) -> DataFrame:
    return ct.detect(payloads(s, d))


def normalized(s: SparkSession, d: str) -> DataFrame:
    return mp.normalize(ct.detect(payloads(s, d), parsed=True))


def nested_path(s, d):
    p = payloads(s, d)
    return p.select("event_id", ct.nested(F.col("payload"), "data.speed_mph").alias("nested"), ct.nested(F.col("payload"), "speed_mph").alias("flat"), ct.nested(F.lit('{"a.b":1,"a":{"b":2},"s":[{"r":5}]}'), "a.b").alias("dotted"), ct.nested(F.lit('{"s":[{"r":5}]}'), "s.0.r").alias("indexed"))


def unit_conversion(s, d):
    v = F.col("speed_kmh")
    kinds = ("MPH_TO_KMH", "MILES_TO_KM", "FRACTION_TO_PERCENT", "METRES_TO_KM", "CELSIUS_FROM_FAHRENHEIT", "DIRECT")
    return telemetry(s, d).select("event_id", *[F.round(mp.convert(v, k), 6).alias(k.lower()) for k in kinds])


def repair_conversions(s, d):
    t = telemetry(s, d)
    return t.select("event_id", F.round(mp.scaled(F.col("speed_kmh"), 0.5, -3.0), 6).alias("scale_offset"), F.round(mp.convert(F.col("speed_kmh"), "MICRODEGREES_TO_DEGREES"), 9).alias("degrees"), F.expr("unix_micros(timestamp_seconds(t_us div 1000000))").alias("from_seconds"), F.expr("unix_micros(timestamp_millis(t_us div 1000))").alias("from_millis"))


def range_check(s, d):
    v = F.col("speed_kmh")
    return telemetry(s, d).select("event_id", F.when(~v.between(*mp.RANGES["vehicle_speed"]), "INVALID_VALUE").when(~(F.col("lat") + F.col("k")).between(*mp.RANGES["latitude"]), "INVALID_COORDINATES").otherwise("OK").alias("verdict"))


def strict_number(s, d):
    shapes = F.element_at(F.array(*[F.lit(x) for x in ('{"x":1.5}', '{"x":"2.25"}', '{"x":""}', '{"x":true}', '{"x":{"y":1}}', '{"x":"NaN"}', '{"x":" 7 "}', '{"x":null}', "{}")]), (F.col("event_id") % 9 + 1).cast("int"))
    return telemetry(s, d).select("event_id", mp.strict_number(F.try_parse_json(shapes), "x").alias("number"))


REPAIR = [("vehicle_speed", ["speed_mph", "data.speed_mph", "speed"], "DIRECT"), ("latitude", ["lat", "data.lat"], "DIRECT"), ("longitude", ["lon", "data.lon"], "DIRECT"), ("event_time", ["timestamp", "metadata.timestamp"], "ISO_TIME")]


def repair_evaluate(s, d):
    return mp.repair_evaluate(payloads(s, d), REPAIR).select("event_id", "vehicle_speed", "latitude", "longitude", "event_time", "errors")


def _repair_sql() -> str:
    def first(sources: list[str], f) -> str:
        return "CASE " + " ".join(f"WHEN {_type(p)} IS NOT NULL THEN {f(p)}" for p in sources) + " END"

    def strict(p: str) -> str:
        return f"CASE WHEN {_type(p)} IN ('number', 'string') AND length(trim({_text(p)})) > 0 AND isfinite(try_cast(trim({_text(p)}) AS DOUBLE)) THEN try_cast(trim({_text(p)}) AS DOUBLE) END"

    columns, errors = [], []
    for signal, sources, _ in REPAIR:
        if signal == "event_time":
            columns.append(f"{first(sources, _text)} AS raw_time")
            zoned = "regexp_matches(raw_time, '^\\d{4}-\\d\\d-\\d\\dT.*(?:Z|[+-]\\d\\d:\\d\\d)$') AND try_cast(raw_time AS TIMESTAMPTZ) IS NOT NULL"
            errors.append(f"CASE WHEN raw_time IS NULL THEN 'event_time:missing' WHEN NOT ({zoned}) THEN 'event_time:invalid' END")
        else:
            low, high = mp.RANGES[signal]
            columns.append(f"{first(sources, strict)} AS raw_{signal}, {first(sources, lambda p: 'true')} AS has_{signal}")
            errors.append(f"CASE WHEN has_{signal} AND raw_{signal} IS NULL THEN '{signal}:not a number' WHEN raw_{signal} NOT BETWEEN {low} AND {high} THEN '{signal}:out of range' END")
    value = lambda s: f"CASE WHEN raw_{s} BETWEEN {mp.RANGES[s][0]} AND {mp.RANGES[s][1]} THEN raw_{s} END AS {s}"
    return f"""WITH {PAY}, r0 AS (SELECT event_id, {', '.join(columns)} FROM pay),
        r1 AS (SELECT *, {value('vehicle_speed')}, {value('latitude')}, {value('longitude')}, CASE WHEN {zoned} THEN raw_time END AS event_time FROM r0)
        SELECT event_id, vehicle_speed, latitude, longitude, event_time, concat_ws(';', {', '.join(errors)},
            CASE WHEN (latitude IS NULL) <> (longitude IS NULL) THEN 'gps:incomplete' END, CASE WHEN coalesce(vehicle_speed, latitude, longitude) IS NULL THEN 'measurement:missing' END) AS errors FROM r1"""


ALIASES = [("velocity", "speed"), ("velocity", "speed_mph"), ("battery", "soc"), ("position", "lat"), ("position", "lon"), ("time", "timestamp")]


def suggest_source(s, d):
    present = payloads(s, d).select(F.concat_ws("-", "vendor", (F.col("k") % 2).cast("string")).alias("format"), F.explode(F.json_object_keys("payload")).alias("alias")).distinct()
    aliases = s.createDataFrame(ALIASES, "field string, alias string")
    missing = present.select("format", F.explode(F.array(*[F.lit(f) for f in sorted({f for f, _ in ALIASES})])).alias("field")).distinct()
    return mp.suggest_source(missing, present, aliases)


def mapping_tests(s, d):
    """Old speed by rule against the fixture's own, within 0.05 (both in the vendor's unit)."""
    n = normalized(s, d).where("verdict = 'OK'").join(telemetry(s, d).select("event_id", "speed_kmh"), "event_id")
    expected = F.col("speed_kmh") * F.when(F.col("vendor") == "A", mp.MILES).otherwise(1.0)
    return n.groupBy("vendor", "version").agg(F.count("*").alias("cases"), F.count_if(F.abs(F.col("vehicle_speed") - expected) <= 0.05).alias("passed"))


def repair_regression(s, d):
    """Rows where a repair's reading differs from the published mapping's."""
    old = normalized(s, d).where("verdict = 'OK'").select("event_id", F.col("vehicle_speed").alias("old"))
    new = mp.repair_evaluate(payloads(s, d), REPAIR).select("event_id", F.col("vehicle_speed").alias("new"), "errors")
    return old.join(new, "event_id").select("event_id", "old", "new", F.when(F.abs(F.col("old") - F.col("new")) <= 0.05, "same").otherwise("changed").alias("outcome"))


def repair_select(s, d):
    """Which path handles a payload: its own format, or the repair where only that one works."""
    own = detected(s, d).select("event_id", "vendor", "verdict")
    fixed = mp.repair_evaluate(payloads(s, d), REPAIR).select("event_id", "errors")
    return own.join(fixed, "event_id").select("event_id", F.when(F.col("verdict") == "OK", "contract").when(F.col("errors") == "", "repair").otherwise("quarantine").alias("path"))


def conflict_diff(s, d):
    """Fields in which two payloads of a source id differ."""
    r = raw(s, d).select("event_id", "event_key", "payload")
    fields = ("event_id", "speed", "k")
    a = r.where("event_key < 1000000000").select("event_id", *[F.get_json_object("payload", f"$.{f}").alias(f"old_{f}") for f in fields])
    b = r.where("event_key >= 2000000000").select("event_id", *[F.get_json_object("payload", f"$.{f}").alias(f"new_{f}") for f in fields])
    diff = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new")) for f in fields]))
    return a.join(b, "event_id").select("event_id", diff.alias("x")).select("event_id", "x.*").where("old <> new")


QUERIES = {
    "nested_path": nested_path,
    "contract_catalog": lambda s, d: ct.catalogue(s),
    "contract_infer": lambda s, d: ct.infer(s.createDataFrame([("x1", '{"gps_lat":"number","gps_lon":"number","read_time":"string","level":"number"}')], "format string, description string")),
    "contract_validate": lambda s, d: detected(s, d).select("event_id", "verdict"),
    "format_detect": lambda s, d: detected(s, d).select("event_id", "vendor", "version"),
    "observed_structure": lambda s, d: payloads(s, d).select("event_id", ct.observed_structure(F.col("payload")).alias("keys")),
    "normalize_verdict": lambda s, d: normalized(s, d).select("event_id", "verdict"),
    "normalize_events": lambda s, d: normalized(s, d).where("verdict = 'OK'").select("event_id", "vehicle_id", *[F.round(c, 6).alias(c) for c in mp.NUMERIC], *mp.TEXT),
    "mapping_preview": lambda s, d: mp.normalize(payloads(s, d).withColumn("version", F.when((F.col("vendor") == "A") & (F.col("k") % 2 == 1), "2").otherwise("1")).withColumn("verdict", F.lit("OK"))).select("event_id", "vehicle_speed", "battery_soc", "ignition_status", "event_time"),
    "mapping_tests": mapping_tests,
    "unit_conversion": unit_conversion,
    "range_check": range_check,
    "strict_number": strict_number,
    "repair_evaluate": repair_evaluate,
    "repair_conversions": repair_conversions,
    "repair_regression": repair_regression,
    "repair_select": repair_select,
    "suggest_source": suggest_source,
    "sample_ends": lambda s, d: mp.sample_ends(detected(s, d).where("verdict <> 'OK'").select("verdict", "event_id", "t_us"), "verdict", ["t_us", "event_id"], 7),
    "conflict_diff": conflict_diff,
}

_ASSUMED = ", assumed AS MATERIALIZED (SELECT * REPLACE (CASE WHEN vendor = 'A' AND k % 2 = 1 THEN '2' ELSE '1' END AS version, 'OK' AS verdict) FROM det), rl("
_PREVIEW = _normal("assumed").replace(", rl(", _ASSUMED, 1)
_REPAIRED = f"rep AS MATERIALIZED ({_repair_sql()})"
ORACLES = {
    "contract_catalog": f"SELECT vendor, version, pos::INT AS position, path, type, req AS required, tm AS is_time, place AS is_place, lo::DOUBLE AS low, hi::DOUBLE AS high FROM (VALUES {CONTRACT_ROWS}) t(vendor, version, pos, path, type, req, tm, place, lo, hi)",
    "contract_infer": "SELECT 'x1' AS format, path, type, true AS required, contains(path, 'lat') AS is_lat, contains(path, 'lon') AS is_lon, contains(path, 'time') AS is_time FROM (VALUES ('gps_lat', 'number'), ('gps_lon', 'number'), ('read_time', 'string'), ('level', 'number')) t(path, type)",
    "observed_structure": f"WITH {PAY} SELECT event_id, substr('[\"' || array_to_string(json_keys(payload), '\",\"') || '\"]', 1, 120) AS keys FROM pay",
    "repair_regression": f"WITH {_REPAIRED}, old AS MATERIALIZED (WITH {NORMAL} SELECT event_id, vehicle_speed FROM norm WHERE verdict = 'OK') SELECT event_id, old.vehicle_speed AS old, rep.vehicle_speed AS new, CASE WHEN abs(old.vehicle_speed - rep.vehicle_speed) <= 0.05 THEN 'same' ELSE 'changed' END AS outcome FROM old JOIN rep USING (event_id)",
    "repair_select": f"WITH {_REPAIRED}, own AS MATERIALIZED (WITH {DETECTED} SELECT event_id, verdict FROM det) SELECT event_id, CASE WHEN verdict = 'OK' THEN 'contract' WHEN errors = '' THEN 'repair' ELSE 'quarantine' END AS path FROM own LEFT JOIN rep USING (event_id)",
    "nested_path": f"WITH {PAY} SELECT event_id, {_text('data.speed_mph')} AS nested, json_extract_string(payload, '$.speed_mph') AS flat, '1' AS dotted, '5' AS indexed FROM pay",
    "contract_validate": f"WITH {DETECTED} SELECT event_id, verdict FROM det",
    "format_detect": f"WITH {DETECTED} SELECT event_id, vendor, version FROM det",
    "normalize_verdict": f"WITH {NORMAL} SELECT event_id, verdict FROM norm",
    "normalize_events": f"WITH {NORMAL} SELECT event_id, vehicle_id, {', '.join(f'round({c}, 6) AS {c}' for c in mp.NUMERIC)}, {', '.join(mp.TEXT)} FROM norm WHERE verdict = 'OK'",
    "mapping_preview": f"WITH {_PREVIEW} SELECT event_id, vehicle_speed, battery_soc, ignition_status, event_time FROM norm",
    "mapping_tests": f"WITH {NORMAL} SELECT vendor, version, count(*) AS cases, count(*) FILTER (abs(vehicle_speed - speed_kmh * CASE WHEN vendor = 'A' THEN 1.60934 ELSE 1 END) <= 0.05) AS passed FROM norm JOIN (SELECT event_id, speed_kmh FROM tel) USING (event_id) WHERE verdict = 'OK' GROUP BY ALL",
    "unit_conversion": f"""WITH {TEL} SELECT event_id, round(speed_kmh * 1.60934::DOUBLE, 6) AS mph_to_kmh, round(speed_kmh * 1.60934::DOUBLE, 6) AS miles_to_km, round(speed_kmh * 100, 6) AS fraction_to_percent, round(speed_kmh * 0.001::DOUBLE, 6) AS metres_to_km,
        round((speed_kmh - 32) * 5 / 9, 6) AS celsius_from_fahrenheit, round(speed_kmh, 6) AS direct FROM tel""",
    "range_check": f"WITH {TEL} SELECT event_id, CASE WHEN speed_kmh NOT BETWEEN 0 AND 300 THEN 'INVALID_VALUE' WHEN lat + k NOT BETWEEN -90 AND 90 THEN 'INVALID_COORDINATES' ELSE 'OK' END AS verdict FROM tel",
    "strict_number": f"WITH {TEL} SELECT event_id, CASE event_id % 9 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.25 WHEN 6 THEN 7 END AS number FROM tel",
    "repair_evaluate": _repair_sql(),
    "repair_conversions": f"WITH {TEL} SELECT event_id, round(speed_kmh * 0.5 - 3, 6) AS scale_offset, round(speed_kmh * 1e-6, 9) AS degrees, t_us // 1000000 * 1000000 AS from_seconds, t_us // 1000 * 1000 AS from_millis FROM tel",
    "suggest_source": f"""WITH {PAY}, present AS (SELECT DISTINCT vendor || '-' || (k % 2) AS format, unnest(json_keys(payload)) AS alias FROM pay), al(field, alias) AS (VALUES {', '.join(map(str, ALIASES))})
        SELECT format, field, min(alias) AS suggestion FROM present JOIN al USING (alias) GROUP BY ALL HAVING count(*) = 1""",
    "sample_ends": f"WITH {DETECTED} SELECT verdict, event_id, t_us FROM det WHERE verdict <> 'OK' QUALIFY row_number() OVER (PARTITION BY verdict ORDER BY t_us, event_id) <= 4 OR row_number() OVER (PARTITION BY verdict ORDER BY t_us DESC, event_id DESC) <= 3",
    "conflict_diff": f"WITH {TEL} SELECT event_id, 'speed' AS field, (round(speed_kmh * 100)::BIGINT)::VARCHAR AS old, (round((speed_kmh + 1) * 100)::BIGINT)::VARCHAR AS new FROM tel WHERE event_id % 97 = 0",
}
