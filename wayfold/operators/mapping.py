"""Mapping of vendor fields to canonical signals, and repairs of broken mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.contracts import aligned, apart, json_path, json_type, loose_vendor, once, placed, taken_apart, there, type_name

MILES = 1.60934
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Fixed value: the form of a time with its zone.
ISO_TIME = r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:\d\d)$"

#: Valid ranges of the numeric signals, and the meanings of codes.
RANGES = {"vehicle_speed": (0, 300), "battery_soc": (0, 100), "odometer": (0, 2_000_000), "latitude": (-90, 90), "longitude": (-180, 180), "altitude": (-500, 9000), "heading": (0, 360)}
STATUS = {"MOVING": "ON", "IDLE": "ON", "PARKED": "OFF", "CHARGING": "OFF"}
RUNNING = {"running": "ON", "stopped": "OFF"}
ON_OFF, YES_NO, CHARGING = {"true": "ON", "false": "OFF"}, {"true": "YES", "false": "NO"}, {"true": "CHARGING", "false": "NOT_CHARGING"}


@dataclass(frozen=True)
class Rule:
    path: str
    signal: str
    conversion: str = "DIRECT"
    codes: tuple[tuple[str, str], ...] = ()


def _codes(d: dict[str, str]) -> tuple[tuple[str, str], ...]:
    return tuple(d.items())


#: The rules by vendor and version, in the order in which they are checked.
RULES = {
    ("A", "1"): (
        Rule("speed_mph", "vehicle_speed", "MPH_TO_KMH"), Rule("charge_fraction", "battery_soc", "FRACTION_TO_PERCENT"), Rule("odo_miles", "odometer", "MILES_TO_KM"),
        Rule("status", "ignition_status", "ENUM_MAP", _codes(RUNNING)), Rule("lat", "latitude"), Rule("lon", "longitude"), Rule("altitude", "altitude"), Rule("heading", "heading"),
        Rule("harsh_brake", "harsh_brake", "ENUM_MAP", _codes(YES_NO)), Rule("fault_code", "fault_code"), Rule("timestamp", "event_time"),
    ),
    ("A", "2"): (
        Rule("data.speed_mph", "vehicle_speed", "MPH_TO_KMH"), Rule("data.charge_fraction", "battery_soc", "FRACTION_TO_PERCENT"), Rule("metadata.odo_miles", "odometer", "MILES_TO_KM"),
        Rule("metadata.status", "ignition_status", "ENUM_MAP", _codes(RUNNING)), Rule("data.lat", "latitude"), Rule("data.lon", "longitude"), Rule("metadata.timestamp", "event_time"), Rule("metadata.fault_code", "fault_code"),
    ),
    ("B", "1"): (
        Rule("state.velocity_kmh", "vehicle_speed"), Rule("state.battery_pct", "battery_soc"), Rule("state.distance_km", "odometer"), Rule("state.ignition", "ignition_status", "ENUM_MAP", _codes(ON_OFF)),
        Rule("state.gps_lat", "latitude"), Rule("state.gps_lon", "longitude"), Rule("state.gps_heading", "heading"), Rule("state.harsh_braking", "harsh_brake", "ENUM_MAP", _codes(YES_NO)),
        Rule("state.charging", "charging_state", "ENUM_MAP", _codes(CHARGING)), Rule("state.fault", "fault_code"),
    ),
    ("C", "1"): (
        Rule("speed", "vehicle_speed"), Rule("soc", "battery_soc"), Rule("odometer", "odometer"), Rule("lat", "latitude"), Rule("lon", "longitude"), Rule("timestamp", "event_time"),
        Rule("status", "ignition_status", "ENUM_MAP", _codes(STATUS)),
    ),
}
NUMERIC = ("vehicle_speed", "battery_soc", "odometer", "latitude", "longitude", "altitude", "heading")
TEXT = ("ignition_status", "harsh_brake", "charging_state", "fault_code", "event_time")


def convert(value: Column, conversion: str) -> Column:
    """A number in the signal's unit."""
    factor = {"MPH_TO_KMH": MILES, "MILES_TO_KM": MILES, "FRACTION_TO_PERCENT": 100.0, "METRES_TO_KM": 0.001, "MICRODEGREES_TO_DEGREES": 1e-6}
    if conversion == "CELSIUS_FROM_FAHRENHEIT":
        return (value - 32) * 5 / 9
    if conversion == "DIRECT":
        return value
    if conversion not in factor:
        raise ValueError(f"unknown conversion {conversion}")
    return value * factor[conversion]


def scaled(value: Column, scale: float, offset: float) -> Column:
    return value * scale + offset


def coded(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    """The code's meaning; an unknown code stays."""
    out = text
    for code, meaning in reversed(codes):
        out = F.when(text == code, meaning).otherwise(out)
    return out


def strict(kind: Column, text: Column) -> Column:
    """The number that a value of some type and text is; null for blanks, booleans, objects and what is not finite."""
    number = F.trim(text).try_cast("double")
    return F.when(kind.isin("number", "string") & F.trim(text).rlike(PLAIN_NUMBER) & (F.abs(number) < float("inf")), number)


def strict_number(parsed: Column, path: str) -> Column:
    return strict(json_type(parsed, path), F.try_variant_get(parsed, json_path(path), "string"))


def normalize(detected: DataFrame, rules: dict[tuple[str, str], tuple[Rule, ...]] = RULES) -> DataFrame:
    """The canonical signals of payloads that a contract accepted, and the verdict after the rules.

    ``detected`` comes from contracts.detect(), best with ``parsed``, or payloads are parsed again. A rejected payload keeps
    its verdict and has no signals; a source value that is missing or null leaves its signal out; the first one in the order
    of the rules that is no number (TYPE_ERROR) or out of the signal's range decides.
    """
    paths = list(dict.fromkeys(r.path for own in rules.values() for r in own))
    kept = [c for c in detected.columns if c != "parsed"]
    accepted = F.col("verdict") == "OK"
    parsed = F.col("parsed") if "parsed" in detected.columns else F.try_parse_json("payload")
    rows, values = taken_apart(detected.withColumn("parsed", F.when(accepted, parsed)), paths, loose_vendor())
    ruled = F.lit(None).cast("int")
    for n, (vendor, version) in enumerate(rules):
        ruled = F.when(accepted & (F.col("vendor") == vendor) & (F.col("version") == version), n).otherwise(ruled)
    numeric = [list(dict.fromkeys(r.path for r in own if r.signal in NUMERIC)) for own in rules.values()]
    texts = [list(dict.fromkeys(r.path for r in own if r.signal not in NUMERIC)) for own in rules.values()]
    wanted = aligned(numeric, texts)
    rows = apart(rows.withColumn("ruled", ruled), placed(wanted, values, F.col("ruled")))
    rows = rows.withColumns({f"number_{i}": F.try_variant_get(f"value_{i}", "$", "double") for i in range(max(map(len, numeric), default=0))})
    columns: dict[str, Column] = {s: F.lit(None).cast("double") for s in NUMERIC} | {s: F.lit(None).cast("string") for s in TEXT}
    error = F.lit(None).cast("string")
    for n, own in enumerate(rules.values()):
        here = F.col("ruled") == n
        bad = []
        for rule in own:
            if rule.signal in NUMERIC:
                i = wanted[n].index(rule.path)
                value = convert(F.col(f"number_{i}"), rule.conversion)
                low, high = RANGES[rule.signal]
                kind = "INVALID_COORDINATES" if rule.signal in ("latitude", "longitude") else "INVALID_VALUE"
                bad.append(F.when(value.isNull() & there(F.col(f"value_{i}")), f"TYPE_ERROR:{rule.signal}").when((value < low) | (value > high), f"{kind}:{rule.signal}"))
            else:
                value = coded(F.try_variant_get(f"value_{max(map(len, numeric)) + texts[n].index(rule.path)}", "$", "string"), rule.codes)
            columns[rule.signal] = F.when(here, value).otherwise(columns[rule.signal])
        error = F.when(here, F.coalesce(*bad, F.lit(None).cast("string"))).otherwise(error)
    numbers = ["ruled", *[c for c in rows.columns if c.startswith(("value_", "number_"))]]
    out = once(rows, [*[c for c in kept if c != "verdict"], *numbers], {"judged": F.coalesce(error, "verdict")})
    return out.select(*[F.col("judged").alias("verdict") if c == "verdict" else c for c in kept], *[c.alias(s) for s, c in columns.items()])


def first_found(rows: DataFrame, sources: list[list[str]], texts: set[int]) -> DataFrame:
    """Adds of each list of paths the first value of ``parsed`` that is there and not null; ``parsed`` goes.

    value_0, value_1, ... are variants, source_N their paths, kind_N their types, number_N the strict numbers that they are.
    Lists in ``texts`` have text_N, that of values of any type; the others', to whom strings matter alone, have that of strings.
    """
    taken, values = taken_apart(rows, list(dict.fromkeys(p for own in sources for p in own)))
    found = {}
    for n, own in enumerate(sources):
        value, source = F.lit(None).cast("variant"), F.lit(None).cast("string")
        for path in reversed(own):
            value = F.when(there(values[path]), values[path]).otherwise(value)
            source = F.when(there(values[path]), path).otherwise(source)
        found |= {f"value_{n}": value, f"source_{n}": source}
    each = range(len(sources))
    read = apart(taken, found).select(*[c for c in rows.columns if c != "parsed"], *found)
    read = read.withColumns({f"schema_{n}": F.schema_of_variant(f"value_{n}") for n in each})
    read = apart(read, {f"kind_{n}": type_name(F.col(f"schema_{n}")) for n in each}).drop(*[f"schema_{n}" for n in each])
    said = {n: F.try_variant_get(f"value_{n}", "$", "string") for n in each}
    read = read.withColumns({f"text_{n}": said[n] if n in texts else F.when(F.col(f"kind_{n}") == "string", said[n]) for n in each})
    read = read.withColumns({f"double_{n}": F.when(F.col(f"kind_{n}") == "number", F.try_variant_get(f"value_{n}", "$", "double")) for n in each})
    number = lambda n: F.when(F.col(f"kind_{n}") == "number", F.when(F.abs(f"double_{n}") < float("inf"), F.col(f"double_{n}"))).otherwise(strict(F.col(f"kind_{n}"), F.col(f"text_{n}")))
    return apart(read, {f"number_{n}": number(n) for n in each}).drop(*[f"double_{n}" for n in each])


def repair_evaluate(payloads: DataFrame, rules: list[tuple[str, list[str], str]]) -> DataFrame:
    """Repaired signals with all errors: each signal takes the first of its sources that is there.

    ``rules``: (signal, sources, conversion). Numbers are strict; both or neither coordinate; an event time and one more
    reading are required.
    """
    timed = {n for n, (signal, _, _) in enumerate(rules) if signal == "event_time"}
    read = first_found(payloads.withColumn("parsed", F.try_parse_json("payload")), [sources for _, sources, _ in rules], timed)
    raw = {}
    for n, (signal, _, conversion) in enumerate(rules):
        raw |= {f"raw_{signal}": F.col(f"text_{n}") if n in timed else convert(F.col(f"number_{n}"), conversion), f"has_{signal}": F.col(f"value_{n}").isNotNull()}
    rows = once(read, payloads.columns, raw)
    values, errors = {}, []
    for signal, _, _ in rules:
        value = F.col(f"raw_{signal}")
        if signal == "event_time":
            zoned = value.rlike(ISO_TIME) & value.try_cast("timestamp").isNotNull()
            values[signal] = F.when(zoned, value)
            errors.append(F.when(value.isNull(), "event_time:missing").when(~zoned, "event_time:invalid"))
        else:
            low, high = RANGES[signal]
            values[signal] = F.when(value.between(low, high), value)
            errors.append(F.when(F.col(f"has_{signal}") & value.isNull(), f"{signal}:not a number").when(~value.between(low, high), f"{signal}:out of range"))
    errors.append(F.when(values["latitude"].isNull() != values["longitude"].isNull(), "gps:incomplete"))
    errors.append(F.when(F.coalesce(*[v for s, v in values.items() if s != "event_time"]).isNull(), "measurement:missing"))
    return rows.select(*payloads.columns, *[v.alias(s) for s, v in values.items()], F.array_join(F.array_compact(F.array(*errors)), ";").alias("errors"))


def suggest_source(missing: DataFrame, present: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each missing field, the one field present under a known alias; none if several fit."""
    found = missing.join(F.broadcast(aliases), "field").join(present, ["format", "alias"])
    return found.groupBy("format", "field").agg(F.count("*").alias("n"), F.min("alias").alias("suggestion")).where("n = 1").drop("n")


def sample_ends(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The oldest half and the newest half of n rows of each group, each row once."""
    first = Window.partitionBy(group).orderBy(*[F.asc(c) for c in order])
    last = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    ranked = rows.withColumn("from_start", F.row_number().over(first)).withColumn("from_end", F.row_number().over(last))
    return ranked.where((F.col("from_start") <= -(-n // 2)) | (F.col("from_end") <= n // 2)).drop("from_start", "from_end")
