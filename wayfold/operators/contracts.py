"""Format contracts: which fields a vendor's payload must have, of what type and range.

A contract is compiled to column expressions over one parsed variant, so a payload is parsed once and no Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER, STRING, BOOLEAN = "number", "string", "boolean"
#: Vendor B's payloads may leave this part of a path out.
LOOSE_VENDOR, LOOSE_PREFIX = "B", "state."


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    place: bool = False
    time: bool = False


@dataclass(frozen=True)
class Contract:
    vendor: str
    version: str
    fields: tuple[Field, ...]


def _f(path: str, type_: str = NUMBER, required: bool = False, low: float | None = None, high: float | None = None, place: bool = False, time: bool = False) -> Field:
    return Field(path, type_, required, low, high, place, time)


#: The known formats of the three vendors, the newest version of each first.
CONTRACTS = (
    Contract("A", "2", (_f("data.speed_mph", required=True, low=0, high=250), _f("data.charge_fraction", required=True, low=0, high=1), _f("data.lat", required=True, low=-90, high=90, place=True), _f("data.lon", required=True, low=-180, high=180, place=True), _f("metadata.timestamp", STRING, True, time=True), _f("metadata.odo_miles", low=0), _f("metadata.status", STRING), _f("metadata.fault_code", STRING))),
    Contract("A", "1", (_f("speed_mph", required=True, low=0, high=250), _f("charge_fraction", required=True, low=0, high=1), _f("timestamp", STRING, True, time=True), _f("lat", low=-90, high=90, place=True), _f("lon", low=-180, high=180, place=True), _f("odo_miles", low=0), _f("status", STRING), _f("altitude"), _f("heading"), _f("harsh_brake", BOOLEAN), _f("fault_code", STRING))),
    Contract("B", "1", (_f("state.velocity_kmh", required=True, low=0, high=350), _f("state.battery_pct", required=True, low=0, high=100), _f("state.gps_lat", required=True, low=-90, high=90, place=True), _f("state.gps_lon", required=True, low=-180, high=180, place=True), _f("time_measured", required=True, time=True), _f("state.distance_km"), _f("state.ignition", BOOLEAN), _f("state.gps_heading"), _f("state.harsh_braking", BOOLEAN), _f("state.charging", BOOLEAN), _f("state.fault", STRING))),
    Contract("C", "1", (_f("vehicle_id", STRING, True), _f("timestamp", STRING, True, time=True), _f("speed", required=True, low=0, high=300), _f("soc", required=True, low=0, high=100), _f("odometer", low=0), _f("lat", low=-90, high=90, place=True), _f("lon", low=-180, high=180, place=True), _f("status", STRING))),
)


def json_path(path: str) -> str:
    """A dotted path as a JSON path; plain numbers are places in arrays."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def nested(payload: Column, path: str) -> Column:
    """The text at a path: a literal dotted key wins, otherwise the dots are steps."""
    walked = F.get_json_object(payload, json_path(path))
    return F.coalesce(F.get_json_object(payload, f"$['{path}']"), walked) if "." in path else walked


def type_name(kind: Column) -> Column:
    """number, string, boolean or other for the schema text of a variant; null where it is missing or null."""
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), NUMBER)
        .when(kind == "STRING", STRING)
        .when(kind == "BOOLEAN", BOOLEAN)
        .otherwise("other")
    )


def json_type(parsed: Column, path: str) -> Column:
    """The type of the value at a path of a parsed payload."""
    return type_name(F.schema_of_variant(F.try_variant_get(parsed, json_path(path), "variant")))


def once(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """The kept columns and new ones that are computed once.

    They pass through a generator of one row: the optimizer would otherwise copy a long expression into each filter and
    column that uses it. They are made before it, beside a lambda: Spark compiles a projection with a lambda into many
    small methods. Without it all of a stage becomes a single method, too large for the JVM to compile, and is interpreted.
    """
    apart = F.exists(F.array(F.lit(None).cast("boolean"), F.col(keep[0]).isNull()), lambda x: x)
    made = rows.select(*keep, F.struct(*[c.alias(n) for n, c in columns.items()], apart.alias("apart")).alias("made"))
    return made.select(*keep, F.inline(F.array("made"))).drop("apart")


def apart(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that Spark compiles in small methods, as in once(), but that the optimizer may copy into a filter."""
    never = F.exists(F.array(F.col(rows.columns[0]).isNull()), lambda x: x.isNull())
    first = next(iter(columns))
    return rows.withColumns(columns | {first: F.when(~never, columns[first])})


def taken_apart(rows: DataFrame, paths: list[str], loose: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with a column an object on these paths of the column ``parsed``, and the value at each path, a variant.

    A literal dotted key wins, even if its value is null; otherwise the dots are steps, and numbers are places in arrays.
    For rows that are ``loose`` a path that leads to nothing or null is tried again without its first part "state.".
    Each object on the way is taken apart once, so the work follows the number of objects, not of paths.
    """
    tries = {p: [p, *([p.removeprefix(LOOSE_PREFIX)] if loose is not None and p.startswith(LOOSE_PREFIX) else [])] for p in paths}
    members: dict[tuple[str, ...], dict[str, None]] = {(): {}}
    for path in dict.fromkeys(q for t in tries.values() for q in t):
        members[()][path] = None
        steps = tuple(path.split("."))
        for n, step in enumerate(steps):
            members.setdefault(steps[:n], {})[step] = None
    names = {at: f"object_{i}" for i, at in enumerate(sorted(members, key=len))}

    def member(at: tuple[str, ...]) -> Column:
        inside = F.col(f"{names[at[:-1]]}.`{at[-1]}`")
        return F.coalesce(inside, F.try_variant_get(member(at[:-1]), f"$[{at[-1]}]", "variant")) if at[-1].isdigit() and len(at) > 1 else inside

    def found(path: str) -> Column:
        literal, steps = F.col(f"{names[()]}.`{path}`"), tuple(path.split("."))
        return F.coalesce(literal, member(steps)) if len(steps) > 1 else literal

    taken = rows
    for at, name in names.items():
        shape = ", ".join(f"`{m}`: variant" for m in members[at])
        taken = taken.withColumn(name, F.try_variant_get(member(at) if at else F.col("parsed"), "$", f"struct<{shape}>"))
    values = {}
    for path in paths:
        values[path] = value = found(tries[path][0])
        if len(tries[path]) > 1:
            values[path] = F.when(loose & ~there(value), found(tries[path][1])).otherwise(value)
    return taken, values


def there(value: Column) -> Column:
    """Whether a variant is neither missing nor null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def with_values(rows: DataFrame, paths: list[str], loose: Column | None = None) -> DataFrame:
    """Adds value_0, value_1, ... as variants: the values at these paths of the column ``parsed``, as taken_apart() finds them."""
    taken, values = taken_apart(rows, paths, loose)
    return once(taken, rows.columns, {f"value_{i}": values[path] for i, path in enumerate(paths)})


def placed(wanted: dict[int, list[str]], values: dict[str, Column], which: Column) -> dict[str, Column]:
    """value_0, value_1, ...: the values of a row at the paths that are wanted of its kind, which ``which`` numbers.

    Rows of one kind have no use for the paths of others, so place i holds the i-th path of whatever kind a row is of.
    """
    out: dict[str, Column] = {}
    for i in range(max(map(len, wanted.values()), default=0)):
        value = F.lit(None).cast("variant")
        for kind, paths in wanted.items():
            if i < len(paths) and paths[i] is not None:
                value = F.when(which == kind, values[paths[i]]).otherwise(value)
        out[f"value_{i}"] = value
    return out


def aligned(first: list[list[str]], last: list[list[str]]) -> dict[int, list[str]]:
    """The paths of each kind, those of ``last`` from the same place on for all kinds."""
    width = max(map(len, first), default=0)
    return {n: [*a, *[None] * (width - len(a)), *b] for n, (a, b) in enumerate(zip(first, last, strict=True))}


def loose_vendor() -> Column:
    return F.col("vendor") == LOOSE_VENDOR


def read_out(rows: DataFrame, paths: dict[str, Column], loose: Column | None = None, numbers: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """Adds each path's type, number and text once, as columns that the checks then share; ``parsed`` goes.

    ``paths``: each path and for which rows it is read at all. Only values of type number have a number: to try texts as
    numbers costs an exception for each that is none. ``numbers`` and ``texts``: the paths that have these columns; all without it.
    """
    looked_up, named = {}, {}
    for i, (path, wanted) in enumerate(paths.items()):
        value = F.col(f"value_{i}")
        looked_up[f"schema_{i}"] = F.when(wanted, F.schema_of_variant(value))
        named[f"kind_{i}"] = type_name(F.col(f"schema_{i}"))
        if numbers is None or path in numbers:
            named[f"number_{i}"] = F.when(type_name(F.col(f"schema_{i}")) == NUMBER, F.try_variant_get(value, "$", "double"))
        if texts is None or path in texts:
            named[f"text_{i}"] = F.when(wanted, F.try_variant_get(value, "$", "string"))
    keep = [c for c in rows.columns if c != "parsed"]
    return once(with_values(rows, list(paths), loose).withColumns(looked_up), keep, named | {"unread": F.col("parsed").isNull()})


def field_error(f: Field, i: int) -> Column:
    """The category of the first error in field i of read_out(), null if it is sound or absent."""
    kind, value = F.col(f"kind_{i}"), F.col(f"number_{i}")
    found = F.when(kind != f.type, "INVALID_VALUE" if f.type == NUMBER else "TYPE_ERROR")
    for beyond in ([value < f.low] if f.low is not None else []) + ([value > f.high] if f.high is not None else []):
        found = found.when(beyond, "INVALID_COORDINATES" if f.place else "INVALID_VALUE")
    if f.time:
        sound = value > 0 if f.type == NUMBER else (F.length(f"text_{i}") > 5) & F.col(f"text_{i}").try_cast("timestamp").isNotNull()
        found = found.when(~sound, "INVALID_TIME")
    return F.when(kind.isNotNull(), found)


def detect(payloads: DataFrame, contracts: tuple[Contract, ...] = CONTRACTS, parsed: bool = False) -> DataFrame:
    """Adds the version that decides a payload and its verdict; ``payloads`` has vendor and payload.

    The first contract of the vendor whose required fields are all there decides, by the first error of its fields.
    A payload that is no JSON fits no contract. With ``parsed`` an accepted payload is kept as a variant under this name.
    """
    paths = list(dict.fromkeys(f.path for c in contracts for f in c.fields))
    rows, values = taken_apart(payloads.withColumn("parsed", F.try_parse_json("payload")), paths, loose_vendor())
    fits = F.lit(None).cast("int")
    for n, c in reversed(list(enumerate(contracts))):
        here = F.col("vendor") == c.vendor
        for f in c.fields:
            if f.required:
                here = here & there(values[f.path])
        fits = F.when(here, n).otherwise(fits)
    numeric = [[f for f in c.fields if f.low is not None or f.high is not None or (f.time and f.type == NUMBER)] for c in contracts]
    texts = [sorted((f for f in c.fields if f not in own), key=lambda f: not f.time) for c, own in zip(contracts, numeric, strict=True)]
    wanted = aligned([[f.path for f in own] for own in numeric], [[f.path for f in own] for own in texts])
    kept = [*payloads.columns, *(["parsed"] if parsed else [])]
    rows = apart(apart(rows, {"fits": fits}), placed(wanted, values, F.col("fits")) | {"unread": F.col("parsed").isNull()})
    count, width = max(map(len, wanted.values()), default=0), max(map(len, numeric), default=0)
    timed = max((sum(f.time for f in own) for own in texts), default=0)
    rows = rows.withColumns({f"schema_{i}": F.schema_of_variant(f"value_{i}") for i in range(count)})
    rows = apart(rows, {f"kind_{i}": type_name(F.col(f"schema_{i}")) for i in range(count)})
    rows = rows.withColumns({f"number_{i}": F.when(F.col(f"kind_{i}") == NUMBER, F.try_variant_get(f"value_{i}", "$", "double")) for i in range(width)})
    rows = rows.withColumns({f"text_{i}": F.try_variant_get(f"value_{i}", "$", "string") for i in range(width, width + timed)})
    version, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, c in enumerate(contracts):
        here = F.col("fits") == n
        errors = [F.concat(field_error(f, wanted[n].index(f.path)), F.lit(f":{f.path}")) for f in c.fields]
        version = F.when(here, c.version).otherwise(version)
        verdict = F.when(here, F.coalesce(*errors, F.lit("OK"))).otherwise(verdict)
    known = F.col("vendor").isin(*{c.vendor for c in contracts})
    missing = F.when(~known, "UNKNOWN_FORMAT:").when(F.col("unread"), "SCHEMA_CHANGE:payload").otherwise("SCHEMA_CHANGE:")
    return once(rows, kept, {"version": version, "verdict": F.coalesce(verdict, missing)})


def catalogue(spark) -> DataFrame:
    """The contracts as rows, a field each."""
    rows = [(c.vendor, c.version, i, f.path, f.type, f.required, f.time, f.place, None if f.low is None else float(f.low), None if f.high is None else float(f.high)) for c in CONTRACTS for i, f in enumerate(c.fields)]
    return spark.createDataFrame(rows, "vendor string, version string, position int, path string, type string, required boolean, is_time boolean, is_place boolean, low double, high double")


def infer(samples: DataFrame) -> DataFrame:
    """The generic form: each top-level text entry of a description becomes a required field, with flags by its name."""
    pairs = samples.select("format", F.explode(F.from_json("description", "map<string,string>")).alias("path", "type"))
    name = F.lower("path")
    return pairs.select("format", "path", "type", F.lit(True).alias("required"), name.contains("lat").alias("is_lat"), name.contains("lon").alias("is_lon"), name.contains("time").alias("is_time"))


def observed_structure(payload: Column) -> Column:
    """The top-level keys as a JSON list, cut to 120 characters."""
    return F.substring(F.to_json(F.json_object_keys(payload)), 1, 120)
