"""Repairs of mappings: sets of rules as tables, their validation, and their evaluation over payloads.

A repair is a few rows (at most 50 rules), which are compiled to expressions; payloads are read once, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.contracts import apart, once
from wayfold.operators.mapping import ISO_TIME, NUMERIC, RANGES, TEXT, convert, first_found, strict

#: The conversions, and the texts that signals may take.
NUMBER_CONVERSIONS = ("MPH_TO_KMH", "MILES_TO_KM", "FRACTION_TO_PERCENT", "METRES_TO_KM", "CELSIUS_FROM_FAHRENHEIT", "MICRODEGREES_TO_DEGREES")
CONVERSIONS = ("DIRECT", *NUMBER_CONVERSIONS, "UNIX_SECONDS", "UNIX_MILLISECONDS", "ISO_TIME", "ENUM_MAP", "SCALE_OFFSET")
LIVE_MODES = ("invalid_only", "matching", "replay_only")
CHOICES = {"ignition_status": ("ON", "OFF"), "harsh_brake": ("YES", "NO"), "charging_state": ("CHARGING", "NOT_CHARGING"), "idle_state": ("IDLE", "MOVING")}
SIGNALS = (*NUMERIC, *TEXT, "idle_state")
_FIELD = "array<struct<signal: string, source: string, raw: string, number: double, text: string, status: string, message: string>>"


@dataclass(frozen=True)
class RepairRule:
    signal: str
    sources: tuple[str, ...]
    conversion: str = "DIRECT"
    required: bool = False
    codes: dict[str, str] = field(default_factory=dict, hash=False)
    scale: float = 1.0
    offset: float = 0.0


@dataclass(frozen=True)
class RepairConfig:
    rules: tuple[RepairRule, ...]
    discriminator: tuple[str, str] | None = None  # path and text


def from_rows(rows: list) -> RepairConfig:
    """The repair of rows (position, signal, sources, conversion, required, codes, scale, offset, discriminator_path, discriminator_value)."""
    rows = sorted(rows, key=lambda r: r["position"])
    rules = tuple(RepairRule(r["signal"], tuple(r["sources"]), r["conversion"], r["required"], dict(r["codes"] or {}), 1.0 if r["scale"] is None else r["scale"], r["offset"] or 0.0) for r in rows)
    path = rows[0]["discriminator_path"]
    return RepairConfig(rules, (path, rows[0]["discriminator_value"]) if path else None)


def iso(stamp: Column) -> Column:
    """A time in UTC with milliseconds; the session's time zone is UTC."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def zoned(text: Column) -> Column:
    """The time that a text with a date, a T and an explicit zone is."""
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))


def _time(rule: RepairRule, kind: Column, text: Column, number: Column) -> Column:
    """The time that a source is under the conversions of times, null under the others."""
    if rule.conversion == "ISO_TIME":
        return F.when(kind == "string", zoned(text))
    if rule.conversion in ("UNIX_SECONDS", "UNIX_MILLISECONDS"):
        millis = number * (1000 if rule.conversion == "UNIX_SECONDS" else 1)
        return F.when((millis > 0) & (millis < 2.5e14), F.timestamp_millis(millis.cast("long")))
    return F.lit(None).cast("timestamp")


def _ruled(rule: RepairRule, kind: Column, text: Column, number: Column, time: Column) -> tuple[Column, Column, Column]:
    """Number, text and the message of what is wrong, for a source that is there; ``time`` is that of _time()."""
    plain = F.lit(None).cast("string")
    none, wrong = F.lit(None).cast("double"), F.lit(None).cast("string")
    if rule.conversion in NUMBER_CONVERSIONS or rule.conversion == "SCALE_OFFSET":
        wrong = F.when(number.isNull(), "not a number")
        number = number * rule.scale + rule.offset if rule.conversion == "SCALE_OFFSET" else convert(number, rule.conversion)
    elif rule.conversion in ("UNIX_SECONDS", "UNIX_MILLISECONDS"):
        millis = number * (1000 if rule.conversion == "UNIX_SECONDS" else 1)
        wrong = F.when(number.isNull(), "not a number").when(~((millis > 0) & (millis <= 8.64e15)), "invalid Unix time")
        plain, number = iso(time), none
    elif rule.conversion == "ISO_TIME":
        wrong, plain, number = F.when(time.isNull(), "no time with a zone"), iso(time), none
    elif rule.conversion == "ENUM_MAP":
        for code, meaning in rule.codes.items():
            plain = F.when(text == code, meaning).otherwise(plain)
        wrong = F.when(plain.isNull(), "no meaning for this code")
        number = strict(F.lit("string"), plain)
    elif rule.conversion == "DIRECT":
        plain = F.when(kind == "string", text)
    else:
        raise ValueError(f"unknown conversion {rule.conversion}")
    if rule.signal in NUMERIC:
        low, high = RANGES[rule.signal]
        return number, F.lit(None).cast("string"), F.coalesce(wrong, F.when(number.isNull(), "not a number").when(number < low, "below the range").when(number > high, "above the range"))
    if rule.signal == "event_time" and rule.conversion in ("ISO_TIME", "UNIX_SECONDS", "UNIX_MILLISECONDS"):
        usual = F.year(time).between(1, 9999)  # the text of such a time says the same time again
        wrong = F.coalesce(wrong, F.when(time.isNull(), "not a text").when(~usual & zoned(plain).isNull(), "no time with a zone"))
        return none, F.when(usual, plain).otherwise(iso(zoned(plain))), wrong
    wrong = F.coalesce(wrong, F.when(plain.isNull(), "not a text"))
    if rule.signal == "event_time":
        return none, iso(zoned(plain)), F.coalesce(wrong, F.when(zoned(plain).isNull(), "no time with a zone"))
    if rule.signal in CHOICES:
        wrong = F.coalesce(wrong, F.when(~plain.isin(*CHOICES[rule.signal]), "not one of its values"))
    return none, plain, wrong


def evaluate(payloads: DataFrame, repair: RepairConfig) -> DataFrame:
    """Adds fields, errors, warnings, success and a column a signal to the payloads.

    ``fields``: of each rule its signal, the first of its sources that is there and not null, that value as text, what it
    became and a status: mapped, missing (with a warning), or blocked (with an error). What holds for the whole: the
    discriminator must have its value, an event time and one more signal must be mapped, and both coordinates or neither.
    A payload that is no JSON object has this one error and nothing else.
    """
    sources = [list(r.sources) for r in repair.rules] + ([[repair.discriminator[0]]] if repair.discriminator else [])
    texts = {n for n, r in enumerate(repair.rules) if r.conversion == "ENUM_MAP"} | {len(repair.rules)}
    parsed = payloads.withColumn("parsed", F.try_parse_json("payload")).withColumn("shape", F.substring(F.schema_of_variant("parsed"), 1, 6))
    rows = first_found(parsed, sources, texts)
    at = lambda n: [F.col(f"{c}_{n}") for c in ("kind", "text", "number")]
    rows = rows.withColumns({f"time_{n}": _time(rule, *at(n)) for n, rule in enumerate(repair.rules)})
    made: dict[str, Column] = {}
    for n, rule in enumerate(repair.rules):
        number, text, wrong = _ruled(rule, *at(n), F.col(f"time_{n}"))
        made |= {f"became_{n}": number, f"said_{n}": text, f"wrong_{n}": wrong}
    rows = apart(rows, made)
    fields, errors, warnings, values = [], [], [], {}
    for n, rule in enumerate(repair.rules):
        there, wrong = F.col(f"value_{n}").isNotNull(), F.col(f"wrong_{n}")
        message = F.when(there, wrong).otherwise("required, but missing" if rule.required else "unavailable")
        status = F.when(~there, "blocked" if rule.required else "missing").when(wrong.isNotNull(), "blocked").otherwise("mapped")
        number, text = (F.when(there & wrong.isNull(), F.col(f"{c}_{n}")) for c in ("became", "said"))
        fields.append(F.struct(F.lit(rule.signal).alias("signal"), F.col(f"source_{n}").alias("source"), F.try_variant_get(f"value_{n}", "$", "string").alias("raw"), number.alias("number"), text.alias("text"), status.alias("status"), message.alias("message")))
        named = F.concat(F.lit(f"{rule.signal}: "), message)
        errors.append(F.when(status == "blocked", named))
        warnings.append(F.when(status == "missing", named))
        values[rule.signal] = number if rule.signal in NUMERIC else text
    nothing = {s: F.lit(None).cast("double" if s in NUMERIC else "string") for s in SIGNALS}
    values = nothing | values
    sort = F.coalesce(F.col(f"text_{len(repair.rules)}"), F.lit("null")) == repair.discriminator[1] if repair.discriminator else F.lit(True)
    before = [F.when(~sort, "discriminator: another value")] if repair.discriminator else []
    after = [
        F.when(values["event_time"].isNull(), "event_time: not mapped"), F.when(values["latitude"].isNull() != values["longitude"].isNull(), "position: half of it"),
        F.when(F.coalesce(*[v.cast("string") for s, v in values.items() if s != "event_time"]).isNull(), "signals: none mapped"),
    ]
    whole = F.coalesce(F.col("shape") == "OBJECT", F.lit(False))
    told = {
        "errors": F.when(whole, F.array_compact(F.array(*before, *errors, *after))).otherwise(F.array(F.lit("payload: not a JSON object"))),
        "warnings": F.when(whole, F.array_compact(F.array(*warnings))).otherwise(F.array().cast("array<string>")),
    }
    each = [f"{c}_{n}" for n in range(len(repair.rules)) for c in ("value", "source", "became", "said", "wrong")]
    out = once(rows, [*payloads.columns, "shape", *each], told)
    listed = F.when(whole, F.array(*fields)).otherwise(F.array().cast(_FIELD)).alias("fields")  # made for those who ask for them
    return out.select(*payloads.columns, listed, "errors", "warnings", *[F.when(whole, v).alias(s) for s, v in values.items()], (F.size("errors") == 0).alias("success"))


SECRETS = ("password", "secret", "token", "authorization", "api_key", "apikey", "credential")
_WORDS = "|".join(SECRETS)


def valid_path(path: Column) -> Column:
    """Up to 200 characters, no empty step, no step of an object's own machinery, none that names a secret."""
    bad = F.exists(F.split(path, r"\."), lambda p: (F.length(p) == 0) | p.isin("__proto__", "prototype", "constructor") | F.lower(p).rlike(_WORDS))
    return F.coalesce(F.length(path).between(1, 200) & ~bad, F.lit(False))


def validate_rules(rules: DataFrame) -> DataFrame:
    """(repair_id, problem) of each set of rules: the first that is wrong with it, or null.

    ``rules``: a row a rule with repair_id, name, live_mode, position, signal, sources, conversion, required, codes (a map),
    scale, offset, discriminator_path, discriminator_value; what belongs to the whole set stands in each of its rows.
    """
    known = F.coalesce(F.col("signal").isin(*SIGNALS), F.lit(False))
    sources = F.coalesce(F.size("sources").between(1, 5) & F.forall("sources", valid_path), F.lit(False))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rule = (
        F.when(~known, "2 unknown signal").when(~sources, "3 sources")
        .when(~F.coalesce(F.col("conversion").isin(*CONVERSIONS), F.lit(False)) | F.col("required").isNull(), "4 conversion")
        .when((F.col("signal") == "event_time") & ~F.col("required"), "5 event time must be required")
        .when((F.col("conversion") == "ENUM_MAP") & ~F.coalesce((F.size("codes") <= 100) & F.forall(F.map_values("codes"), lambda v: v.isNotNull()), F.lit(False)), "6 codes")
        .when((F.col("conversion") == "SCALE_OFFSET") & ~(finite("scale") & finite("offset")), "7 scale")
    )
    named = F.length(F.trim("name")).between(1, 100) & (F.length("name") <= 100)
    path, value = F.col("discriminator_path"), F.col("discriminator_value")
    filter_ = F.when(path.isNotNull() & ~F.coalesce(valid_path(path) & F.length(value).between(1, 100), F.lit(False)), "filter")
    whole = rules.groupBy("repair_id").agg(
        F.first(F.coalesce(named, F.lit(False))).alias("named"), F.first(F.coalesce(F.col("live_mode").isin(*LIVE_MODES), F.lit(False))).alias("mode"), F.count("*").alias("n"),
        F.count_distinct("signal").alias("signals"), F.min(F.when(rule.isNotNull(), F.struct("position", rule.alias("problem")))).alias("first"),
        F.max(F.col("signal") == "event_time").alias("timed"), F.first(filter_).alias("filter"),
    )
    problem = (
        F.when(~F.col("named"), "name").when(~F.col("mode"), "live mode").when(~F.col("n").between(2, 50), "number of rules").when(F.col("first").isNotNull(), F.substring("first.problem", 3, 100))
        .when(F.col("signals") < F.col("n"), "signal mapped twice").when(~F.coalesce("timed", F.lit(False)), "no event time").otherwise(F.col("filter"))
    )
    return whole.select("repair_id", problem.alias("problem"))

