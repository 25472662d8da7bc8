"""Webhook signatures, redaction and inspection of JSON payloads."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRET_WORDS = ("password", "secret", "token", "authorization", "api_key", "apikey", "credential")
MAX_DEPTH, MAX_FIELDS = 12, 200


def sign(body: str, secret: str) -> str:
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


@F.pandas_udf(T.BooleanType())
def signature_valid(body: pd.Series, signature: pd.Series, secret: pd.Series) -> pd.Series:
    """Compares HMAC-SHA256 in constant time; a prefix sha256= is allowed."""
    return pd.Series([b is not None and s is not None and hmac.compare_digest(sign(b, k), s.removeprefix("sha256=")) for b, s, k in zip(body, signature, secret, strict=True)])


def vehicle_reference(payload: Column) -> Column:
    """The first of the fields that name the vehicle."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in ("vehicle_id", "vehicle_identifier", "vin", "data.vehicle_id")])


SIGNATURE_HEADERS = ("x-signature-sha256", "x-signature", "x-vendor-signature")
VEHICLE_FIELDS = ("vehicle_identifier", "source_vehicle_id", "vehicle_id", "id")
EVENT_FIELDS = ("event_id", "source_event_id")


def _first(*values: Column) -> Column:
    """The first that is there and not empty."""
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in values])


def webhook(requests: DataFrame, connections: DataFrame, mappings: DataFrame, headers: tuple[str, ...] = SIGNATURE_HEADERS) -> DataFrame:
    """Adds problem (null: accepted), source_vehicle_id and source_event_id to webhook requests.

    ``requests``: connection_id, headers (a map with names in lower case) and body; ``connections``: connection_id and the
    secret of its subscription, null without one; ``mappings``: the (connection_id, source_vehicle_id) that are known. A
    vehicle must not be known of another connection and, where a connection knows any vehicles, be one of them. The event's
    id is the body's or, without one, the header's.
    """
    known = connections.select("connection_id", "secret", F.lit(True).alias("exists")).distinct()
    vehicle = _first(*[F.get_json_object("body", f"$.{f}") for f in VEHICLE_FIELDS])
    event = _first(*[F.get_json_object("body", f"$.{f}") for f in EVENT_FIELDS], F.try_element_at("headers", F.lit("x-event-id")))
    rows = requests.withColumns({"source_vehicle_id": vehicle, "source_event_id": event, "signature": F.trim(_first(*[F.try_element_at("headers", F.lit(h)) for h in headers]))})
    rows = rows.join(known, "connection_id", "left").withColumn("signed", signature_valid(F.col("body"), F.col("signature"), F.coalesce("secret", F.lit(""))))
    mappings = mappings.select("connection_id", "source_vehicle_id").distinct()
    owners = mappings.groupBy("source_vehicle_id").agg(F.count("*").alias("owners"))
    own = mappings.withColumn("own", F.lit(1))
    busy = mappings.select("connection_id", F.lit(True).alias("busy")).distinct()
    rows = rows.join(owners, "source_vehicle_id", "left").join(own, ["connection_id", "source_vehicle_id"], "left").join(busy, "connection_id", "left")
    others = F.coalesce("owners", F.lit(0)) > F.coalesce("own", F.lit(0))
    problem = (
        F.when(F.col("exists").isNull(), "404 no such connection").when(F.coalesce(F.length("secret"), F.lit(0)) == 0, "401 no subscription").when(F.col("signature").isNull(), "401 no signature").when(~F.col("signed"), "401 wrong signature")
        .when(F.col("source_vehicle_id").isNull(), "400 no vehicle").when(others, "403 of another connection").when(F.col("busy") & F.col("own").isNull(), "403 not of this connection")
    )
    return rows.select(*requests.columns, problem.alias("problem"), "source_vehicle_id", "source_event_id")


def _redact(value, hide: bool = False):
    if isinstance(value, dict):
        return {k: _redact(v, hide or any(w in k.lower() for w in SECRET_WORDS)) for k, v in value.items()}
    if isinstance(value, list):
        return [_redact(v, hide) for v in value]
    return "[REDACTED]" if hide else value


@F.pandas_udf(T.StringType())
def redact(payload: pd.Series) -> pd.Series:
    """The payload with every value under a secret's name hidden, at any depth."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_redact(json.loads(text)), separators=(",", ":"))
        except ValueError:
            return "[UNREADABLE]"

    return payload.map(one, na_action=None)


def inspect_fields(payloads: DataFrame) -> DataFrame:
    """(path, type, example) of the fields of each payload, at most MAX_FIELDS of a depth of MAX_DEPTH."""

    def walk(value, path: str, depth: int, out: list) -> None:
        if len(out) >= MAX_FIELDS or depth > MAX_DEPTH:
            return
        if isinstance(value, dict | list):
            for k, v in value.items() if isinstance(value, dict) else enumerate(value):
                walk(v, f"{path}.{k}" if path else str(k), depth + 1, out)
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"
            out.append((path, kind, json.dumps(value)))

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["event_id"], b["payload"], strict=True):
                found: list = []
                try:
                    walk(json.loads(text), "", 0, found)
                except (TypeError, ValueError):
                    pass
                rows += [(key, *f) for f in found]
            yield pd.DataFrame(rows, columns=["event_id", "path", "type", "example"])

    return payloads.select("event_id", "payload").mapInPandas(run, "event_id long, path string, type string, example string")
