"""Rules and functions of the event envelope: namespaces, validators, payloads, times and cursors.

All are Column expressions; null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# patterns of valid parts (fixed values)
ORGANIZATION = r"^[a-z0-9_-]+$"
NAMESPACE = r"^(/|(/[A-Za-z0-9_-]+)+)$"
TOPIC = r"^[a-z0-9_-]+(\.[a-z0-9_-]+)*$"
METADATA_KEY = r"^[A-Za-z0-9]([A-Za-z0-9_.:/-]*[A-Za-z0-9])?$"
CONSUMER_GROUP = r"^[a-z0-9_-]{1,64}$"
STREAM = r"^[A-Za-z0-9_.-]{1,128}$"
OWNER = r"^[A-Za-z0-9_.:-]{1,128}$"
CONTENT_TYPES = ["application/json", "text/plain", "application/octet-stream"]
KEY_BYTES = 1024
METADATA_KEY_BYTES = 128


def namespace_of(text: Column) -> Column:
    """Normal form: empty text and "/" are the root, a missing leading slash is added."""
    return F.when(text.isin("", "/"), F.lit("/")).when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))


def namespace_parent(ns: Column) -> Column:
    """The namespace above; the root has none (null)."""
    cut = F.regexp_replace(ns, "/[^/]*$", "")
    return F.when(ns == "/", F.lit(None)).when(cut == "", F.lit("/")).otherwise(cut)


def namespace_depth(ns: Column) -> Column:
    """Number of parts; 0 for the root."""
    return F.when(ns == "/", F.lit(0)).otherwise(F.size(F.split(ns, "/")) - 1)


def namespace_within(ns: Column, prefix: str) -> Column:
    """Whether a namespace is ``prefix`` or below it, by whole parts. Patterns with ``LIKE`` won't do: ``_`` is a legal character."""
    if prefix == "/":
        return ns.isNotNull()
    return (ns == prefix) | ns.startswith(prefix + "/")


def namespace_scoped(ns: Column, scope: str) -> Column:
    """``scope`` put in front of a namespace."""
    return F.when(ns == "/", F.lit(scope)).otherwise(F.concat(F.lit(scope), ns))


def envelope_error(organization: Column, namespace: Column, topic: Column, key: Column, content_type: Column, metadata: Column) -> Column:
    """Name of the first part that breaks a rule, null for a valid envelope. A null part breaks its rule."""
    bad_key = F.exists(F.map_keys(metadata), lambda k: ~k.rlike(METADATA_KEY) | (F.octet_length(k) > METADATA_KEY_BYTES))
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(fails(organization.rlike(ORGANIZATION)), "organization")
        .when(fails(namespace.rlike(NAMESPACE)), "namespace")
        .when(fails(topic.rlike(TOPIC)), "topic")
        .when(fails(F.octet_length(key).between(1, KEY_BYTES)), "key")
        .when(fails(content_type.isin(CONTENT_TYPES)), "content_type")
        .when(F.coalesce(bad_key, F.lit(False)), "metadata_key")
    )


def rfc3339(ts: Column) -> Column:
    """A time without zone, taken as UTC, as RFC 3339 text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_rfc3339(text: Column) -> Column:
    """The time, without zone, of RFC 3339 text in UTC; null for other text."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")).cast("timestamp_ntz")


def order_bytes(position: Column) -> Column:
    """8 bytes, big-endian with the sign bit flipped, whose byte order is the order of the positions."""
    flipped = position.bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def is_object(payload: Column) -> Column:
    """Whether text is a readable JSON object; false for null."""
    return F.coalesce(payload.rlike(r"^\s*\{") & F.try_parse_json(payload).isNotNull(), F.lit(False))


def backoff_ms(attempt: Column, base: float = 100, multiplier: float = 2.0, most: float = 30_000) -> Column:
    """Delay after a failed attempt: grows by the multiplier up to the most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(multiplier)), attempt - 1), F.lit(float(most)))


def encoded_cursor(cursor_id: Column, kind: Column, position: Column) -> Column:
    """A cursor as a struct of id, kind, order bytes and payload (JSON in base64), in a form that any reader can store."""
    payload = F.base64(F.to_json(F.struct(position.alias("sequence"))))
    return F.struct(cursor_id.alias("id"), kind.alias("kind"), order_bytes(position).alias("order"), payload.alias("payload"))


def cursor_error(cursor: Column, kind: str) -> Column:
    """Why an encoded cursor can't be used by a reader of this kind; null where it can."""
    text = F.decode(F.try_to_binary(cursor["payload"], F.lit("base64")), "UTF-8")
    said = F.try_variant_get(F.try_parse_json(text), "$.sequence", "bigint")
    wrong = F.concat(F.lit(f"expected cursor kind {kind}, got "), F.coalesce(cursor["kind"], F.lit("none")))
    return F.when(~F.coalesce(cursor["kind"] == kind, F.lit(False)), wrong).when(said.isNull(), "cursor payload is unreadable")


def decoded_cursor(cursor: Column, kind: str) -> Column:
    """The position of an encoded cursor of this kind; null where :func:`cursor_error` tells why not."""
    text = F.decode(F.try_to_binary(cursor["payload"], F.lit("base64")), "UTF-8")
    return F.when(cursor["kind"] == kind, F.try_variant_get(F.try_parse_json(text), "$.sequence", "bigint"))


def payload_text(payload: Column, content_type: Column) -> Column:
    """A payload as text: base64 undone for binary content; null where that fails."""
    raw = F.try_to_binary(F.regexp_replace(payload, r"\s", ""), F.lit("base64"))
    return F.when(content_type == "application/octet-stream", F.try_validate_utf8(raw.cast("string"))).otherwise(payload)
