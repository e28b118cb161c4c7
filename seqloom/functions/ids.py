"""UUID spellings and event ids.

Accepted spellings of a UUID: upper or lower case, with or without hyphens, in braces, with
``urn:uuid:`` in front, with white space around. Anything else is no UUID (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = (
    r"^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
)
WHITE = r"^\s+|\s+$"


def _bare(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, WHITE, ""))


def _digits(bare: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(bare, "^urn:uuid:", ""), "[{}-]", "")


def _usual(col: Column) -> Column:
    """The 16 bytes of a UUID of 32 digits and hyphens in the usual four places; null for any other text."""
    digits = F.replace(col, F.lit("-"), F.lit(""))
    form = (F.length(col) == 36) & (F.length(digits) == 32)
    for at in (9, 14, 19, 24):
        form &= F.substring(col, at, 1) == "-"
    return F.when(form, F.unhex(digits))


def uuid_key(col: Column) -> Column:
    """The 16 bytes of a UUID in any spelling; null for null, blank and other text.

    A text in the usual spelling takes a path without regular expressions; only what that path refuses is matched with them.
    """
    bare = _bare(col)
    return F.coalesce(_usual(col), F.when(bare.rlike(UUID_PATTERN), F.unhex(_digits(bare))))


def uuid_text(key: Column) -> Column:
    """Lower-case hyphenated text of the 16 bytes made by :func:`uuid_key`."""
    h = F.lower(F.hex(key))
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.when(key.isNotNull(), F.concat_ws("-", *(F.substring(h, a, n) for a, n in parts)))


def event_key_of(col: Column) -> Column:
    """Identity of an event: its UUID bytes, or for ids that are no UUID the trimmed text's bytes.

    Null and blank ids give null.
    """
    return F.coalesce(uuid_key(col), F.when(~is_blank(col), F.encode(F.regexp_replace(col, WHITE, ""), "UTF-8")))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return col.isNull() | ~col.rlike(r"\S")


def uuid7(ts: Column, *seed: Column) -> Column:
    """A UUID of version 7: the milliseconds of a time, then digits that follow from the ``seed``, so that one made again is the same."""
    digits = F.md5(F.concat_ws(":", *(s.cast("string") for s in seed)))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(digits, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts.cast("timestamp")))), 12, "0")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(digits, 1, 3), F.lit("-"), variant, F.substring(digits, 5, 3), F.lit("-"), F.substring(digits, 8, 12))
