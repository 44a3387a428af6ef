"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = "".join(
    chr(code)
    for code in (
        0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
_FIELD = "[^" + WHITESPACE + "]+"
_ZERO_TIME = "0001-01-01 00:00:00Z"
_RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def fields(text: Column) -> Column:
    """The runs of text between Unicode white space."""
    return F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0))


def first_field(text: Column) -> Column:
    """First white-space separated field, or the empty string."""
    return F.regexp_extract(text, _FIELD, 0)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(items: Column) -> Column:
    return F.array_join(items, "\n")


def base_name(path: Column) -> Column:
    """Last path element; a path of only slashes gives ``/``."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(F.substring_index(bare, "/", -1))


def head_bytes(text: Column, n: Column | int) -> Column:
    """The first ``n`` bytes of ``text``; may end inside a character."""
    return F.substring(text.cast("binary"), F.lit(1), F.lit(n)).cast("string")


def parse_int(text: Column) -> Column:
    """Decimal integer; 0 when malformed, clamped when out of range."""
    well_formed = text.rlike(r"^[+-]?[0-9]+\z")
    clamped = F.when(
        text.startswith("-"), F.lit(-(2**63)).cast("long")
    ).otherwise(F.lit(2**63 - 1).cast("long"))
    return F.when(well_formed, F.coalesce(text.try_cast("long"), clamped)).otherwise(
        F.lit(0).cast("long")
    )


def decode_base64(text: Column) -> Column:
    """Standard padded base64 to text; NULL when malformed."""
    bare = F.translate(text, "\r\n", "")
    well_formed = bare.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (
        F.length(bare) % 4 == 0
    )
    return F.when(
        well_formed, F.try_to_binary(bare, F.lit("base64")).cast("string")
    )


def parse_time(text: Column) -> Column:
    """RFC 3339 time with optional fraction; year 1 when malformed."""
    return F.coalesce(
        F.when(text.rlike(_RFC3339), F.translate(text, ",", "."))
        .try_cast("timestamp"),
        F.lit(_ZERO_TIME).cast("timestamp"),
    )


def clock(ts: Column) -> Column:
    """``HH:MM:SS`` in the session time zone, which is UTC."""
    return F.date_format(ts, "HH:mm:ss")


def utc_seconds(ts: Column) -> Column:
    """RFC 3339 UTC time with second precision."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
