"""Untidy text to typed values, as Column expressions; no value gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Digit groups may be parted by these (fixed values): comma, underscore, apostrophes, plain and typographic blanks.
GROUP_MARKS = r"[,_'\u2019 \u00a0\u2009\u202f]"
WHOLE = rf"^[+-]?([0-9]+|[0-9]{{1,3}}({GROUP_MARKS}[0-9]{{3}})+)(\.0*)?$"
SCIENTIFIC = r"^[+-]?[0-9]+(\.[0-9]*)?e[+-]?[0-9]{1,2}$"
HEX = r"^[+-]?0x[0-9a-f]{1,16}$"
INSTANT = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})[t ]([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)? ?(z|utc|gmt|[+-][0-9]{2}(?::?[0-9]{2})?)$"


def trimmed(x: Column) -> Column:
    """Without outer blanks of any kind (Spark's own trim knows the space only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def to_bigint(x: Column) -> Column:
    """A whole number in 64 bits: signs, leading zeros, digit groups, .00, exponents, hexadecimal."""
    t = F.regexp_replace(F.lower(trimmed(x)), "\u2212", "-")
    plain = F.regexp_replace(F.regexp_replace(t, GROUP_MARKS, ""), r"\.0*$", "").try_cast("decimal(38,0)")
    sci = t.try_cast("decimal(38,10)")
    sci = F.when(sci == F.floor(sci), sci).cast("decimal(38,0)")
    hexa = F.conv(F.regexp_replace(t, r"^[+-]?0x", ""), 16, 10).try_cast("decimal(38,0)") * F.when(t.startswith("-"), -1).otherwise(1)
    return F.when(t.rlike(WHOLE), plain).when(t.rlike(SCIENTIFIC), sci).when(t.rlike(HEX), hexa.cast("decimal(38,0)")).try_cast("bigint")


def to_instant(x: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO-like text with an offset; null if there is no such instant."""
    t = F.lower(trimmed(x))
    part = lambda i: F.regexp_extract(t, INSTANT, i)
    zone = part(8)
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    offset = F.when(zone.isin("z", "utc", "gmt"), F.lit("+00:00")).otherwise(F.concat(zone.substr(1, 1), digits.substr(1, 2), F.lit(":"), digits.substr(3, 2)))
    second = F.when(part(6) == "", F.lit("00")).otherwise(part(6))
    iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), second, F.lit("."), F.rpad(part(7), 6, "0").substr(1, 6), offset)
    return F.when(t.rlike(INSTANT), F.unix_micros(iso.try_cast("timestamp")))


def to_boolean(x: Column) -> Column:
    """1 or 0 for true/false, yes/no, 1/0 in any letter case."""
    t = F.lower(trimmed(x))
    return F.when(t.isin("true", "yes", "1"), F.lit(1)).when(t.isin("false", "no", "0"), F.lit(0)).cast("bigint")


def to_text(x: Column) -> Column:
    """The trimmed text; an empty one denotes nothing."""
    t = trimmed(x)
    return F.when(t != "", t)
