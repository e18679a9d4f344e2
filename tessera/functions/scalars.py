"""Time, number, decimal, binary and text functions."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, MapType, NumericType, StringType, StructType

# Limits of 64-bit integers and the Julian day of 1970-01-01.
INT64_MIN, INT64_MAX, UINT32_MAX, EPOCH_JULIAN = -(1 << 63), (1 << 63) - 1, (1 << 32) - 1, 2440588
DAY_NANOS = 86_400_000_000_000
UNITS = {"seconds": 1, "millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}


def clamp(x: Column, low: int = INT64_MIN, high: int = INT64_MAX) -> Column:
    wide = x.cast("decimal(38,0)")
    return F.greatest(F.least(wide, F.lit(high).cast("decimal(38,0)")), F.lit(low).cast("decimal(38,0)")).cast("bigint")


def saturating_mul(a: Column, b: Column) -> Column:
    """Product of 64-bit integers, held to their range."""
    product = F.try_multiply(a.cast("decimal(19,0)"), b.cast("decimal(19,0)"))
    return clamp(product)


def convert_time(x: Column, unit: str, to: str) -> Column:
    """A timestamp number in another unit: saturating up, truncating toward zero down."""
    a, b = UNITS[unit], UNITS[to]
    if b >= a:
        return saturating_mul(x.cast("bigint"), F.lit(b // a).cast("bigint"))
    return F.call_function("div", x.cast("bigint"), F.lit(a // b).cast("bigint"))


def date_from_days(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def time_from_hms(h: Column, m: Column, s: Column, sub: Column, unit: str = "micros") -> Column:
    """Time of day as a number of units, saturating."""
    return clamp(((h.cast("decimal(20,0)") * 3600 + m * 60 + s) * UNITS[unit] + sub).cast("decimal(38,0)"))


def int96_days(nanos: Column) -> Column:
    """Julian day of the nanoseconds since 1970."""
    return (F.floor(nanos.cast("decimal(20,0)") / DAY_NANOS) + EPOCH_JULIAN).cast("bigint")


def int96_nanos_of_day(nanos: Column) -> Column:
    return F.pmod(nanos.cast("bigint"), F.lit(DAY_NANOS))


def int96_to_nanos(day: Column, nanos_of_day: Column) -> Column:
    return clamp(((day.cast("decimal(12,0)") - EPOCH_JULIAN) * F.lit(DAY_NANOS).cast("decimal(16,0)") + nanos_of_day).cast("decimal(38,0)"))


def interval_from(count: Column, millis_each: int) -> Column:
    """Milliseconds of an interval of hours, minutes or seconds, held to 32 bits unsigned."""
    return clamp(count.cast("decimal(20,0)") * millis_each, 0, UINT32_MAX)


def interval_bytes(months: Column, days: Column, millis: Column) -> Column:
    """Three little-endian unsigned 32-bit integers; null if one doesn't fit."""
    parts = [x.cast("bigint") for x in (months, days, millis)]
    raw = F.concat(*[F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])) for x in parts])
    return F.when((F.least(*parts) >= 0) & (F.greatest(*parts) <= UINT32_MAX), raw)


def interval_parts(raw: Column) -> Column:
    """struct<months, days, millis> of 12 bytes."""
    number = lambda at: F.conv(F.concat(*[F.hex(F.substring(raw, at + k, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    return F.struct(number(1).alias("months"), number(5).alias("days"), number(9).alias("millis"))


def interval_words(months: Column, days: Column, millis: Column) -> Column:
    """Any 64-bit parts as a list of intervals of 12 bytes: one, or the lower and the upper halves where some part needs more than 32 bits."""
    parts = [x.cast("bigint") for x in (months, days, millis)]
    upper = [F.shiftrightunsigned(x, 32) for x in parts]
    low = interval_bytes(*[x.bitwiseAND(F.lit(UINT32_MAX)) for x in parts])
    return F.when(F.greatest(*upper) > 0, F.array(low, interval_bytes(*upper))).otherwise(F.array(low))


def interval_whole(words: Column) -> Column:
    """struct<months, days, millis> of a list that interval_words made."""
    low, high = (interval_parts(F.get(words, F.lit(k))) for k in (0, 1))
    return F.struct(*[F.shiftleft(F.coalesce(high[c], F.lit(0)), 32).bitwiseOR(low[c]).alias(c) for c in ("months", "days", "millis")])


def interval_text(months: Column, days: Column, millis: Column) -> Column:
    """ISO 8601 text such as P1M15DT1H; P0D for nothing."""
    part = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")
    whole = lambda n, d: F.floor(n / d)
    seconds, rest = whole(F.pmod(millis, F.lit(60000)), 1000), F.pmod(millis, F.lit(1000))
    second_text = F.when(rest > 0, F.concat(seconds.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("S"))).otherwise(part(seconds, "S"))
    time = F.concat(part(whole(millis, 3600000), "H"), part(whole(F.pmod(millis, F.lit(3600000)), 60000), "M"), second_text)
    text = F.concat(part(months, "M"), part(days, "D"), F.when(millis > 0, F.concat(F.lit("T"), time)).otherwise(""))
    return F.concat(F.lit("P"), F.when(text == "", "0D").otherwise(text))


HEX, FLIPPED = "0123456789ABCDEF", "FEDCBA9876543210"


def two_64() -> Column:
    return F.lit(str(1 << 64)).cast("decimal(20,0)")


def wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def point(digits: Column, scale: int) -> Column:
    """Digits of a whole number with the decimal point put in."""
    if not scale:
        return digits
    padded = F.when(F.length(digits) <= scale, F.lpad(digits, scale + 1, "0")).otherwise(digits)
    return F.concat(padded.substr(F.lit(1), F.length(padded) - scale), F.lit("."), F.right(padded, F.lit(scale)))


def decimal_from_bytes(raw: Column, precision: int, scale: int) -> Column:
    """Big-endian two's complement bytes as a decimal; no bytes are 0, more than 16 and values beyond the precision null."""
    digits = F.hex(raw)
    negative = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int") >= 8
    # -1 - x has the bits of x flipped, so both halves are numbers without a sign.
    full = F.lpad(F.when(negative, F.translate(digits, HEX, FLIPPED)).otherwise(digits), 32, "0")
    half = lambda at: wide(F.conv(F.substring(full, at, 16), 16, 10))
    size = F.try_add(F.try_multiply(half(1).cast("decimal(19,0)"), two_64()).cast("decimal(38,0)"), half(17))
    # A value of 38 nines fits, flipped it is one less, so the largest sizes are reached without overflow.
    whole = F.when(negative, F.try_add(size, F.lit(1).cast("decimal(1,0)"))).otherwise(size)
    text = F.concat(F.when(negative, "-").otherwise(""), point(whole.cast("string"), scale))
    return F.when(F.octet_length(raw) <= 16, text.try_cast(f"decimal({precision},{scale})"))


def decimal_to_bytes(x: Column, scale: int, size: int = 16, grow: bool = False) -> Column:
    """The unscaled integer of a decimal as big-endian two's complement bytes; if it needs more than `size`, null, or 16 bytes with `grow`."""
    text = x.cast(f"decimal(38,{scale})").cast("string")
    negative, size_of = text.startswith("-") & (x != 0), wide(F.regexp_replace(text, "[.-]", ""))
    bits = F.when(negative, size_of - F.lit(1).cast("decimal(1,0)")).otherwise(size_of).cast("decimal(38,0)")
    high = F.call_function("div", bits, two_64())
    low = bits - high.cast("decimal(19,0)") * two_64()
    digits = F.concat(*[F.lpad(F.conv(h.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0") for h in (high, low)])
    signed = F.when(negative, F.translate(digits, HEX, FLIPPED)).otherwise(digits)
    spare, first = F.left(signed, F.lit(32 - 2 * size)), F.conv(F.substring(signed, 33 - 2 * size, 1), 16, 10).cast("int") >= 8
    fits = (spare == F.when(negative, "F" * (32 - 2 * size)).otherwise("0" * (32 - 2 * size))) & (first == negative)
    kept = F.when(fits, F.right(signed, F.lit(2 * size)))
    return F.unhex(kept.otherwise(signed) if grow else kept)


def reverse_bytes(raw: Column) -> Column:
    """Little-endian bytes as big-endian ones, and the other way round."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))), ""))


def decimal_unscaled(x: Column, scale: int) -> Column:
    """The integer that a decimal of this scale stores, rounded half away from zero; held to 38 digits, NaN is the largest."""
    most = 10**38 - 1
    scaled = F.round(x.cast("double") * F.lit(float(10**scale)), 0)
    held = F.when(F.isnan(scaled) | (scaled >= 1e38), F.lit(str(most)).cast("decimal(38,0)")).when(scaled <= -1e38, F.lit(str(-most)).cast("decimal(38,0)"))
    return held.otherwise(scaled.try_cast("decimal(38,0)"))


def decimal_to_double(unscaled: Column, scale: int) -> Column:
    return unscaled.cast("double") / F.lit(float(10**scale))


def decimal_byte_length(precision: int) -> int:
    """Bytes that hold every unscaled value of a precision."""
    return next(n for n in range(1, 18) if (1 << (8 * n - 1)) > 10**precision - 1)


def narrow(x: Column, kind: str) -> Column:
    """The value in another type, or null where it doesn't fit."""
    return x.try_cast(kind)


def value_or(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))


def uuid_parse(text: Column) -> Column:
    """16 bytes of 36 characters with dashes before hex pairs; null if malformed."""
    return F.when(F.length(text) == 36, F.when(text.rlike(r"^(-*[0-9a-fA-F]{2}){16}$"), F.unhex(F.replace(text, F.lit("-"), F.lit("")))))


def uuid_text(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def float16(raw: Column) -> Column:
    """The float of two little-endian bytes."""
    bits = F.conv(F.concat(F.hex(F.substring(raw, 2, 1)), F.hex(F.substring(raw, 1, 1))), 16, 10).cast("int")
    sign = F.when(F.shiftright(bits, 15) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    special = F.when(fraction == 0, sign * float("inf")).otherwise(float("nan"))
    normal = sign * (1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15)
    return F.when(exponent == 31, special).when(exponent == 0, sign * fraction * 2.0**-24).otherwise(normal).cast("float")


def hex_text(raw: Column, prefix: str = "0x") -> Column:
    return F.concat(F.lit(prefix), F.lower(F.hex(raw)))


def printable_cell(text: Column) -> Column:
    """Whether a text has no control characters below 32 but tab, CR and LF."""
    return ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def printable_stat(text: Column) -> Column:
    """Whether a statistic is at most 100 bytes of printable ASCII."""
    return (F.octet_length(text) <= 100) & text.rlike(r"^[\x20-\x7E]*$")


def cell_text(text: Column) -> Column:
    """Text of more than 50 bytes as its first 47 bytes and three dots, what is left of a character being U+FFFD; others as hex if not printable."""
    short = F.make_valid_utf8(F.substring(text.cast("binary"), 1, 47).cast("string"))
    shown = F.when(F.octet_length(text) > 50, F.concat(short, F.lit("..."))).otherwise(text)
    return F.when(printable_cell(text), shown).otherwise(binary_cell(text.cast("binary")))


def binary_cell(raw: Column) -> Column:
    """Hex; of more than 16 bytes the first 16 and three dots."""
    return F.when(F.octet_length(raw) > 16, F.concat(F.lower(F.hex(F.substring(raw, 1, 16))), F.lit("..."))).otherwise(F.lower(F.hex(raw)))


def size_text(n: Column) -> Column:
    """1024-based sizes with one decimal."""
    shown = lambda power, unit: F.concat(F.format_string("%.1f", n / F.lit(float(1024**power))), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, shown(1, "KB")).when(n < 1024**3, shown(2, "MB")).otherwise(shown(3, "GB"))


def plain_number(x: Column) -> Column:
    """A finite float in its shortest digits without an exponent: 2.0 is 2, 1.0E-5 is 0.00001."""
    text = F.abs(x).cast("string")
    whole, fraction = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    digits, at = F.concat(whole, fraction), F.length(whole) + exponent  # the point stands behind so many digits
    left = F.when(at <= 0, "0").otherwise(F.rpad(F.left(digits, F.greatest(at, F.lit(0))), F.greatest(at, F.lit(0)), "0"))
    right = F.when(at <= 0, F.concat(F.repeat(F.lit("0"), -at), digits)).otherwise(F.substring(digits, at + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    negative = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.concat(negative, left, F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))


def float_text(x: Column) -> Column:
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(plain_number(x))


def json_string(text: Column) -> Column:
    """Quoted, with quotes, backslashes and control characters escaped."""
    out = text
    for c, e in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    rare = out
    for code in (c for c in range(32) if c not in (9, 10, 13)):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(printable_cell(text), out).otherwise(rare), F.lit('"'))


def value_text(x: Column, kind: DataType, json: bool = True) -> Column:
    """A value of any type as text: as JSON, or as nested text (`[a, b]`, `{k: v}`, strings quoted as they are).

    Infinite and NaN floats are words, quoted in JSON; binary is a string if it is printable UTF-8, else hex; map keys are
    text; dates, times and the like are quoted in Spark's own form. The result is never null.
    """
    quote = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    gap = "," if json else ", "
    if isinstance(kind, (FloatType, DoubleType)):
        out = F.when(F.isnan(x) | (F.abs(x) == float("inf")), quote(float_text(x))).otherwise(plain_number(x)) if json else float_text(x)
    elif isinstance(kind, BinaryType):
        text = x.cast("string")
        readable = F.is_valid_utf8(text) & printable_cell(text)
        out = F.when(readable, json_string(text) if json else quote(text)).otherwise(quote(F.lower(F.hex(x))))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: value_text(e, kind.elementType, json)), gap), F.lit("]"))
    elif isinstance(kind, MapType):
        named = isinstance(kind.keyType, (StringType, BinaryType))
        key = lambda k: value_text(k, kind.keyType, json) if named or not json else quote(value_text(k, kind.keyType, json))
        pairs = F.transform(F.map_entries(x), lambda e: F.concat(key(e["key"]), F.lit(":" if json else ": "), value_text(e["value"], kind.valueType, json)))
        out = F.concat(F.lit("{"), F.array_join(pairs, gap), F.lit("}"))
    elif isinstance(kind, StructType):
        name = lambda n: json_string(F.lit(n)) if json else F.lit(n)
        fields = [F.concat(name(f.name), F.lit(":" if json else ": "), value_text(x[f.name], f.dataType, json)) for f in kind]
        out = F.concat(F.lit("{"), F.concat_ws(gap, *fields), F.lit("}"))
    elif isinstance(kind, (NumericType, BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, StringType):
        out = json_string(x) if json else quote(x)
    else:
        out = quote(x.cast("string"))
    return F.coalesce(F.when(x.isNotNull(), out), F.lit("null"))


def nested_text(x: Column, kind: DataType) -> Column:
    return value_text(x, kind, json=False)


def cell(x: Column, kind: DataType) -> Column:
    """A table cell: nested text, but strings without quotes and cut, and binary as hex if it isn't printable."""
    if isinstance(kind, StringType):
        out = cell_text(x)
    elif isinstance(kind, BinaryType):
        out = F.when(F.is_valid_utf8(x.cast("string")), cell_text(x.cast("string"))).otherwise(binary_cell(x))
    elif isinstance(kind, (ArrayType, MapType, StructType, FloatType, DoubleType)):
        return nested_text(x, kind)
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("null"))


def ndjson(df) -> Column:
    """A row as one JSON object, null fields included."""
    fields = [F.concat(json_string(F.lit(f.name)), F.lit(":"), value_text(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def stat_text(raw: bytes | None, physical: str | None) -> str:
    """A statistic's bytes as text, by physical type; floats with four decimals, or with an exponent if very large or small."""
    if raw is None:
        return "null"
    shown = "0x" + raw.hex()
    forms = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}
    if physical in forms:
        size = struct.calcsize(forms[physical])
        if len(raw) < size:
            return shown
        (v,) = struct.unpack(forms[physical], raw[:size])
        if isinstance(v, int):
            return str(v)
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "-inf" if v < 0 else "inf"
        if abs(v) > 1e10 or (v and abs(v) < 1e-4):
            digits, power = f"{v:.4e}".split("e")
            return f"{digits}e{int(power)}"
        return f"{v:.4f}"
    if physical == "BOOLEAN":
        return ("true" if raw[0] else "false") if raw else "?"
    if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        if len(raw) <= 100 and all(0x20 <= b <= 0x7E for b in raw):
            return f'"{raw.decode()}"'
        return shown if len(raw) <= 16 else f"({len(raw)} bytes)"
    return f"({len(raw)} bytes)" if physical == "INT96" else shown
