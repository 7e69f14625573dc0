"""Column functions: distances, keys, geometry, labels, hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6_371_008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def centimetres(metres: Column) -> Column:
    return F.round(metres * 100).cast("long")


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A random order that depends on seed and keys only: hex md5 of them joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def coin(seed: int | str, *keys: Column) -> Column:
    """A fair coin by hash."""
    return F.substring(hash_order(seed, *keys), 1, 1) < "8"


def strip(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_key(text: Column) -> Column:
    """Lower-case, stripped; null is empty."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def brand_or_name_key(brand: Column, name: Column) -> Column:
    """The brand if it is not blank, else the name, as a key."""
    return text_key(F.coalesce(F.when(strip(brand) != "", brand), name, F.lit("")))


def nested_text(df_schema, path: str) -> Column:
    """A nested field as text; a flat column stands for its own leaf; null where the path does not exist."""
    at = df_schema
    for part in path.split("."):
        kind = getattr(at, "dataType", at)
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            head = path.split(".")[0]
            flat = hasattr(df_schema, "fieldNames") and head in df_schema.fieldNames() and not hasattr(df_schema[head].dataType, "fieldNames")
            return F.col(head).cast("string") if flat and "." in path else F.lit(None).cast("string")
        at = kind[part]
    return F.col(path).cast("string")


def first_item_field(items: Column, field: str) -> Column:
    """A field of the first list item; null for a null or empty list, row by row."""
    return F.get(items, F.lit(0))[field]


def _double(hex16: Column) -> Column:
    """The IEEE double of 16 hex digits, most significant first, by exact arithmetic."""
    hi = F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(hex16, 9, 8), 16, 10).cast("double")
    exponent = F.shiftright(hi, 20).bitwiseAND(F.lit(2047))
    fraction = hi.bitwiseAND(F.lit(1048575)).cast("double") * F.lit(2.0**32) + lo
    size = F.when(exponent == 0, fraction * F.lit(2.0**-1074)).otherwise(
        (F.lit(1.0) + fraction * F.lit(2.0**-52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
    return F.when(hi >= 2**31, -size).otherwise(size)


def _hex16(x: Column) -> Column:
    """The 16 hex digits of an IEEE double, most significant first, by exact arithmetic; null stays null."""
    size = F.abs(x)
    near = F.floor(F.log2(size))  # may be one off beside a power of two
    part = size / F.pow(F.lit(2.0), near)
    power = near + F.when(part < 1, -1).when(part >= 2, 1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size < F.lit(2.0**-1022), tiny).otherwise(F.shiftleft((power + 1023).cast("long"), 52) + fraction)
    return F.lpad(F.hex(F.when(x < 0, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)), 16, "0")


def point_wkb(lon: Column, lat: Column) -> Column:
    """A 21-byte little-endian WKB point of finite coordinates; null if one is null. A negative zero is written as zero."""
    turned = lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    return F.unhex(F.concat(F.lit("0101000000"), turned(_hex16(lon)), turned(_hex16(lat))))


def wkb_point(wkb: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a 21-byte little-endian WKB point; other geometries raise, null stays null."""
    hexed = F.hex(wkb)
    fine = (F.length(hexed) == 42) & (F.substring(hexed, 1, 10) == "0101000000")
    ordered = lambda at: F.concat(*[F.substring(hexed, at + 2 * k, 2) for k in range(7, -1, -1)])
    ask = lambda at: F.when(hexed.isNull(), F.lit(None).cast("double")).when(fine, _double(ordered(at))).otherwise(F.raise_error(F.lit("not a little-endian WKB point")).cast("double"))
    return ask(11), ask(27)


def parse_label(raw: Column, strict_compat: bool = False) -> Column:
    """MATCH, NO_MATCH or INVALID of a model's answer: one label alone, in any case, perhaps quoted, after "Answer:", with
    one mark behind. NOMATCH is NO_MATCH unless strict_compat, which reads it as MATCH."""
    bare = strip(F.regexp_replace(strip(raw), r"^[`\"']+|[`\"']+$", ""))
    label = F.upper(F.regexp_extract(bare, r"(?U)^(?i:answer\s*:\s*)?((?i:no[\s_-]?match|match))\s*[.!]?\s*$", 1))
    plain = F.regexp_replace(label, r"(?U)[\s-]", "_")
    no = (plain == "NO_MATCH") if strict_compat else plain.isin("NO_MATCH", "NOMATCH")
    return F.when(raw.isNull() | (label == ""), "INVALID").when(no, "NO_MATCH").otherwise("MATCH")


def shortened(text: Column, most: int = 70) -> Column:
    """One line for a reader: null or empty is a dash, long text ends in an ellipsis."""
    return F.when(text.isNull() | (text == ""), "-").when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def _filled(value: Column, kind: T.DataType) -> Column:
    """Whether a value says anything: not null, empty, zero or false."""
    if isinstance(kind, T.ArrayType | T.MapType):
        said = F.size(value) > 0
    elif isinstance(kind, T.StringType | T.BinaryType):
        said = F.length(value) > 0
    elif isinstance(kind, T.BooleanType):
        said = value
    else:
        said = value != 0 if isinstance(kind, T.NumericType) else value.isNotNull()
    return F.coalesce(said, F.lit(False))


def one_line(value: Column, kind: T.DataType, preferred: tuple[str, ...] = (), most: int = 70) -> Column:
    """A nested value of a type as one line for a reader: the first item of a list, of a struct or map the first preferred key
    that says anything, else the first of all; a dash where there is none."""
    shown = lambda v, k, keys=(): one_line(v, k, keys, most)
    if isinstance(kind, T.ArrayType):
        return shown(F.get(value, F.lit(0)), kind.elementType, preferred)
    if isinstance(kind, T.StructType):
        fields = [*[k for k in preferred if k in kind.fieldNames()], *kind.fieldNames()]
        return F.coalesce(*[F.when(_filled(value[k], kind[k].dataType), shown(value[k], kind[k].dataType)) for k in fields], F.lit("-"))
    if isinstance(kind, T.MapType):
        wanted = [F.try_element_at(value, F.lit(k)) for k in preferred if isinstance(kind.keyType, T.StringType)]
        anything = F.get(F.filter(F.map_values(value), lambda v: _filled(v, kind.valueType)), F.lit(0))
        return F.coalesce(*[F.when(_filled(v, kind.valueType), shown(v, kind.valueType)) for v in wanted], shown(anything, kind.valueType))
    return shortened(value.cast("string"), most)


def row_name(index: Column) -> Column:
    """row_000000 and on; longer numbers are not cut."""
    digits = index.cast("string")
    return F.concat(F.lit("row_"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))
