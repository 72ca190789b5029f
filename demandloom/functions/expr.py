"""Column helpers shared by the operators. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def name_col(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_if_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL; other types are returned unchanged."""
    c = name_col(name)
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(c), c)
    return c


def is_empty(df: DataFrame, name: str) -> Column:
    """NULL, NaN or blank text. Zero and false are values."""
    c = name_col(name)
    dtype = df.schema[name].dataType
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (strip(c) == "")
    return c.isNull()


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a finite decimal literal becomes NULL.

    The cast ignores white space around the number. It also takes words (nan, inf), type suffixes and
    hexadecimal floats, all of which hold a letter other than the exponent's.
    """
    return F.when(~c.rlike("[A-DF-Za-df-z]"), c.try_cast("double"))


def as_double(df: DataFrame, name: str) -> Column:
    """A column of any scalar type as double, NULL where it is no number."""
    c = name_col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_number(c)
    return null_if_nan(df, name).try_cast("double")


def truncate(c: Column) -> Column:
    """Whole part toward zero as bigint."""
    return c.try_cast("double").try_cast("bigint")


def round_half_even(c: Column, digits: int) -> Column:
    """Decimal rounding of the exact binary value, ties to even (0.125 -> 0.12, 2.675 -> 2.67).

    ``round`` and ``bround`` work on the shortest decimal text of the double and so differ on
    such values. Meant for result columns, since it goes through text.
    """
    exact = F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).try_cast("double")
    if digits == 0:
        return exact
    # number formatting drops 5e-05 at 4 digits, where no digit is left to round
    return F.when(F.abs(c) < 10.0**-digits, F.round(c, digits)).otherwise(exact)


def fixed_text(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def percent_text(c: Column, digits: int) -> Column:
    return F.concat(fixed_text(c, digits), F.lit("%"))


def exact_text(value: Column, dtype: T.DataType) -> Column:
    """A text that is equal exactly for equal values and never NULL.

    Parts are prefixed with their length, so no two lists of parts run together. NaN counts as
    missing, minus zero as zero; timestamps keep their microseconds.
    """
    if isinstance(dtype, T.StructType):
        text = F.concat(*[exact_text(value.getField(f.name), f.dataType) for f in dtype.fields]) if dtype.fields else F.lit("")
    elif isinstance(dtype, T.ArrayType):
        text = F.array_join(F.transform(value, lambda v: exact_text(v, dtype.elementType)), "")
    elif isinstance(dtype, T.MapType):
        entry = lambda e: F.concat(exact_text(e["key"], dtype.keyType), exact_text(e["value"], dtype.valueType))
        text = F.array_join(F.sort_array(F.transform(F.map_entries(value), entry)), "")
    elif isinstance(dtype, T.VariantType):
        text = F.to_json(value)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(value.cast("timestamp")).cast("string")
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(value)
    elif is_floating(dtype):
        text = F.when(~F.isnan(value), (value + F.lit(0).cast(dtype)).cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(df: DataFrame, names: list[str] | None = None) -> Column:
    """128-bit digest of some columns, all by default; equal values, missing ones included, have equal digests."""
    fields = [df.schema[n] for n in (names if names is not None else df.columns)]
    return F.md5(F.concat(F.lit(""), *[exact_text(name_col(f.name), f.dataType) for f in fields]))


def is_json_container(c: Column) -> Column:
    """True when the text is one JSON object or array.

    The JSON parser stops after the first value, so the text is parsed wrapped in brackets and
    must then be an array of exactly one element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    looks = c.rlike(r"^\s*[\[{]")
    return looks & wrapped.isNotNull() & single
