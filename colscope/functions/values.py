"""Result values as comparable (tag, val) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "struct<tag:string,val:string>"


def _pair(tag: str, val: Column | None = None) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"),
        (F.lit(None).cast("string") if val is None else val).alias("val"),
    )


def _cents(exact: Column) -> Column:
    """Half-even to two places; minus zero reads as zero."""
    rounded = F.bround(exact, 2)
    return F.when(rounded == 0, F.lit("0.00")).otherwise(
        rounded.cast("decimal(38,2)").cast("string")
    )


def _double_cents(column: Column) -> Column:
    """A double's cents by its shortest text. From 1e19 on that text has an exponent and the
    number is whole: its digits, zeros up to the exponent, and no cents."""
    text = column.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.", "")
    length = F.regexp_extract(text, r"E([0-9]+)$", 1).try_cast("int") + 1
    whole = F.concat(
        F.regexp_extract(text, "^(-?)", 1),
        F.substring(digits, F.lit(1), length),
        F.repeat(F.lit("0"), length - F.length(digits)),
        F.lit(".00"),
    )
    wide = F.abs(column.cast("double")) >= F.lit(1e19)
    return F.when(wide, whole).otherwise(_cents(text.try_cast("decimal(38,18)")))


def _decimal_cents(column: Column, scale: int) -> Column:
    """A decimal's cents. One of two places or fewer is padded, so no width overflows; one of
    more has at most 35 digits before the point."""
    if scale > 2:
        return _cents(column)
    return F.concat(column.cast("string"), F.lit((".00", "0", "")[scale]))


def normalized_value(column: Column, data_type: T.DataType) -> Column:
    """A value as what the comparison sees, by its declared type.

    Null equals null only; a boolean is no number; numbers round half-even to cents, a
    float through its shortest text; text is trimmed; dates compare as ISO text; a list or
    a struct equals nothing. A type the comparison doesn't name is tagged unsupported.
    """
    if isinstance(data_type, T.BooleanType):
        pair = _pair("bool", column.cast("string"))
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        as_double = column.cast("double")
        pair = (
            F.when(F.isnan(as_double), _pair("nonfinite", F.lit("NaN")))
            .when(as_double == float("inf"), _pair("nonfinite", F.lit("Infinity")))
            .when(as_double == float("-inf"), _pair("nonfinite", F.lit("-Infinity")))
            .otherwise(_pair("number", _double_cents(column)))
        )
    elif isinstance(data_type, T.DecimalType):
        pair = _pair("number", _decimal_cents(column, data_type.scale))
    elif isinstance(data_type, T.IntegralType):
        pair = _pair("number", F.concat(column.cast("string"), F.lit(".00")))
    elif isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        pair = _pair("string", F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    elif isinstance(data_type, T.DateType):
        pair = _pair("string", F.date_format(column, "yyyy-MM-dd"))
    elif isinstance(data_type, T.TimestampType):
        pair = _pair("string", F.concat(_iso(column), F.lit("+00:00")))
    elif isinstance(data_type, T.TimestampNTZType):
        pair = _pair("string", _iso(column))
    elif isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        pair = _pair("composite")
    else:
        pair = _pair("unsupported", F.lit(data_type.simpleString()))
    return F.when(column.isNull(), _pair("null")).otherwise(pair).cast(VALUE)


def _iso(column: Column) -> Column:
    """ISO text; the fraction shows six digits when there is one, as ISO printers do."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(column, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
