"""The seven column types: their Spark types, literals, and the integer forms of DECIMAL, ENUM, DATE, DATETIME."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError

INT, DECIMAL, VARCHAR, ENUM, BOOL, DATE, DATETIME = "INT", "DECIMAL", "VARCHAR", "ENUM", "BOOL", "DATE", "DATETIME"
NAMES = {"INT": INT, "INTEGER": INT, "DECIMAL": DECIMAL, "VARCHAR": VARCHAR, "ENUM": ENUM, "BOOL": BOOL, "BOOLEAN": BOOL, "DATE": DATE, "DATETIME": DATETIME}
#: Bytes of a value in a fixed-width row; VARCHAR adds its length to 2.
WIDTH = {INT: 4, DECIMAL: 8, VARCHAR: 2, ENUM: 1, BOOL: 1, DATE: 4, DATETIME: 8}
MAX_VARCHAR, MAX_PRECISION = 150, 18


def spark_type(kind: str, length: int = 0, scale: int = 0) -> T.DataType:
    if kind == DECIMAL:
        return T.DecimalType(min(length or MAX_PRECISION, MAX_PRECISION), scale)
    return {INT: T.IntegerType(), VARCHAR: T.StringType(), ENUM: T.ByteType(), BOOL: T.BooleanType(), DATE: T.DateType(), DATETIME: T.TimestampNTZType()}[kind]


def _date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value)
    return dt.datetime.strptime(text, "%Y%m%d").date() if text.isdigit() and len(text) == 8 else dt.date.fromisoformat(text)


def _datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value)
    if text.isdigit() and len(text) in (8, 14):
        return dt.datetime.strptime(text, "%Y%m%d%H%M%S"[: 6 if len(text) == 8 else 14])
    return dt.datetime.fromisoformat(text)


def _bool(value) -> bool:
    if isinstance(value, bool):
        return value
    known = {"true": True, "1": True, "false": False, "0": False}
    return known[str(value).lower()]


def _enum(value, labels) -> int:
    text = str(value)
    if not isinstance(value, int) and text in labels:
        return labels.index(text)
    n = int(text)
    if not 0 <= n < len(labels):
        raise ValueError(value)
    return n


def coerce(value, kind: str, length: int = 0, scale: int = 0, labels: tuple[str, ...] = ()):
    """A Python value or the text of a literal, as the value that a column of this type holds."""
    if value is None:
        return None
    try:
        if kind == INT:
            n = int(str(value)) if not isinstance(value, int) else int(value)
            if not -(2**31) <= n < 2**31:
                raise ValueError(value)
            return n
        if kind == DECIMAL:
            d = Decimal(str(value)).quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)
            if len(d.as_tuple().digits) - scale > min(length or MAX_PRECISION, MAX_PRECISION) - scale:
                raise ValueError(value)
            return d
        if kind == VARCHAR:
            return str(value)[:length]
        if kind == ENUM:
            return _enum(value, labels)
        return {BOOL: _bool, DATE: _date, DATETIME: _datetime}[kind](value)
    except (ValueError, KeyError, InvalidOperation) as e:
        raise BindError(f"{value!r} is no {kind}") from e


def for_spark(value, type_: T.DataType):
    """The text of a literal as a value of a Spark type (operands of external tables)."""
    try:
        if isinstance(type_, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return int(value)
        if isinstance(type_, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(type_, T.DecimalType):
            return Decimal(str(value))
        if isinstance(type_, T.BooleanType):
            return _bool(value)
        if isinstance(type_, T.DateType):
            return _date(value)
        if isinstance(type_, (T.TimestampType, T.TimestampNTZType)):
            return _datetime(value)
        if isinstance(type_, T.StringType):
            return str(value)
    except (ValueError, KeyError, InvalidOperation) as e:
        raise BindError(f"{value!r} is no {type_.simpleString()}") from e
    raise BindError(f"no literals of type {type_.simpleString()}")


# Integer forms, as DataFrame expressions.


def decimal_to_int(c: Column, scale: int = 2) -> Column:
    return (c.cast(T.DecimalType(18, scale)) * F.lit(10**scale)).cast("long")


def int_to_decimal(c: Column, scale: int = 2) -> Column:
    return (c.cast(T.DecimalType(18, 0)) / F.lit(10**scale)).cast(T.DecimalType(18, scale))


def date_to_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def int_to_date(c: Column) -> Column:
    return F.to_date(c.cast("string"), "yyyyMMdd")


def datetime_to_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMddHHmmss").cast("long")


def int_to_datetime(c: Column) -> Column:
    return F.to_timestamp_ntz(c.cast("string"), F.lit("yyyyMMddHHmmss"))


def enum_to_int(c: Column, labels) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), c) - 1).cast("int")


def int_to_enum(c: Column, labels) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), c.cast("int"))
