"""Type families: the one place where Spark types are sorted into groups."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGER, FRACTION, TEMPORAL, BOOLEAN, TEXT, COMPLEX = (
    "integer",
    "fraction",
    "temporal",
    "boolean",
    "text",
    "complex",
)
NUMERIC = (INTEGER, FRACTION)

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORALS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(data_type: T.DataType) -> str:
    """Family of a Spark type; array, map, struct and binary are ``complex``."""
    if isinstance(data_type, _INTEGERS):
        return INTEGER
    if isinstance(data_type, _FRACTIONS):
        return FRACTION
    if isinstance(data_type, _TEMPORALS):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return COMPLEX


def join_family(data_type: T.DataType) -> str:
    """Group within which two columns may be compared as join keys.

    Numeric, temporal and text columns compare with their own kind; every
    other type only with the identical type.
    """
    kind = family(data_type)
    if kind in NUMERIC:
        return "numeric"
    if kind in (TEMPORAL, TEXT):
        return kind
    return data_type.simpleString()
