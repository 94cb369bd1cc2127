"""Casts to declared types in which a bad value becomes NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.columns import find_field

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def same_type(left: T.DataType, right: T.DataType) -> bool:
    """Equal types, whatever their nullability and comments."""
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return left.names == right.names and all(
            same_type(a.dataType, b.dataType) for a, b in zip(left.fields, right.fields)
        )
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return same_type(left.elementType, right.elementType)
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return same_type(left.keyType, right.keyType) and same_type(left.valueType, right.valueType)
    return left == right


def never_fails(source: T.DataType, target: T.DataType) -> bool:
    """Numeric widening, which a plain cast does without a per-element lambda."""
    if isinstance(target, T.LongType):
        return isinstance(source, INTEGERS)
    return isinstance(target, T.DoubleType) and isinstance(source, NUMBERS)


def cast_to(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` of type ``source`` as ``target``; unreadable parts become NULL."""
    if same_type(source, target):
        return value
    if isinstance(target, (T.StructType, T.ArrayType, T.MapType)):
        return _cast_nested(value, source, target)
    if isinstance(target, T.StringType):
        return F.to_json(value) if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) else value.cast(target)
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(None).cast(target)
    if isinstance(target, (T.DateType, T.TimestampType)):
        if isinstance(source, MOMENTS):
            return value.cast(target)
        text = value.cast("string")
        return F.try_to_date(text) if isinstance(target, T.DateType) else F.try_to_timestamp(text)
    if never_fails(source, target):
        return value.cast(target)
    if isinstance(source, MOMENTS) or isinstance(source, T.BinaryType):
        value = value.cast("string")
    return value.try_cast(target)


def _cast_nested(value: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        parts = []
        for f in target.fields:
            held = find_field(source, f.name)
            part = F.lit(None).cast(f.dataType)
            if held is not None:
                part = cast_to(value.getField(held.name), held.dataType, f.dataType)
            parts.append(part.alias(f.name, metadata=f.metadata))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        if never_fails(source.elementType, target.elementType):
            return value.cast(target)
        return F.transform(value, lambda item: cast_to(item, source.elementType, target.elementType))
    if isinstance(target, T.MapType) and isinstance(source, T.MapType):
        return value.cast(target)
    if isinstance(target, T.MapType) and isinstance(source, T.StructType):
        return F.from_json(F.to_json(value), target)
    return F.lit(None).cast(target)
