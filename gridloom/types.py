"""Array types as Spark types."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from . import calendars as cal
from .dataset import GridDataset, GridVar

#: numpy kind and size: Spark type and the array type handed over (Spark takes no unsigned and no half-precision ones).
PLAIN = {
    "b1": (T.BooleanType(), pa.bool_()), "i1": (T.ByteType(), pa.int8()), "i2": (T.ShortType(), pa.int16()), "i4": (T.IntegerType(), pa.int32()), "i8": (T.LongType(), pa.int64()),
    "u1": (T.ShortType(), pa.int16()), "u2": (T.IntegerType(), pa.int32()), "u4": (T.LongType(), pa.int64()), "u8": (T.DecimalType(20, 0), pa.decimal128(20, 0)),
    "f2": (T.FloatType(), pa.float32()), "f4": (T.FloatType(), pa.float32()), "f8": (T.DoubleType(), pa.float64()),
}


def field_for(name: str, v: GridVar, role: str) -> T.StructField:
    """Dimensions are never null, variables may be. Dates of a climate calendar are timestamps if it is like the Gregorian one, else offsets in the coordinate's units."""
    meta, dtype = {"role": role}, v.dtype
    if dtype == object and cal.is_caldate(v.values):
        calendar = cal.calendar_of(v.values)
        meta |= {"calendar": calendar, "units": v.encoding.get("units", cal.DEFAULT_UNITS)}
        return T.StructField(name, T.TimestampNTZType() if cal.is_gregorian_like(calendar) else T.LongType(), role != "dim", meta)
    if dtype.kind == "M":
        kind = T.TimestampNTZType()
    elif dtype.kind == "m":
        kind = T.DayTimeIntervalType()
    elif dtype.kind in "US" or (dtype == object and all(isinstance(x, str) or x is None for x in v.values.ravel()[:1])):
        kind = T.StringType()
    elif (code := f"{dtype.kind}{dtype.itemsize}") in PLAIN:
        kind = PLAIN[code][0]
    else:
        raise TypeError(f"{name}: arrays of {dtype} have no column type")
    return T.StructField(name, kind, role != "dim", meta)


def infer_schema(ds: GridDataset) -> T.StructType:
    """Dimension coordinates in their order, then variables."""
    dims = {d for v in ds.data.values() for d in v.dims} or set(ds.sizes)
    coords = [field_for(k, v, "dim") for k, v in ds.dim_coords.items() if k in dims]
    return T.StructType(coords + [field_for(k, v, "var") for k, v in ds.data.items()])


def whole_micros(values: np.ndarray) -> np.ndarray:
    """Times as microseconds, which is what Spark keeps; finer ones are refused, as they would be cut."""
    if values.dtype == "datetime64[ns]" and np.any((values.view(np.int64) % 1000 != 0) & ~np.isnat(values)):
        raise ValueError("times finer than microseconds")
    return values.astype("datetime64[us]")


def to_arrow(values: np.ndarray, field: T.StructField) -> pa.Array:
    """Values of a column; NaN and NaT of variables are null, dimensions stay as they are."""
    values, var = np.ascontiguousarray(values).ravel(), field.metadata.get("role") == "var"
    if cal.is_caldate(values):
        if isinstance(field.dataType, T.LongType):
            return pa.array(cal.to_offsets(values, field.metadata["units"]), pa.int64())
        return pa.array(cal.to_microseconds(values), pa.int64()).cast(pa.timestamp("us"))
    kind = values.dtype.kind
    if kind == "M":
        return pa.array(whole_micros(values), pa.timestamp("us"))
    if kind == "m":
        return pa.array(values.astype("timedelta64[us]"), pa.duration("us"))
    if kind in "US" or values.dtype == object:
        return pa.array([None if x is None else str(x) for x in values.tolist()], pa.string())
    target = PLAIN[f"{kind}{values.dtype.itemsize}"][1]
    if target == pa.decimal128(20, 0):
        return pa.array([int(x) for x in values]).cast(target) if len(values) else pa.array([], target)
    if kind == "f":
        return pa.array(values.astype(target.to_pandas_dtype()), target, from_pandas=var)
    return pa.array(values.astype(target.to_pandas_dtype()), target)
