"""Record conversion: one shape of a record projected onto another by field name."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_instant(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and [f.name for f in kind] == ["seconds", "nanos"]


def instant(c: Column) -> Column:
    """A wire instant as a timestamp; nanoseconds below a microsecond are lost."""
    return F.timestamp_micros(c["seconds"].cast("long") * F.lit(1_000_000) + F.floor(c["nanos"] / 1000).cast("long"))


def converted(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """c of type have as want: fields by exact name, those without a source null, those without a target dropped.

    A null record stays null, a null array or map becomes an empty one, order in arrays is kept, and scalars are cast, which
    fails on malformed values under ANSI mode.
    """
    if isinstance(want, T.TimestampType) and is_instant(have):
        return F.when(c.isNotNull(), instant(c))
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            raise TypeError(f"cannot convert {have.simpleString()} to a record")
        got = {f.name: f.dataType for f in have}
        parts = [(converted(c[f.name], got[f.name], f.dataType) if f.name in got else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType):
        if not isinstance(have, T.ArrayType):
            raise TypeError(f"cannot convert {have.simpleString()} to an array")
        return F.coalesce(F.transform(c, lambda x: converted(x, have.elementType, want.elementType)), F.array().cast(want))
    if isinstance(want, T.MapType):
        if not isinstance(have, T.MapType):
            raise TypeError(f"cannot convert {have.simpleString()} to a map")
        return F.coalesce(F.transform_values(c, lambda _, v: converted(v, have.valueType, want.valueType)), F.create_map().cast(want))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        raise TypeError(f"cannot convert {have.simpleString()} to {want.simpleString()}")
    return c.cast(want)


def convert(df: DataFrame, want: T.StructType) -> DataFrame:
    """df with the columns of want, in its order; the strict form of a projection."""
    got = {f.name: f.dataType for f in df.schema}
    return df.select(*[(converted(F.col(f"`{f.name}`"), got[f.name], f.dataType) if f.name in got else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
