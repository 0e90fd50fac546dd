"""Types and functions that definitions may use."""

from __future__ import annotations

from pyspark.sql import types as T

#: Functions that Spark calls deterministic although they depend on session or time.
MUTABLE = frozenset(
    "CurrentDate CurrentTimestamp CurrentTimestampLike Now LocalTimestamp CurrentTimeZone CurrentTime CurrentUser CurrentCatalog CurrentDatabase SparkVersion InputFileName UnixTimestampNow".split()
)
#: Aggregates that deltas maintain, by Catalyst's class.
AGGREGATES = {"Count": "count", "Sum": "sum", "Average": "avg", "Min": "min", "Max": "max"}
#: Expressions that turn null inputs into something else.
NON_STRICT = frozenset("Coalesce If CaseWhen IsNull IsNotNull EqualNullSafe Or And Not NaNvl Nvl Nvl2 NullIf In InSet Least Greatest ConcatWs AtLeastNNonNulls CreateArray CreateNamedStruct CreateMap PythonUDF ScalaUDF HiveSimpleUDF HiveGenericUDF Murmur3Hash XxHash64 HiveHash ToJson StructsToJson TryEval RaiseError AssertTrue".split())


def is_orderable(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType, T.CalendarIntervalType)):
        return False
    if isinstance(t, T.ArrayType):
        return is_orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(is_orderable(f.dataType) for f in t.fields)
    return True
