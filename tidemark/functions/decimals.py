"""Decimal arithmetic that keeps every digit: an overflow is an error, never a shorter scale.

Spark's own operators cut the scale of a result that needs over 38 digits. These columns are built
from Catalyst's expressions over Py4J, private interfaces of 4.1.
"""

from __future__ import annotations

from pyspark.sql import Column as AnyColumn
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column


def _jvm():
    return SparkSession.active()._jvm.org.apache.spark.sql


def _binary(kind: str, a: AnyColumn, b: AnyColumn) -> AnyColumn:
    sql = _jvm()
    utils, ansi = sql.classic.ExpressionUtils, getattr(getattr(sql.catalyst.expressions, "EvalMode$"), "MODULE$").ANSI()
    exact = sql.catalyst.expressions.NumericEvalContext(ansi, False)
    return Column(utils.column(getattr(sql.catalyst.expressions, kind)(utils.expression(a._jc), utils.expression(b._jc), exact)))


def times(x: AnyColumn, t: T.DataType, w: AnyColumn) -> AnyColumn:
    """x, of type t, as often as the whole number w says."""
    if isinstance(t, T.DecimalType):
        return _binary("Multiply", x, w.cast("decimal(20,0)"))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        x = x.cast("long")
    return x * (w.cast("int") if isinstance(t, (T.DayTimeIntervalType, T.YearMonthIntervalType)) else w)


def plus(a: AnyColumn, b: AnyColumn, t: T.DataType) -> AnyColumn:
    return _binary("Add", a, b) if isinstance(t, T.DecimalType) else a + b


def mean(total: AnyColumn, n: AnyColumn, t: T.DataType) -> AnyColumn:
    """total / n with the digits of t, the type of Spark's avg()."""
    if not isinstance(t, T.DecimalType):
        return (total / n).cast(t)
    sql = _jvm()
    utils = sql.classic.ExpressionUtils
    parts = utils.expression(total._jc), utils.expression(n.cast("decimal(20,0)")._jc)
    return Column(utils.column(sql.catalyst.expressions.DecimalDivideWithOverflowCheck(*parts, sql.types.DecimalType(t.precision, t.scale), None, False)))
