"""How a view is stored, how a delta of its body goes in, and how it is read.

Views whose stored values add up (bags, DISTINCT, count, sum, avg) take a delta as one more signed
file. Extremes do not: a statement writes the groups that it touches anew, with the number of the
statement, and the latest row of a group is what counts. Groups that lost a value at or beyond their
extreme are recomputed from the base, all at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import mean, plus, times
from ..plans import ir
from ..sources.storage import W, netted
from .delta import Delta

COUNT, AT, STALE = "__ivm_count__", "__at", "__stale"


def _count_of(v: str) -> str:
    return f"__ivm_count_{v}__"


def _sum_of(v: str) -> str:
    return f"__ivm_sum_{v}__"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def extremes(view: ir.View) -> bool:
    return any(a.kind in ("min", "max") for a in view.aggs)


def hidden(view: ir.View) -> list[str]:
    """Hidden columns in the order in which they follow the visible ones."""
    out = list(view.exists)
    for a in view.aggs:
        if a.kind != "count":
            out.append(_count_of(a.name))
        if a.kind == "avg":
            out.append(_sum_of(a.name))
    return out + [COUNT] * (view.kind != "bag")


def partial(view: ir.View, body: DataFrame) -> DataFrame:
    """What of a signed bag of the body is stored: keys, hidden columns and partial results."""
    keys = [F.col(s).alias(v) for v, s in zip(view.visible, view.source) if s]
    if view.kind == "bag":
        return body.select(*keys, *view.exists, W)
    if view.kind == "distinct":
        cols = [*view.keys, *view.exists]
        return netted(body.select(*keys, *view.exists, W), cols)
    types = {f.name: f.dataType for f in body.schema.fields}
    out = []
    for a in view.aggs:
        n = F.coalesce(F.sum(W if a.arg is None else F.when(F.col(a.arg).isNotNull(), F.col(W))), F.lit(0)).cast("long")
        if a.kind == "count":
            out.append(n.alias(a.name))
            continue
        out.append(n.alias(_count_of(a.name)))
        if a.kind in ("sum", "avg"):
            total = F.sum(times(F.col(a.arg), types[a.arg], F.col(W)))
            out.append(total.alias(a.name if a.kind == "sum" else _sum_of(a.name)))
        else:
            f = F.min if a.kind == "min" else F.max
            out += [f(F.when(F.col(W) > 0, F.col(a.arg))).alias(a.name), f(F.when(F.col(W) < 0, F.col(a.arg))).alias(f"__gone_{a.name}")]
    return body.groupBy(*keys).agg(*out, F.sum(W).cast("long").alias(COUNT))


def stored(view: ir.View, body: DataFrame) -> DataFrame:
    """What a view's first file holds."""
    out = partial(view, body)
    return out.select(*[_c(c) for c in out.columns if not c.startswith("__gone_")], F.lit(0).cast("long").alias(AT)) if extremes(view) else out


def summed(view: ir.View, files: DataFrame, whole: bool = True) -> DataFrame:
    """What stored files add up to, one row per group or different row; the state if they are the whole."""
    if view.kind != "aggregate":
        cols = [*view.keys, *view.exists]
        return netted(files, cols).where(F.col(W) > 0) if whole else netted(files, cols)
    if extremes(view):
        rest = [c for c in files.columns if c not in view.keys]
        last = F.max_by(F.struct(*[_c(c) for c in rest]), F.col(AT)).alias("__last")
        state = files.groupBy(*[_c(k) for k in view.keys]).agg(last).select(*[_c(k) for k in view.keys], *[F.col("__last")[c].alias(c) for c in rest])
    else:
        out = [F.sum(_c(c)).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in view.keys]
        state = files.groupBy(*[_c(k) for k in view.keys]).agg(*out)
    return state.where(F.col(COUNT) > 0) if view.keys and whole else state


def read(view: ir.View, files: DataFrame, settled: bool = False) -> DataFrame:
    """The view's rows with hidden columns behind the visible ones; bags keep W. settled: the files are
    a state already, so that nothing is shuffled."""
    state = files if settled else summed(view, files)
    if view.kind == "bag":
        return state.select(*[_c(c) for c in view.visible], *view.exists, W)
    if view.kind == "distinct":
        return state.select(*[_c(c) for c in view.visible], *view.exists, F.col(W).alias(COUNT))
    of, out = {a.name: a for a in view.aggs}, []
    for v, t in zip(view.visible, view.types):
        a = of.get(v)
        if a is None:
            out.append(_c(v))
        elif a.kind == "count":
            out.append(F.coalesce(_c(v), F.lit(0)).cast(t).alias(v))
        elif a.kind == "avg":
            out.append(F.when(_c(_count_of(v)) > 0, mean(_c(_sum_of(v)), _c(_count_of(v)), t)).alias(v))
        else:
            out.append(F.when(_c(_count_of(v)) > 0, _c(v)).cast(t).alias(v))
    return state.select(*out, *[F.coalesce(_c(h), F.lit(0)).alias(h) if not h.startswith("__ivm_sum") else _c(h) for h in hidden(view)])


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs], F.lit(True))


def _of_groups(df: DataFrame, groups: DataFrame, own: list[str], keys: list[str]) -> DataFrame:
    """Rows of df whose columns own are the keys of one of the groups."""
    named = groups.select(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return df.join(named, _same([(f"`{c}`", f"__k{i}") for i, c in enumerate(own)]), "left_semi")


def touched(view: ir.View, files: DataFrame, change: DataFrame, at: int) -> DataFrame:
    """New rows of the groups that a change touches in a view with extremes, those that lost an
    extreme marked stale. A group without rows keeps one of count 0, until files are folded."""
    keys = view.keys
    state = summed(view, _of_groups(files, change, keys, keys) if keys else files, False)
    s, d = state.alias("s"), change.alias("d")
    if keys:
        both = d.join(s, _same([(f"s.`{k}`", f"d.`{k}`") for k in keys]), "left")
    else:
        both = d.join(s, F.lit(True), "left")
    types = {f.name: f.dataType for f in state.schema.fields}
    out, stale = [F.col(f"d.`{k}`").alias(k) for k in keys], F.lit(False)
    was = F.coalesce(F.col(f"s.{COUNT}"), F.lit(0)) > 0
    for c in state.columns:
        if c in keys or c == AT:
            continue
        old, new = F.when(was, F.col(f"s.`{c}`")), F.col(f"d.`{c}`")
        a = next((a for a in view.aggs if a.name == c and a.kind in ("min", "max")), None)
        if a is None:
            out.append(F.coalesce(plus(old, new, types[c]), old, new).cast(types[c]).alias(c))
            continue
        gone = F.col(f"d.`__gone_{c}`")
        stale = stale | F.coalesce(gone <= old if a.kind == "min" else gone >= old, F.lit(False))
        out.append((F.least if a.kind == "min" else F.greatest)(old, new).alias(c))
    left = F.coalesce(F.col(f"s.{COUNT}"), F.lit(0)) + F.col(f"d.{COUNT}") > 0
    full = both.select(*out, F.lit(at).cast("long").alias(AT), (stale & left).alias(STALE))
    return full.select(*[_c(c).cast(types[c]).alias(c) for c in state.columns], STALE)


def again(view: ir.View, fresh: DataFrame, delta: Delta, at: int) -> DataFrame:
    """Rows of touched(), the stale ones from the base after the change: one query for all of them."""
    lost, body = fresh.where(STALE), delta.post(view.body)
    columns = [c for c in fresh.columns if c != STALE]
    if view.keys:
        own = {v: c for v, c in zip(view.visible, view.source) if c}
        body = _of_groups(body, lost, [own[k] for k in view.keys], view.keys)
    anew = partial(view, delta.nets(view.body, body)).withColumn(AT, F.lit(at).cast("long"))
    types = {f.name: f.dataType for f in fresh.schema.fields}
    return fresh.where(~F.col(STALE)).select(*[_c(c) for c in columns]).unionByName(anew.select(*[_c(c).cast(types[c]).alias(c) for c in columns]))
