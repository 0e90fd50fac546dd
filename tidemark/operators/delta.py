"""State before, state after and signed delta of every node of a maintainable plan.

Deltas are bags with signed weights. A node below which nothing changed has no delta (None), so its
side of a join is never joined with nothing. Spark plans every product, and may broadcast deltas
where their size allows. The least and greatest values of a delta's columns, known from the job that
wrote it, bound what is read of the other side of an equality, so that row groups of files in an
order of keys are skipped.

States may be signed bags too, with rows and what took them away side by side: products and sums take
them as they are, and what asks whether a row is there nets them first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ir
from ..sources.storage import W, netted

#: From a table's name and "pre", "post" or "delta" to rows with weights; a delta may be None.
Tables = Callable[[str, str], DataFrame | None]
#: From a table's name to the least and greatest value in its delta of some of its columns.
Ranges = Callable[[str], dict[str, tuple[Any, Any]]]


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    there = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, there) if there else None


def _plain(n: ir.Node) -> bool:
    return isinstance(n, ir.Join) and n.kind == "inner" and n.plain


def _turned(n: ir.Join) -> ir.Join:
    """(a, b), c as a, (b, c) where c is joined to b alone, so that a is joined once with what changes in
    either, which is less than both of them. Conditions are equalities and can't fail on more rows."""
    if _plain(n) and _plain(n.left) and all(x in n.left.right.cols for x, _ in n.equal):
        a, b = n.left.left, n.left.right
        rest = ir.Join([*b.cols, *n.right.cols], b, n.right, "inner", n.condition, None, n.equal, True)
        return _turned(ir.Join(n.cols, a, rest, "inner", n.left.condition, None, n.left.equal, True))
    return n


class Delta:
    def __init__(self, tables: Tables, signed: Callable[[str], bool] = lambda table: False, ranges: Ranges = lambda table: {}):
        self.tables, self.signed, self.ranges = tables, signed, ranges

    def nets(self, n: ir.Node, df: DataFrame) -> DataFrame:
        """df, a state of n or part of it, netted if it may be signed."""
        if any(isinstance(x, ir.Scan) and self.signed(x.table) for x in ir.walk(n)):
            return netted(df, [c for c in df.columns if c != W])
        return df

    def pre(self, n: ir.Node) -> DataFrame:
        return self._state(n, "pre")

    def post(self, n: ir.Node) -> DataFrame:
        return self._state(n, "post")

    def _scan(self, n: ir.Scan, when: str) -> DataFrame | None:
        df = self.tables(n.table, when)
        return None if df is None else df.select(*[F.col(f"`{s}`").alias(c) for s, c in zip(n.source, n.cols)], W)

    def _state(self, n: ir.Node, when: str) -> DataFrame:
        if isinstance(n, ir.Scan):
            return self._scan(n, when)
        if isinstance(n, ir.Fixed):
            return n.df.withColumn(W, F.lit(1).cast("long"))
        if isinstance(n, ir.Filter):
            return self._state(n.child, when).where(n.condition)
        if isinstance(n, ir.Project):
            return self._project(n, self._state(n.child, when))
        if isinstance(n, ir.Generate):
            return self._generate(n, self._state(n.child, when))
        if isinstance(n, ir.Exists):
            return self._counted(netted(self._state(n.child, when), n.child.cols), self._state(n.inner, when), n)
        left, right = self._state(n.left, when), self._state(n.right, when)
        if n.kind == "inner":
            return self._product(left, right, n)
        left, right = self.nets(n.left, left), self.nets(n.right, right)
        joined = left.withColumnRenamed(W, "__l").join(right.withColumnRenamed(W, "__r"), n.condition, n.kind)
        return joined.select(*n.cols, (F.coalesce("__l", F.lit(1)) * F.coalesce("__r", F.lit(1))).cast("long").alias(W))

    def _project(self, n: ir.Project, df: DataFrame) -> DataFrame:
        counts = [c for c in df.columns if c.startswith("__ivm_exists_count_")]
        return df.select(*[e.alias(c) for e, c in zip(n.exprs, n.cols)], *counts, W)

    def _generate(self, n: ir.Generate, df: DataFrame) -> DataFrame:
        return df.select(*n.child.cols, n.function.alias(*n.names), W)

    def _product(self, left: DataFrame, right: DataFrame, n: ir.Join) -> DataFrame:
        left, right = left.withColumnRenamed(W, "__l"), right.withColumnRenamed(W, "__r")
        joined = left.crossJoin(right) if n.condition is None else left.join(right, n.condition)
        return joined.select(*n.left.cols, *n.right.cols, (F.col("__l") * F.col("__r")).alias(W))

    def _counted(self, rows: DataFrame, inner: DataFrame, n: ir.Exists) -> DataFrame:
        """Distinct rows that have matches, with their number."""
        matched = rows.join(inner.withColumnRenamed(W, "__r"), n.condition)
        return matched.groupBy(*n.child.cols, W).agg(F.sum("__r").alias(n.count)).where(F.col(n.count) > 0).select(*n.cols, W)

    def bounds(self, n: ir.Node) -> dict[str, tuple[Any, Any]]:
        """What columns of n's delta range over, of those for which it is known."""
        if isinstance(n, ir.Scan):
            known = self.ranges(n.table)
            return {c: known[s] for s, c in zip(n.source, n.cols) if s in known}
        if isinstance(n, (ir.Filter, ir.Generate)):
            return self.bounds(n.child)
        if isinstance(n, ir.Project):
            below = self.bounds(n.child)
            return {c: below[p] for c, p in zip(n.cols, n.plain) if p in below}
        if isinstance(n, ir.Join) and n.kind == "inner":
            # where both sides change, rows of either are in the delta that its own change does not hold
            sides = [x for x in (n.left, n.right) if self._changes(x)]
            return self.bounds(sides[0]) if len(sides) == 1 else {}
        return {}

    def _near(self, df: DataFrame, by: ir.Node, pairs: list[tuple[str, str]]) -> DataFrame:
        """Rows of df whose columns are in the range of by's delta; pairs: columns of by, of df."""
        known = self.bounds(by)
        for own, other in pairs:
            if own in known:
                df = df.where(F.col(other).between(F.lit(known[own][0]), F.lit(known[own][1])))
        return df

    def delta(self, n: ir.Node) -> DataFrame | None:
        if isinstance(n, ir.Scan):
            return self._scan(n, "delta")
        if isinstance(n, ir.Fixed):
            return None
        if isinstance(n, ir.Filter):
            d = self.delta(n.child)
            return None if d is None else d.where(n.condition)
        if isinstance(n, ir.Project):
            d = self.delta(n.child)
            return None if d is None else self._project(n, d)
        if isinstance(n, ir.Generate):
            d = self.delta(n.child)
            return None if d is None else self._generate(n, d)
        if isinstance(n, ir.Exists):
            return self._exists(n)
        n = _turned(n)
        left, right = self.delta(n.left), self.delta(n.right)
        back = [(r, x) for x, r in n.equal]
        if n.kind == "inner":
            return _union([
                None if left is None else self._before(left, n),
                None if right is None else self._product(self._near(self.post(n.left), n.right, back), right, n),
            ])
        return _union([
            None if left is None else self._outer(n, left, self._near(self.pre(n.right), n.left, n.equal), n.left, n.right, n.keys[0], n.keys[1], n.kind in ("left", "full"), n.kind in ("right", "full")),
            None if right is None else self._outer(n, right, self._near(self.post(n.left), n.right, back), n.right, n.left, n.keys[1], n.keys[0], n.kind in ("right", "full"), n.kind in ("left", "full")),
        ])

    def _before(self, d: DataFrame, n: ir.Join) -> DataFrame:
        """d, the delta of n's left side, with the state before of its right side: where that is a join too,
        first with the part that d is joined to, as a join of the parts may be much larger."""
        r = n.right
        if _plain(n) and _plain(r) and all(y in r.left.cols for _, y in n.equal):
            first = ir.Join([*n.left.cols, *r.left.cols], n.left, r.left, "inner", n.condition, None, n.equal, True)
            return self._product(self._before(d, first), self.pre(r.right), ir.Join(n.cols, first, r.right, "inner", r.condition, None, r.equal, True))
        return self._product(d, self._near(self.pre(r), n.left, n.equal), n)

    def _changes(self, n: ir.Node) -> bool:
        return any(isinstance(x, ir.Scan) and self.tables(x.table, "delta") is not None for x in ir.walk(n))

    def _outer(self, n: ir.Join, d: DataFrame, other: DataFrame, own_node: ir.Node, other_node: ir.Node, own: str, key: str, keeps: bool, other_keeps: bool) -> DataFrame | None:
        """Change of an outer join when one side changes by d. keeps: rows of d's side without a match
        stay, null-extended; other_keeps: those of the other side do. Of either state, only rows of d's
        keys are grouped."""
        types = {**dict(d.dtypes), **dict(other.dtypes)}
        nulls = lambda cols: [F.lit(None).cast(types[c]).alias(c) for c in cols]
        touched = d.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("__k")).agg(F.sum(W).alias("__d"))
        keys = touched.select("__k")
        matched = d.withColumnRenamed(W, "__l").join(other.withColumnRenamed(W, "__r"), n.condition)
        parts = [matched.select(*n.cols, (F.col("__l") * F.col("__r")).alias(W))]
        if keeps:
            there = other.join(keys, F.col(key) == F.col("__k"), "left_semi").groupBy(F.col(key).alias("__k")).agg(F.sum(W).alias("__n")).where("__n > 0").select("__k")
            alone = d.join(there, F.col(own) == F.col("__k"), "left_anti")
            parts.append(alone.select(*own_node.cols, *nulls(other_node.cols), W).select(*n.cols, W))
        if other_keeps:
            before = self._near(self.pre(own_node), own_node, [(own, own)])
            was = before.join(keys, F.col(own) == F.col("__k"), "left_semi").groupBy(F.col(own).alias("__b")).agg(F.sum(W).alias("__n"))
            turned = touched.join(was, F.col("__k") == F.col("__b"), "left").select("__k", F.coalesce("__n", F.lit(0)).alias("__n"), (F.coalesce("__n", F.lit(0)) + F.col("__d")).alias("__m"))
            turned = turned.select("__k", F.when((F.col("__n") > 0) & (F.col("__m") <= 0), 1).when((F.col("__n") <= 0) & (F.col("__m") > 0), -1).alias("__s")).where("__s is not null")
            dangling = other.join(turned, F.col(key) == F.col("__k"))
            parts.append(dangling.select(*other_node.cols, *nulls(own_node.cols), (F.col(W) * F.col("__s")).cast("long").alias(W)).select(*n.cols, W))
        return _union(parts)

    def _exists(self, n: ir.Exists) -> DataFrame | None:
        child, inner = self.delta(n.child), self.delta(n.inner)
        back = [(i, c) for c, i in n.equal]
        parts = []
        if child is not None:
            parts.append(self._counted(netted(child, n.child.cols), self._near(self.pre(n.inner), n.child, n.equal), n))
        if inner is not None:
            # the semi join first: only rows that the change touches are shuffled by all their columns
            outer = self._near(self.post(n.child), n.inner, back)
            touched = netted(outer.join(netted(inner, n.inner.cols), n.condition, "left_semi"), n.child.cols)
            own = [(i, i) for _, i in n.equal]
            parts += [self._counted(touched, self._near(self.pre(n.inner), n.inner, own), n).withColumn(W, -F.col(W)), self._counted(touched, self._near(self.post(n.inner), n.inner, own), n)]
        return _union(parts)
