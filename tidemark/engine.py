"""Tables, views kept up to date with them, statements and transactions."""

from __future__ import annotations

import copy
import json
import threading
import warnings
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names
from .errors import EngineError, LockNotAvailable, SerializationFailure
from .locks import EXCLUSIVE, SHARED, Locks
from .operators import merge
from .operators.delta import Delta
from .plans import analyze, deparse, ir
from .sources.storage import FOLD, W, Store, among, expanded, netted

WRITE = "cannot change materialized view \"%s\""
STALE = "the materialized view is incrementally updated in concurrent transaction"
BUSY = "could not obtain lock on materialized view \"%s\" during incremental maintenance"
NO_KEY = "could not create an index on immv \"%s\" automatically"
OWNER = "must be owner of %s"
ISOLATIONS = ("read committed", "repeatable read", "serializable")


#: Types whose least and greatest values in a delta bound what is read of other tables.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.StringType)


@dataclass
class ChangeSet:
    """Rows that a statement adds to a table and takes from it. Rows to take that the table does not
    have are passed over."""

    inserted: DataFrame | None = None
    deleted: DataFrame | None = None


def _schema(json_text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(json_text))


class ViewEngine:
    def __init__(self, spark: SparkSession, path: str, user: str = ""):
        """user: who may change views that have an owner; by default all."""
        self.spark, self.store, self.user = spark, Store(spark, path), user
        self._scratch = spark  # replaced for each definition
        self.catalog = self.store.load()
        self._lock = threading.RLock()
        self._locks = Locks()
        self._views: dict[str, ir.View] = {}
        self._local = threading.local()
        self.notices: list[str] = []

    # -- transactions

    @contextmanager
    def transaction(self, isolation: str = "read committed", owner: str | None = None) -> Iterator[ViewEngine]:
        """Statements inside are seen by others all at once when it ends, or never if it fails."""
        if isolation not in ISOLATIONS:
            raise EngineError(f"no isolation level {isolation}")
        if getattr(self._local, "staged", None) is not None:
            raise EngineError("there is already a transaction in progress")
        self._local.staged, self._local.isolation = copy.deepcopy(self.catalog), isolation
        self._local.touched, self._local.savepoints, self._local.shared = set(), {}, {}
        try:
            yield self
            with self._lock:
                for name in self._local.touched - set(self._local.shared):
                    was = self._local.staged["began"].get(name) if "began" in self._local.staged else None
                    now = self._relation(self.catalog, name)
                    if now is not None and was is not None and now["changed"] != was:
                        raise SerializationFailure(STALE)
                self._publish()
        finally:
            self._local.staged = None
            self._locks.free()

    def _relation(self, catalog: dict, name: str) -> dict | None:
        return catalog["tables"].get(name) or catalog["views"].get(name)

    def _publish(self) -> None:
        new = copy.deepcopy(self.catalog)
        staged = self._local.staged
        for kind in ("tables", "views"):
            for name in self._local.touched:
                if name in staged[kind]:
                    new[kind][name] = self._joined(name, staged[kind][name], new[kind].get(name))
                else:
                    new[kind].pop(name, None)
        new["version"] = self.catalog["version"] + 1
        try:
            self.store.save(new)
        except SerializationFailure:
            self.catalog = self.store.load()  # so that the next attempt starts from what the other left
            raise
        self.catalog = new

    def savepoint(self, name: str) -> None:
        self._local.savepoints[name] = (copy.deepcopy(self._local.staged), set(self._local.touched))

    def rollback_to(self, name: str) -> None:
        staged, touched = self._local.savepoints[name]
        self._local.staged, self._local.touched = copy.deepcopy(staged), set(touched)

    @contextmanager
    def _statement(self) -> Iterator[dict]:
        """The catalog that a statement reads and changes."""
        if getattr(self._local, "staged", None) is not None:
            before = copy.deepcopy(self._local.staged), set(self._local.touched)
            try:
                yield self._local.staged
            except BaseException:
                self._local.staged, self._local.touched = before
                raise
        else:
            with self.transaction():
                yield self._local.staged

    def _joined(self, name: str, own: dict, now: dict | None) -> dict:
        """What a relation is with the files that this transaction has added under a shared lock."""
        if name not in self._local.shared or now is None:
            return own
        added = own["files"][self._local.shared[name] :]
        return now | {"files": [*now["files"], *added], "changed": now["changed"] + 1, "batches": now.get("batches", {}) | own.get("batches", {})}

    def _take(self, name: str, kind: str = EXCLUSIVE) -> None:
        """Locks a relation until the transaction ends; under read committed, what others committed
        meanwhile is read anew. Under a shared lock files are only added, so others may add theirs."""
        staged, shared = self._local.staged, self._local.shared
        if name in self._local.touched and (kind == SHARED or name not in shared):
            return
        if not self._locks.take(name, kind, self._local.isolation == "read committed"):
            raise LockNotAvailable(BUSY % name)
        now, own = self._relation(self.catalog, name), self._relation(staged, name)
        if now is not None:
            if own is not None and own["changed"] != now["changed"] and (name in shared or name not in self._local.touched):
                if self._local.isolation != "read committed":
                    raise SerializationFailure(STALE)
                fresh = self._joined(name, own, copy.deepcopy(now)) if name in shared else copy.deepcopy(now)
                staged["tables" if name in staged["tables"] else "views"][name] = fresh
            staged.setdefault("began", {})[name] = now["changed"]
        if kind == SHARED:
            shared[name] = len(now["files"]) if now is not None else 0
        else:
            shared.pop(name, None)
        self._local.touched.add(name)

    def _now(self) -> dict:
        staged = getattr(self._local, "staged", None)
        return self.catalog if staged is None else staged

    # -- tables

    def create_table(self, name: str, rows: DataFrame, primary_key: list[str] | None = None, row_filter: dict[str, str] | None = None, cluster_by: list[str] | None = None) -> int:
        """A table of the rows' schema, holding them. row_filter: SQL condition by owner. Files are in an
        order of cluster_by, by default of the primary key."""
        with self._statement() as catalog:
            if self._relation(catalog, name):
                raise EngineError(f'relation "{name}" already exists')
            self._take(name)
            order = cluster_by or primary_key or []
            file, seen = self.store.observed(rows.withColumn(W, F.lit(1).cast("long")), [F.count(F.lit(1)).alias("n")], order)
            catalog["tables"][name] = {"schema": rows.schema.json(), "key": primary_key or [], "order": order, "files": [file], "changed": 1, "filter": row_filter or {}}
        return seen.get("n", 0)

    def set_row_filter(self, table: str, owner: str, condition: str | None) -> None:
        """Which rows an owner's views see from now on, None for all; these views are filled anew."""
        with self._statement() as catalog:
            self._guard(table)
            self._take(table)
            t = catalog["tables"][table]
            self._state(table, catalog).where(condition or "true")  # a condition that can't be resolved fails here
            t["filter"] = {o: c for o, c in t["filter"].items() if o != owner} | ({owner: condition} if condition else {})
            t["changed"] += 1
            for name, v in catalog["views"].items():
                if table in v["tables"].values() and v["owner"] == owner and v["maintained"]:
                    self._take(name)
                    self._fill(name, catalog)

    def table_schema(self, name: str) -> T.StructType:
        return _schema(self._now()["tables"][name]["schema"])

    def rename_table(self, old: str, new: str) -> None:
        """Views follow: they know a table by what it was called when they were defined."""
        with self._statement() as catalog:
            if self._relation(catalog, new):
                raise EngineError(f'relation "{new}" already exists')
            self._take(old), self._take(new)
            catalog["tables"][new] = catalog["tables"].pop(old)
            for name, v in catalog["views"].items():
                if old in v["tables"].values():
                    self._take(name)
                    v["tables"] = {k: new if t == old else t for k, t in v["tables"].items()}
                    v["columns"] = {new if t == old else t: c for t, c in v["columns"].items()}

    def rename_column(self, table: str, old: str, new: str) -> None:
        with self._statement() as catalog:
            self._take(table)
            t = catalog["tables"][table]
            schema = _schema(t["schema"])
            if old not in schema.names:
                raise EngineError(f'column "{old}" does not exist')
            if new in schema.names:
                raise EngineError(f'column "{new}" of relation "{table}" already exists')
            fields = [T.StructField(new if f.name == old else f.name, f.dataType, f.nullable) for f in schema.fields]
            # files keep the name that they were written with
            t |= {"stored": t.get("stored", schema.names), "schema": T.StructType(fields).json(), "key": [new if k == old else k for k in t["key"]], "order": [new if k == old else k for k in t["order"]], "changed": t["changed"] + 1}
            for name, v in catalog["views"].items():
                if table in v["tables"].values():
                    self._take(name)
                    v["columns"].setdefault(table, {})
                    names_ = {a: (new if b == old else b) for a, b in v["columns"][table].items()}
                    v["columns"][table] = names_ | ({old: new} if old not in names_ and new not in names_.values() else {})

    def drop_table(self, name: str, cascade: bool = False) -> None:
        with self._statement() as catalog:
            if name not in catalog["tables"]:
                raise EngineError(f'table "{name}" does not exist')
            on = [v for v, d in catalog["views"].items() if name in d["tables"].values()]
            if on and not cascade:
                raise EngineError(f"cannot drop table {name} because other objects depend on it")
            for v in on:
                self._take(v)
                del catalog["views"][v]
            self._take(name)
            del catalog["tables"][name]

    # -- changes

    def insert(self, table: str, rows: DataFrame) -> None:
        self.apply({table: ChangeSet(inserted=rows)})

    def delete(self, table: str, where: str | Column | None = None) -> None:
        with self._statement() as catalog:
            self._guard(table)
            self._take(table)
            rows = self._state(table, catalog)
            rows = rows if where is None else rows.where(where)
            self._apply({table: [rows.withColumn(W, -F.col(W))]})

    def update(self, table: str, values: dict[str, str | Column], where: str | Column | None = None) -> None:
        with self._statement() as catalog:
            self._guard(table)
            self._take(table)
            rows = self._state(table, catalog)
            old = rows if where is None else rows.where(where)
            schema = self.table_schema(table)
            if missing := set(values) - set(schema.names):
                raise EngineError(f'column "{min(missing)}" of relation "{table}" does not exist')
            new = old.select(*[(F.expr(values[c]) if isinstance(values[c], str) else values[c]).cast(schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in schema.names], W)
            self._apply({table: [new, old.withColumn(W, -F.col(W))]})

    def _guard(self, name: str) -> None:
        if name in self._now()["views"]:
            raise EngineError(WRITE % name)
        if name not in self._now()["tables"]:
            raise EngineError(f'table "{name}" does not exist')

    def apply(self, changes: dict[str, ChangeSet]) -> None:
        """One statement that changes tables, and every view of them."""
        with self._statement() as catalog:
            for name in sorted(changes):
                self._guard(name)
            parts: dict[str, list[DataFrame]] = {}
            for name, c in changes.items():
                if c.deleted is not None:
                    self._take(name)
                fields = self.table_schema(name).fields
                parts[name] = [x.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields], F.lit(w).cast("long").alias(W)) for x, w in ((c.inserted, 1), (c.deleted, -1)) if x is not None]
            self._apply({n: p for n, p in parts.items() if p}, {n for n, c in changes.items() if c.deleted is not None})

    def _apply(self, changes: dict[str, list[DataFrame]], unsure: set[str] = frozenset()) -> None:
        """changes: by table, parts with weights. unsure: tables of which rows may be taken that aren't there."""
        catalog = self._local.staged
        on = sorted({v for v, d in catalog["views"].items() if set(d["tables"].values()) & set(changes) and d["maintained"]})
        adds = not unsure and all(n not in self._local.touched or n in self._local.shared for n in changes)
        kind = SHARED if adds and len(changes) == 1 and all(self._view(v, catalog).alone() for v in on) else EXCLUSIVE
        for name in [*sorted(changes), *on]:
            self._take(name, kind)
        with self.store.planned(self._files({*changes, *on, *(t for v in on for t in catalog["views"][v]["tables"].values())}, catalog)):
            self._carried_out(changes, unsure, on, kind)

    def _carried_out(self, changes: dict[str, list[DataFrame]], unsure: set[str], on: list[str], kind: str) -> None:
        catalog = self._local.staged
        before = copy.deepcopy(catalog["tables"])
        deltas: dict[str, DataFrame] = {}
        ranges: dict[str, dict] = {}
        for name, parts in changes.items():
            t, schema = catalog["tables"][name], self.table_schema(name)
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            if len(parts) > 1 or name in unsure:
                rows = netted(rows, schema.names)
            file, seen = self._written(name, rows, catalog)
            if name in unsure and seen["taken"]:
                first = file
                file, seen = self._written(name, self._there(name, self._rows(name, catalog, [first]), catalog, seen["taken"]), catalog)
                self.store.drop([first])
            if not seen["n"]:
                self.store.drop([file])
                continue
            deltas[name] = self._rows(name, catalog, [file])
            ranges[name] = {f.name: (seen[f"lo{i}"], seen[f"hi{i}"]) for i, f in enumerate(schema.fields) if seen.get(f"lo{i}") is not None}
            t["files"], t["changed"] = [*t["files"], file], t["changed"] + 1
            t["signed"] = t.get("signed", False) or seen["taken"] > 0
        for v in on:
            if set(catalog["views"][v]["tables"].values()) & set(deltas):
                self._maintain(v, catalog, before, deltas, ranges)
        for name in deltas if kind == EXCLUSIVE else ():
            t = catalog["tables"][name]
            if len(t["files"]) > FOLD:
                at, cols = self.store.tail(t["files"]), self.table_schema(name).names
                rows = self._rows(name, catalog, t["files"][at:])
                if t.get("signed"):
                    rows = netted(rows, cols)
                stored = t.get("stored", cols)
                folded = self.store.write(rows.toDF(*stored, W), [stored[cols.index(k)] for k in t["order"]])
                t["files"] = [*t["files"][:at], folded]
                t["signed"] = bool(at and t.get("signed"))

    def _files(self, relations: Iterable[str], catalog: dict) -> list[str]:
        return [f for n in relations for f in self._relation(catalog, n)["files"]]

    def _written(self, name: str, rows: DataFrame, catalog: dict) -> tuple[str, dict]:
        """A new file of a table's change, with its numbers of rows and ranges."""
        schema, t = self.table_schema(name), catalog["tables"][name]
        seen = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(W) < 0).alias("taken")]
        stored = t.get("stored", schema.names)
        for i, f in enumerate(schema.fields):
            if isinstance(f.dataType, RANGED):
                seen += [F.min(f"`{stored[i]}`").alias(f"lo{i}"), F.max(f"`{stored[i]}`").alias(f"hi{i}")]
        file, found = self.store.observed(rows.select(*[F.col(f"`{c}`") for c in schema.names], W).toDF(*stored, W), seen)
        return file, {"n": 0, "taken": 0} | found

    def _there(self, name: str, change: DataFrame, catalog: dict, n: int) -> DataFrame:
        """A netted change, n of whose rows are taken, without the copies of these that the table does not have."""
        cols = self.table_schema(name).names
        gone, zero = change.where(F.col(W) < 0), F.lit(0).cast("long")
        held = among(self._rows(name, catalog), gone, cols, n).withColumn("__g", zero)
        both = held.unionByName(gone.select(*[F.col(f"`{c}`") for c in cols], zero.alias(W), (-F.col(W)).alias("__g")))
        summed = both.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum(W).alias(W), F.sum("__g").alias("__g"))
        taken = summed.select(*[F.col(f"`{c}`") for c in cols], (-F.least(W, "__g")).alias(W))
        return change.where(F.col(W) > 0).unionByName(taken.where(F.col(W) < 0))

    def truncate(self, table: str) -> None:
        self._guard(table)
        with self._statement() as catalog:
            self._take(table)
            t = catalog["tables"][table]
            t |= {"files": [], "signed": False, "changed": t["changed"] + 1}
            for name, v in catalog["views"].items():
                if table in v["tables"].values() and v["maintained"]:
                    self._take(name)
                    view = self._view(name, catalog)
                    if view.kind == "aggregate" and not view.keys or view.outer():
                        self._fill(name, catalog)
                    else:
                        v |= {"files": [], "signed": False, "changed": v["changed"] + 1}

    def begin_batch(self, table: str, source: str, number: int) -> bool:
        """Notes in the transaction that a source's batch goes into table; False if it is there already."""
        self._guard(table)
        self._take(table)
        done = self._local.staged["tables"][table].setdefault("batches", {})
        if number <= done.get(source, -1):
            return False
        done[source] = number
        return True

    def vacuum(self) -> int:
        """Deletes files that no relation has any more, and returns their number. Not for use while
        statements run or rows that were read before are still needed."""
        with self._lock:
            held = {f for kind in ("tables", "views") for d in self.catalog[kind].values() for f in d["files"]}
            gone = [f for f in self.store.files() if f not in held]
            self.store.drop(gone)
        return len(gone)

    # -- states

    def _rows(self, name: str, catalog: dict, files: list[str] | None = None) -> DataFrame:
        t = catalog["tables"][name]
        schema = _schema(t["schema"])
        stored = t.get("stored", schema.names)
        held = T.StructType([*[T.StructField(s, f.dataType) for s, f in zip(stored, schema.fields)], T.StructField(W, T.LongType())])
        df = self.store.read(t["files"] if files is None else files, held)
        return df if stored == schema.names else df.toDF(*schema.names, W)

    def _state(self, name: str, catalog: dict, files: list[str] | None = None, owner: str | None = None, raw: bool = False) -> DataFrame:
        """A table's rows as its owner's filter shows them; with positive weights unless raw."""
        t = catalog["tables"][name]
        df = self._rows(name, catalog, files)
        if t.get("signed") and (not raw or owner in t["filter"]):
            df = netted(df, _schema(t["schema"]).names)
        return df.where(t["filter"][owner]) if owner in t["filter"] else df

    def _tables(self, name: str, catalog: dict, before: dict, deltas: dict[str, DataFrame], raw: bool = False):
        """What a view's plan reads, under the names that the definition uses."""
        v = catalog["views"][name]

        def table(called: str, when: str) -> DataFrame | None:
            real = v["tables"][called]
            owner, condition = v["owner"], catalog["tables"][real]["filter"]
            if when == "delta":
                df = deltas.get(real)
                df = df.where(condition[owner]) if df is not None and owner in condition else df
            else:
                df = self._state(real, catalog, before[real]["files"] if when == "pre" else None, owner, raw)
            if df is None:
                return None
            for a, b in v["columns"].get(real, {}).items():
                df = df.withColumnRenamed(b, a)
            return df

        return table

    def _view(self, name: str, catalog: dict) -> ir.View:
        """The view's plan, analyzed anew over its tables as they are."""
        v = catalog["views"][name]
        schemas = self._called(v, catalog)
        of = json.dumps([v["sql"], v["names"], {c: s.json() for c, s in schemas.items()}])
        if of not in self._views:
            self._views[of] = self._analyzed(v["sql"], schemas, set(), v["names"])
        return self._views[of]

    def _called(self, v: dict, catalog: dict) -> dict[str, T.StructType]:
        """Schemas of a view's tables, by the names that its definition uses."""
        out = {}
        for called, real in v["tables"].items():
            names_ = {b: a for a, b in v["columns"].get(real, {}).items()}
            out[called] = T.StructType([T.StructField(names_.get(f.name, f.name), f.dataType, f.nullable) for f in _schema(catalog["tables"][real]["schema"]).fields])
        return out

    def _analyzed(self, sql: str, schemas: dict[str, T.StructType], views: set[str], listed: list[str]) -> ir.View:
        with self._lock:
            # a session of its own for the tables' names, with the functions that are registered by now
            self._scratch = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
            frames = {called: self._scratch.createDataFrame([], schema) for called, schema in schemas.items()}
            for called, df in frames.items():
                df.createOrReplaceTempView(called)
            view = analyze.Definition(self._scratch, sql, views, frames).analyze()
        if len(listed) > len(view.visible):
            raise EngineError("too many column names were specified")
        called = dict(zip(view.visible, listed)) if len(set(view.visible)) == len(view.visible) else {}
        view.visible = [*listed, *view.visible[len(listed) :]]
        for a in view.aggs:
            a.name = called.get(a.name, a.name)
        if len({x.lower() for x in view.visible}) < len(view.visible):
            double = next(x for x in view.visible if [y.lower() for y in view.visible].count(x.lower()) > 1)
            raise EngineError(f'column "{double}" specified more than once')
        for x in view.visible:
            if x.startswith("__ivm_"):
                analyze.refuse("column_name", x)
        return view

    # -- views

    def create_view(self, name: str, sql: str, owner: str = "", with_data: bool = True) -> int:
        """Registers and fills a view; name may list columns. Returns its number of rows."""
        plain, listed = names.parse(name)
        with self._statement() as catalog:
            if self._local.isolation != "read committed":
                warnings.warn("inconsistent view can be created in isolation level SERIALIZABLE or REPEATABLE READ", stacklevel=3)
            self._register(plain, listed, sql, owner, catalog)
            self._note_keys(plain, catalog)
            if with_data:
                return self._fill(plain, catalog)
        return 0

    def _register(self, plain: str, listed: list[str], sql: str, owner: str, catalog: dict) -> ir.View:
        if self._relation(catalog, plain):
            raise EngineError(f'relation "{plain}" already exists')
        schemas = {t: _schema(d["schema"]) for t, d in catalog["tables"].items()}
        view = self._analyzed(sql, schemas, set(catalog["views"]), listed)
        self._take(plain)
        v = catalog["views"][plain] = {"sql": sql, "names": listed, "owner": owner, "tables": {t: t for t in view.tables()}, "columns": {}, "files": [], "maintained": False, "populated": False, "signed": False, "changed": 1, "keys": []}
        empty = lambda called, when: self.spark.createDataFrame([], T.StructType([*schemas[called].fields, T.StructField(W, T.LongType())]))
        v["schema"] = merge.stored(self._view(plain, catalog), Delta(empty).post(self._view(plain, catalog).body)).schema.json()
        return view

    def _note_keys(self, name: str, catalog: dict) -> None:
        """The keys by which the view's rows are told apart, or a notice that it has none."""
        v, view = catalog["views"][name], self._view(name, catalog)
        if view.kind == "aggregate":
            v["keys"] = view.keys
            if not view.keys:
                return
        elif view.kind == "distinct":
            v["keys"] = view.visible
        else:
            wanted, plain = [], _plain(view)
            for n in ir.walk(view.body):
                if isinstance(n, ir.Scan) and not any(isinstance(x, ir.Exists) and n in list(ir.walk(x.inner)) for x in ir.walk(view.body)):
                    key = catalog["tables"][v["tables"][n.table]]["key"]
                    wanted.append([plain.get(n.cols[n.source.index(k)]) for k in key] or [None])
            flat = [k for keys in wanted for k in keys]
            v["keys"] = flat if flat and None not in flat else []
        if v["keys"]:
            self.notices.append(f'created index "{name.split(".")[-1]}_index" on immv "{name.split(".")[-1]}"')
        else:
            self.notices.append(NO_KEY % name.split(".")[-1])

    def _fill(self, name: str, catalog: dict) -> int:
        """Writes a view from its tables as they are; its number of rows."""
        v, view = catalog["views"][name], self._view(name, catalog)
        tables = self._tables(name, catalog, catalog["tables"], {})
        n = F.sum(W) if view.kind == "bag" else F.count(F.lit(1))
        with self.store.planned(self._files(v["tables"].values(), catalog)):
            rows = merge.stored(view, Delta(tables).post(view.body))
            file, seen = self.store.observed(self._shaped(rows, v), [n.alias("n")], v["keys"])
        v |= {"files": [file], "signed": False, "maintained": True, "populated": True, "changed": v["changed"] + 1}
        return seen.get("n") or 0

    def _shaped(self, rows: DataFrame, v: dict) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in _schema(v["schema"]).fields])

    def _maintain(self, name: str, catalog: dict, before: dict, deltas: dict[str, DataFrame], ranges: dict[str, dict]) -> None:
        v, view = catalog["views"][name], self._view(name, catalog)
        # rows that were taken away may be read beside what took them where no expression fails on them
        signed = lambda called: view.total and catalog["tables"][v["tables"][called]].get("signed", False)

        def known(called: str) -> dict:
            real = v["tables"][called]
            names_ = {b: a for a, b in v["columns"].get(real, {}).items()}
            return {names_.get(c, c): r for c, r in ranges.get(real, {}).items()}

        delta = Delta(self._tables(name, catalog, before, deltas, view.total), signed, known)
        change = delta.delta(view.body)
        if change is None:
            return
        at, schema = v["changed"] + 1, _schema(v["schema"])
        seen = [F.count(F.lit(1)).alias("n")]
        if merge.extremes(view):
            # what cancels out is neither a new nor a lost extreme
            part = merge.partial(view, netted(change, [c for c in change.columns if c != W])).persist()
            fresh = merge.touched(view, self.store.read(v["files"], schema), part, at)
            file, found = self.store.observed(fresh, [*seen, F.count_if(merge.STALE).alias("stale")])
            part.unpersist()
            if found.get("stale"):
                first = file
                file = self.store.write(self._shaped(merge.again(view, self.store.read([first], fresh.schema), delta, at), v))
                self.store.drop([first])
        else:
            part = self._shaped(merge.partial(view, change), v)
            taken = [F.count_if(F.col(W) < 0).alias("taken")] if view.kind != "aggregate" else []
            file, found = self.store.observed(part, [*seen, *taken])
            v["signed"] = v["signed"] or bool(found.get("taken"))
        if not found.get("n"):
            self.store.drop([file])
            return
        v |= {"files": [*v["files"], file], "changed": at}
        if len(v["files"]) > FOLD and name not in self._local.shared:
            first = self.store.tail(v["files"])
            rows = merge.summed(view, self.store.read(v["files"][first:], schema), not first)
            v["files"] = [*v["files"][:first], self.store.write(self._shaped(rows, v), v["keys"])]
            v["signed"] = bool(first and v["signed"])

    def refresh_view(self, name: str, with_data: bool = True) -> int:
        with self._statement() as catalog:
            self._own(name, catalog)
            self._take(name)
            v = catalog["views"][name]
            if with_data:
                self._views.clear()  # functions may have been registered anew
                return self._fill(name, catalog)
            v |= {"files": [], "signed": False, "maintained": False, "populated": False, "changed": v["changed"] + 1}
        return 0

    def restore_view(self, name: str, sql: str, rows: DataFrame | None = None, populate: bool = False, owner: str = "") -> None:
        """Registers a view over stored rows (all columns, hidden ones too), checked against the
        definition and taken as they are; without rows, or to populate it, its query is run."""
        plain, listed = names.parse(name)
        with self._statement() as catalog:
            if plain in catalog["views"]:
                raise EngineError(f'relation "{plain}" is already registered as an IMMV')
            view = self._register(plain, listed, sql, owner, catalog)
            self._note_keys(plain, catalog)
            v = catalog["views"][plain]
            if rows is not None:
                stored = self.store.read([], _schema(v["schema"]))
                want = merge.read(view, stored, True).drop(W).schema
                for f in want.fields:
                    if f.name not in rows.columns:
                        raise EngineError(f'table is missing column "{f.name}"')
                    if rows.schema[f.name].dataType != f.dataType:
                        raise EngineError("table definition mismatch with view definition")
                if len(rows.columns) > len(want.fields):
                    raise EngineError("too many columns in table")
            if rows is None or populate:
                self._fill(plain, catalog)
                return
            rows = rows.withColumn(W, F.col(merge.COUNT) if view.kind == "distinct" else F.lit(1).cast("long")).withColumn(merge.AT, F.lit(0).cast("long"))
            v |= {"files": [self.store.write(self._shaped(rows, v), v["keys"])], "maintained": True, "populated": True}

    def drop_view(self, name: str) -> None:
        with self._statement() as catalog:
            self._own(name, catalog)
            self._take(name)
            del catalog["views"][name]

    def rename_view(self, old: str, new: str) -> None:
        with self._statement() as catalog:
            self._own(old, catalog)
            if self._relation(catalog, new):
                raise EngineError(f'relation "{new}" already exists')
            self._take(old), self._take(new)
            catalog["views"][new] = catalog["views"].pop(old)

    def _own(self, name: str, catalog: dict) -> dict:
        if name in catalog["tables"]:
            raise EngineError(f'relation "{name}" is not an IMMV')
        if name not in catalog["views"]:
            raise EngineError(f'relation "{name}" does not exist')
        v = catalog["views"][name]
        if v["owner"] and self.user not in ("", v["owner"]):
            raise EngineError(OWNER % name)
        return v

    # -- reading

    def read(self, name: str, hidden: bool = False) -> DataFrame:
        """A relation's rows. A view whose files are a state already is read without a shuffle, and a
        condition on its keys skips files' row groups."""
        catalog = self._now()
        if name in catalog["tables"]:
            return expanded(self._state(name, catalog), self.table_schema(name).names)
        if name not in catalog["views"]:
            raise EngineError(f'relation "{name}" does not exist')
        v, view = catalog["views"][name], self._view(name, catalog)
        settled = len(v["files"]) <= 1 if view.kind == "aggregate" else not v["signed"] if view.kind == "bag" else len(v["files"]) <= 1 and not v["signed"]
        if view.kind == "aggregate" and not view.keys and not v["files"]:
            settled = False  # the one row of nothing
        out = merge.read(view, self.store.read(v["files"], _schema(v["schema"])), settled)
        if merge.extremes(view) and settled and view.keys:
            out = out.where(F.col(merge.COUNT) > 0)
        if not v["populated"]:
            out = out.limit(0)
        if view.kind == "bag":
            return expanded(out, [*view.visible, *(view.exists if hidden else [])])
        return out if hidden else out.select(*[F.col(f"`{c}`") for c in view.visible])

    def view_definition(self, name: str) -> str | None:
        """The definition with the names that tables, columns and outputs have now; None if there is no such view."""
        catalog = self._now()
        v = catalog["views"].get(name)
        return v and self._text(v, catalog, self._view(name, catalog).visible if v["names"] else [])

    def _text(self, v: dict, catalog: dict, outputs: list[str]) -> str:
        known = {called: s.names for called, s in self._called(v, catalog).items()}
        return deparse.current(self.spark, v["sql"], v["tables"], v["columns"], known, outputs)

    def is_view(self, name: str) -> bool:
        return name in self._now()["views"]

    def catalog_df(self) -> DataFrame:
        rows = [(n, v["sql"], v["populated"], v["changed"], v["owner"]) for n, v in sorted(self._now()["views"].items())]
        return self.spark.createDataFrame(rows, "view string, viewdef string, ispopulated boolean, last_update_version long, owner string")

    def _command(self, function: str) -> Iterator[str]:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        catalog = self._now()
        for n, v in sorted(catalog["views"].items()):
            full = ".".join(names.quoted(x) for x in n.split(".")) + (f"({', '.join(map(names.quoted, v['names']))})" if v["names"] else "")
            yield f"SELECT {function}({quote(full)}, {quote(self._text(v, catalog, []))});"

    def create_commands(self) -> list[str]:
        return list(self._command("create_immv"))

    def restore_commands(self) -> list[str]:
        return list(self._command("restore_immv"))

    def run(self, command: str) -> int | str | None:
        """Carries out a command as create_commands() and restore_commands() print them, or one of
        refresh_immv and get_immv_def."""
        function, args = names.call(command)
        if function == "create_immv" and len(args) == 2:
            return self.create_view(*args)
        if function == "restore_immv" and len(args) in (2, 3):
            return self.restore_view(args[0], args[1], populate=len(args) == 3 and args[2])
        if function == "refresh_immv" and len(args) in (1, 2):
            return self.refresh_view(names.parse(args[0])[0], *args[1:])
        if function == "get_immv_def" and len(args) == 1:
            return self.view_definition(names.parse(args[0])[0])
        raise EngineError(f"no function {function} of {len(args)} arguments")


def _plain(view: ir.View) -> dict[str, str]:
    """Body columns, through projections, that visible columns show as they are."""
    out = {s: v for v, s in zip(view.visible, view.source)}
    node = view.body
    while isinstance(node, (ir.Project, ir.Filter, ir.Exists)):
        if isinstance(node, ir.Project):
            for c, e in zip(node.cols, node.plain):
                if e is not None and c in out:
                    out[e] = out[c]
        node = node.child
    return out
