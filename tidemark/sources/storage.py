"""Relations as immutable signed Parquet files and a catalog of them.

A relation's state is the bag sum of its files: rows carry a weight, positive for copies added and
negative for copies taken. A statement writes its delta only; once a relation has many files, those
that are small beside their successors are folded, so a large file is seldom written again. Files of
a relation with keys are written in ranges of them, so that row groups can be skipped by key. The
catalog is JSON, one file per version, which a rename publishes: readers see all of a transaction or
nothing, and a version that another driver has published is refused. (The rename itself refuses where
the file system's does, as HDFS's; elsewhere a look before it does.)
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationFailure

W = "__w"
#: Files of a relation before some are folded; a file is folded with those after it once they have this
#: share of its bytes.
FOLD, SHARE = 8, 0.5
#: Copies of a row that are made from one array; more take several.
COPIES = 4096
#: Bytes up to which a side of a join is sent through the driver to all executors. A statement has as many
#: such joins as views times tables, so what they send together has to be little beside a driver's memory.
BROADCAST = 256 << 10
#: Bytes that a task of a statement reads of a shuffle: what it holds in sorts is many times as much, and a
#: shuffle's partitions as many as its tables' files have bytes for.
TASK = 8 << 20
#: Places that a map of rows has for each, and that one of its pieces has, as bitmap_construct_agg makes them.
PLACES, PIECE = 16, 32768
TAKEN = "another driver has published version %d"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._local = threading.local()

    @contextmanager
    def planned(self, files: list[str]) -> Iterator[None]:
        """What this thread reads inside is planned in a session of its own, for many joins of any size.
        files: what they read."""
        outer = getattr(self._local, "spark", None)
        size = sum(self.size(f) for f in files)
        own = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        limit = own._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        own.conf.set("spark.sql.autoBroadcastJoinThreshold", str(min(limit, BROADCAST)))
        partitions = max(int(own.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
        own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
        own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK))
        self._local.spark = own
        try:
            yield
        finally:
            self._local.spark = outer

    def write(self, df: DataFrame, keys: list[str] | None = None) -> str:
        """A new file of df, by its name; in ranges of keys if there are some."""
        return self.observed(df, [], keys)[0]

    def observed(self, df: DataFrame, seen: list[Column], keys: list[str] | None = None) -> tuple[str, dict]:
        """A new file of df, and aggregates of its rows from the job that writes it."""
        where = f"data/{uuid.uuid4().hex}"
        if keys:
            by = [F.col(f"`{k}`") for k in keys]
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        if not seen:
            df.write.parquet(f"{self.path}/{where}")
            return where, {}
        found = Observation()
        df.observe(found, *seen).write.parquet(f"{self.path}/{where}")
        return where, found.get

    def read(self, files: list[str], schema: T.StructType) -> DataFrame:
        spark = getattr(self._local, "spark", None) or self.spark
        if not files:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def drop(self, files: list[str]) -> None:
        for f in files:
            self._fs.delete(self._path(f"{self.path}/{f}"), True)

    def size(self, file: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.path}/{file}")).getLength()

    def tail(self, files: list[str]) -> int:
        """From which of the files on to fold: two at least, and each that is not large beside the rest."""
        sizes = [self.size(f) for f in files]
        at, total = len(files) - 2, sum(sizes[-2:])
        while at > 0 and SHARE * sizes[at - 1] <= total:
            at -= 1
            total += sizes[at]
        return at

    def files(self) -> list[str]:
        where = self._path(f"{self.path}/data")
        return [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def save(self, catalog: dict) -> None:
        version = catalog["version"]
        to, tmp = self._path(f"{self.path}/catalog-{version:012d}.json"), self._path(f"{self.path}/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(catalog).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise SerializationFailure(TAKEN % version)
        # the one before stays for those who are about to read it
        self._fs.delete(self._path(f"{self.path}/catalog-{version - 2:012d}.json"), False)

    def load(self) -> dict:
        found = self._fs.globStatus(self._path(f"{self.path}/catalog-*.json"))
        if not found:
            return {"version": 0, "tables": {}, "views": {}}
        stream = self._fs.open(self._path(f"{self.path}/{max(s.getPath().getName() for s in found)}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)


def netted(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with each different row once, its weights summed, zeros gone."""
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def expanded(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each row as often as its weight says; a row of very many copies by several arrays."""
    rounds = df.where(F.col(W) > 0).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({W} - 1) div {COPIES}"))))
    left = F.least(F.lit(COPIES).cast("long"), F.col(W) - F.col("__i") * COPIES).cast("int")
    return rounds.select(*[F.col(f"`{c}`") for c in cols], F.explode(F.array_repeat(F.lit(1), left)).alias("__i")).drop("__i")


def among(df: DataFrame, some: DataFrame, cols: list[str], n: int) -> DataFrame:
    """Rows of df that may be among the n rows of some: those with a mark at the place of their hash. The
    others, but for a sixteenth at most, are gone before anything is shuffled."""
    size = max(PIECE, 1 << (PLACES * n - 1).bit_length())
    # strings of other collations may be equal and have different hashes
    own = [F.col(f"`{c}`") for c in cols if "collat" not in df.schema[c].json().lower()]
    place = F.pmod(F.xxhash64(F.lit(0), *own), F.lit(size))
    piece, at = lambda p: F.shiftright(p, 15), lambda p: p.bitwiseAND(F.lit(PIECE - 1))
    marks = some.select(place.alias("__p")).groupBy(piece(F.col("__p")).alias("__piece")).agg(F.bitmap_construct_agg(at(F.col("__p"))).alias("__marks"))
    rows = df.withColumn("__p", place)
    byte = F.conv(F.hex(F.substring("__marks", F.shiftright(at(F.col("__p")), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(marks), piece(F.col("__p")) == F.col("__piece")).where(F.getbit(byte, at(F.col("__p")).bitwiseAND(F.lit(7)).cast("int")) == 1)
    return marked.select(*[F.col(f"`{c}`") for c in df.columns])
