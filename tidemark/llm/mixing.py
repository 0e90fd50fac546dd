"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, its share of the target over its share of the documents. A
document's count inverts a Poisson distribution of that mean at a point in [0, 1) hashed from seed
and doc_id; the document is exploded by its count, and copies go to places hashed from seed, doc_id
and copy number: a global shuffle which another run repeats. Places are uniform in [0, 1), so partition
i of n takes those from i / n on, and nothing has to be sampled for ranges.

Defined results: sources without a weight share the weight `other`; null is a source like others;
a source of weight 0 disappears; an empty table gives no rows; rows with equal doc_id get equal
counts; a null doc_id is hashed as an empty one. Other columns pass through, but for those named
copy, rate and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 17
#: A higher rate is the sum of several draws of lower ones, as exp(-rate) would underflow.
MOST = 400.0


def point(*parts: Column) -> Column:
    """In [0, 1), from the first 12 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, rate: mean copies of each document of the source. epochs: the output's size in inputs."""
    sizes = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    weight = F.lit(float(other))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = cut(sizes.withColumn("weight", weight))
    total = sizes.agg(F.sum("n_docs").alias("docs"), F.sum("weight").alias("weight")).first()
    scale = (total["docs"] or 0) * float(epochs) / total["weight"] if total["weight"] else 0.0
    return sizes.select("source", "n_docs", (F.col("weight") * F.lit(scale) / F.col("n_docs")).alias("rate"))


def cumulative() -> str:
    """Poisson probabilities of at most 0, 1, ... up to where nothing is left to add, for SQL's expr()."""
    last = "cast(ceil(rate + 12 * sqrt(rate) + 20) as int)"
    return f"aggregate(sequence(1, {last}), named_struct('p', exp(-rate), 'c', array(exp(-rate))), (a, k) -> named_struct('p', a.p * rate / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * rate / k))), a -> a.c)"


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float = 1.0, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs, each as often as drawn, in shuffled order, with copy (from 0), rate and place."""
    docs = docs.drop("copy", "rate", "place")
    how = rates(docs, weights, other, epochs).withColumn("__parts", F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1)))
    how = cut(how.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), "__parts", (F.col("rate") / F.col("__parts")).alias("rate")).select("__source", "__rate", "__parts", F.expr(cumulative()).alias("__c")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = docs.join(how, docs["source"].eqNullSafe(F.col("__source"))).drop("__source")
    draw = lambda part: F.size(F.filter("__c", lambda c: c <= point(F.lit(str(seed)), part.cast("string"), key)))
    counted = drawn.withColumn("__n", F.when(F.col("__parts") == 1, draw(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("__parts").cast("int")), F.lit(0), lambda n, part: n + draw(part))))
    copies = counted.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__c", "__n", "__parts").withColumnRenamed("__rate", "rate")
    placed = copies.withColumn("place", point(F.lit(str(seed)), F.lit("place"), key, F.col("copy").cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionById(n, F.floor(F.col("place") * n).cast("int"))
    return dealt.sortWithinPartitions("place", "doc_id", "copy")
