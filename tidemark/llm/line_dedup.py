"""Line dedup with DataFrame functions only.

Hashes of all lines are range-partitioned by (hash, document) and sorted by document, row and position
within. Streaming over that order marks the first occurrence of each line in each document; the marks of
a line are summed before they are shuffled, and are its number of documents. A very common line spreads
over as many partitions as its documents fill. Occurrences of lines found in enough documents come
back to their rows as keep bitmaps, never as text.

A bitmap is an array of 64-bit words, bit i % 64 of word i / 64 set if line i stays; words after the
last that drops a line are left out, so a document that keeps all its lines has an empty array.

Defined results: null or empty text is one empty line, which is kept; keys shorter than
min_key_chars are kept; a key repeated in one document counts one document; all rows of a doc_id are
one document, whatever their texts, and all rows with null doc_id are one, but each row keeps its own
lines; an empty table gives no rows. Other columns pass through, but for those named n_lines,
n_dropped and keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, drop

MIN_DOCS, MIN_KEY_CHARS = 10, 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and keep."""
    docs = docs.drop("n_lines", "n_dropped", "keep")
    by = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = by.select("d", "t", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_key_chars)
    hashed = cut(keyed.select(F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("g"), "d", "t", "pos"))
    ordered = hashed.repartitionByRange("h", "g", "d").sortWithinPartitions("h", "g", "d", "t", "pos")
    run = Window.partitionBy("h", "g", "d").orderBy("t", "pos")  # the order that is there already
    marked = cut(ordered.withColumn("first", F.row_number().over(run) == 1))
    drop(hashed)
    common = cut(marked.groupBy("h", "g").agg(F.count_if("first").alias("n")).where(F.col("n") >= min_docs).select("h", "g"))
    gone = marked.join(common, ["h", "g"]).select("d", "t", "pos")
    words = gone.groupBy("d", "t", F.expr("pos div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    found = words.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("ws"), F.sum(F.bit_count("bits")).alias("n"))
    # all-keep words fill the gaps before each word that drops something
    keep = "flatten(transform(ws, (x, i) -> concat(array_repeat(-1L, cast(x.w - if(i = 0, -1L, get(ws, i - 1).w) - 1 as int)), array(~x.bits))))"
    found = found.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.expr(keep).alias("keep"), F.col("n").alias("n_dropped"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left")
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.size(_lines(docs["text"])).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep", F.array().cast("array<bigint>")).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """text without the lines that the bitmap drops."""
    stays = F.filter(_lines(text), lambda _, i: F.coalesce(F.expr("1") == F.getbit(F.get(keep, F.floor(i / 64).cast("int")), i % 64), F.lit(True)))
    return F.when(F.size(keep) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))
