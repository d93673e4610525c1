"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed place in [0, 2**40) given by a hash of its id. A
source's share of its words is then a threshold on that place: the words of a
(source, bucket) histogram are summed, the bucket in which the budget ends is
found, and only that bucket is split again, ten bits at a time, until its last
cell. The choice is a filter on the hash, so nothing is sorted, reruns agree,
and a larger budget always keeps what a smaller one kept.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.llm.common import materialize

#: Levels of the histogram and bits of each: 4 x 10 bits of the hash.
LEVELS, BITS = 4, 10
CELLS = 1 << BITS
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def word_count(text: Column) -> Column:
    """Number of words: places where a word starts. Null: 0."""
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    starts = F.length(F.regexp_replace(spaced, r"[^ ]+", "x")) - F.length(F.regexp_replace(spaced, r"[^ ]+", ""))
    return F.coalesce(starts, F.lit(0)).cast("bigint")


def place(doc_id: Column) -> Column:
    """Place of a document: the first 40 bits of the MD5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 10), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source: its size and its target in words.

    Sources stand in order of code points, null last, and weigh ``weights``
    repeating. Each gets the level ``share x total`` allows by weight; none gets
    more than ``repeats`` times its size and what is over is shared again. The
    level is found in closed form: with sources ordered by cap / weight, the
    first k are capped for the least k at which the level suits the next one.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / F.sum("_weight").over(onward))
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    # the level rises while capped sources are set aside and falls after: the first that fits is the largest of those that fit
    per = per.withColumn("_level", F.max(fits).over(all_rows))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight")))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole passes over it and the place below which documents are
    taken once more.

    Of the last cell the documents are all taken or all left, whichever comes
    nearer to the target.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("bigint"))
    found = goals.withColumn("_want", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("edge", F.lit(0).cast("bigint"))
    rows = sized.withColumn("_place", place(F.col("doc_id")))
    for level in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - level))
        bounds = found.select(F.col("source").alias("_s"), "edge", "_want")
        same = F.col("source").eqNullSafe(F.col("_s"))
        inside = rows.join(bounds, same).filter((F.col("_place") >= F.col("edge")) & (F.col("_place") < F.col("edge") + F.lit(width * CELLS)))
        cell = F.floor((F.col("_place") - F.col("edge")) / F.lit(width)).cast("bigint")
        hist = inside.groupBy("source", cell.alias("_cell")).agg(F.sum("size").alias("_words"))
        hist = hist.withColumn("_upto", F.sum("_words").over(Window.partitionBy("source").orderBy("_cell")))
        over = hist.join(bounds, same).filter(F.col("_upto") > F.col("_want"))
        last = over.groupBy("source").agg(F.min(F.struct("_cell", "_upto", "_words")).alias("_e"))
        last = last.select(F.col("source").alias("_s"), "_e._cell", "_e._upto", "_e._words")
        found = found.join(last, same, "left").drop("_s")
        reached = F.col("_cell").isNotNull()
        edge = F.when(reached, F.col("edge") + F.col("_cell") * F.lit(width)).otherwise(F.lit(1 << (BITS * LEVELS)))
        want = F.when(reached, F.col("_want") - (F.col("_upto") - F.col("_words"))).otherwise(F.lit(0.0))
        if level == LEVELS - 1:
            edge = edge + F.when(reached & (F.col("_words") - want < want), 1).otherwise(0)
        found = materialize(found.select("source", "source_size", "target", "epochs", edge.alias("edge"), want.alias("_want")), "mixing-bounds")
    return found.drop("_want")


def copies(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add ``copies``, how often a document stands in the mix, and its source's figures."""
    bounds = bounds.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "edge")
    more = (place(F.col("doc_id")) < F.col("edge")) & (F.col("epochs") * F.col("source_size") < F.col("target"))
    times = F.col("epochs") + F.when(more, 1).otherwise(0)
    return rows.join(bounds, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", times).drop("_s", "epochs", "edge")


def _plan(documents: DataFrame, weights, share, repeats) -> tuple[DataFrame, DataFrame]:
    sized = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    return sized, thresholds(sized, targets(sized, weights, share, repeats))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document.

    Null or empty texts have size 0 and take part with no words (``taken`` 0).
    Equal doc_ids of a source share a place and are taken or left together. A
    null doc_id has the place of an empty id. An empty table gives no rows;
    other columns are ignored.
    """
    sized, bounds = _plan(documents, weights, share, repeats)
    return copies(sized, bounds).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns unchanged."""
    _, bounds = _plan(documents, weights, share, repeats)
    key = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    key = key.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"))
    rows = copies(key, bounds).filter("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")
