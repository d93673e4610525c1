"""Clustering of one-dimensional positions per contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, chrom: str, pos: str, max_gap: int) -> DataFrame:
    """Add ``cluster_id``: a new cluster starts where the step from the previous
    position is more than ``max_gap`` (a step equal to it still joins).

    A negative gap counts as zero. Rows whose position is null form no cluster
    and get a null id.
    """
    gap = max(0, int(max_gap))
    w = Window.partitionBy(chrom).orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(w)
    known = df.filter(F.col(pos).isNotNull()).withColumn("_new", F.when(step <= gap, 0).otherwise(1))
    out = known.withColumn("cluster_id", F.sum("_new").over(w)).drop("_new")
    return out.unionByName(df.filter(F.col(pos).isNull()).withColumn("cluster_id", F.lit(None).cast("bigint")))


def greedy_segments(df: DataFrame, chrom: str, pos: str, valley_gap: int, max_span: int) -> DataFrame:
    """(chrom, start_pos, end_pos, n_positions): greedy cut of each gap cluster.

    Within a cluster of steps up to ``valley_gap``, a segment ends where the next
    position would stretch it beyond ``max_span`` from its own start. The cut
    depends on where the segment began, so positions (distinct ones) are folded
    in order; a fold sees one gap cluster, never a whole contig.
    """
    distinct = gap_clusters(df.select(chrom, pos).filter(F.col(pos).isNotNull()).distinct(), chrom, pos, valley_gap)
    ordered = distinct.groupBy(chrom, "cluster_id").agg(F.sort_array(F.collect_list(pos)).alias("_p"))
    seed = F.array().cast("array<struct<s:bigint,e:bigint,n:bigint>>")

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["s"].alias("s"), x.cast("bigint").alias("e"), (last["n"] + 1).alias("n"))
        fresh = F.struct(x.cast("bigint").alias("s"), x.cast("bigint").alias("e"), F.lit(1).cast("bigint").alias("n"))
        head = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(seed)
        return F.when((F.size(done) > 0) & (x - last["s"] <= max_span), F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    cut = ordered.select(chrom, F.explode(F.aggregate("_p", seed, step)).alias("_g"))
    return cut.select(chrom, F.col("_g.s").alias("start_pos"), F.col("_g.e").alias("end_pos"), F.col("_g.n").alias("n_positions"))


def merge_intervals(df: DataFrame, chrom: str, start: str, end: str) -> DataFrame:
    """Union of intervals per contig; touching ones (next start <= end so far) join."""
    order = Window.partitionBy(chrom).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(chrom, start, end).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(chrom, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_g")
