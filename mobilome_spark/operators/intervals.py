"""Range joins as binned equi-joins.

Intervals are closed. Each is listed under every bin it touches and joined on
(contig, bin), so Spark plans a hash or sort-merge join and can split skewed
bins; an overlap that shares several bins is kept only in the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, start: str, end: str, width: int = 4096) -> DataFrame:
    """Every (point, interval) with start <= pos <= end on the same contig."""
    left = points.withColumn("_bin", F.floor(F.col(pos) / width))
    right = _bins(intervals, F.col(start), F.col(end), width)
    return left.join(right, [chrom, "_bin"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("_bin")


def tightest_interval(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, start: str, end: str, keys: list[str], width: int = 4096) -> DataFrame:
    """For each point (``keys``) the interval that holds it: the shortest, then the
    one whose middle is nearest, then the smallest start. Others are dropped."""
    found = points_in_intervals(points, intervals, chrom, pos, start, end, width)
    middle = F.floor((F.col(start) + F.col(end) + 1) / 2)
    best = Window.partitionBy(*keys).orderBy(F.col(end) - F.col(start), F.abs(middle - F.col(pos)), F.col(start))
    return found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def nearest_seed(points: DataFrame, seeds: DataFrame, chrom: str, pos: str, start: str, end: str, reach: int, keys: list[str], width: int = 4096) -> DataFrame:
    """Left join of each point to the seed within ``reach``: the nearest, then the
    smallest start; ``distance`` is 0 inside a seed and null where none is near."""
    wide = seeds.withColumn("_from", F.col(start) - reach).withColumn("_to", F.col(end) + reach)
    near = points_in_intervals(points, wide, chrom, pos, "_from", "_to", width).drop("_from", "_to")
    gap = F.greatest(F.col(start) - F.col(pos), F.col(pos) - F.col(end), F.lit(0))
    best = Window.partitionBy(*keys).orderBy("distance", start, end)
    kept = near.withColumn("distance", gap).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return points.join(kept.select(*keys, start, end, "distance"), keys, "left")


def overlaps(a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, width: int = 4096) -> DataFrame:
    """All overlapping pairs with ``overlap_bp``; each pair once."""
    left = _bins(a, F.col(a_start), F.col(a_end), width)
    right = _bins(b, F.col(b_start), F.col(b_end), width)
    low, high = F.greatest(a_start, b_start), F.least(a_end, b_end)
    pairs = left.join(right, [chrom, "_bin"]).filter((low <= high) & (F.col("_bin") == F.floor(low / width)))
    return pairs.withColumn("overlap_bp", high - low + 1).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, keys: list[str], fraction: float = 0.0, inverse: bool = False) -> DataFrame:
    """Rows of ``a`` that some one row of ``b`` overlaps by at least ``fraction`` of
    their own length, or with ``inverse`` those that none does."""
    hit = overlaps(a, b, chrom, a_start, a_end, b_start, b_end)
    hit = hit.filter(F.col("overlap_bp") >= F.lit(fraction) * (F.col(a_end) - F.col(a_start) + 1)).select(*keys).distinct()
    return a.join(hit, keys, "left_anti" if inverse else "left_semi")


def best_overlap(a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, keys: list[str], b_id: str) -> DataFrame:
    """Left join of each row of ``a`` to the row of ``b`` that overlaps it most, ties
    by the smaller start and id."""
    best = Window.partitionBy(*keys).orderBy(F.desc("overlap_bp"), b_start, b_id)
    kept = overlaps(a, b, chrom, a_start, a_end, b_start, b_end).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return a.join(kept.select(*keys, b_start, b_end, b_id, "overlap_bp"), keys, "left")


def nested_repeat(points: DataFrame, repeats: DataFrame, chrom: str, pos: str, start: str, end: str, keys: list[str]) -> DataFrame:
    """Left join of each point to the repeat of its own family that holds it.

    ``points`` carry ``family`` and ``orientation``, ``repeats`` ``rep_family`` and
    ``rep_strand``. A repeat in the same orientation goes first, then the longest,
    then the smallest start; ``nesting`` is nested, unnested or '' (none).
    """
    found = points_in_intervals(points, repeats, chrom, pos, start, end).filter((F.col("family") != "") & (F.col("family") == F.col("rep_family")))
    same = F.col("rep_strand").isin("+", "-") & (F.col("rep_strand") == F.col("orientation"))
    best = F.max_by(F.struct(F.col(start), F.col(end), "rep_strand", same.alias("same")), F.struct(same.cast("int"), F.col(end) - F.col(start), -F.col(start))).alias("_r")
    kept = found.groupBy(*keys).agg(best).select(*keys, F.col(f"_r.{start}").alias("repeat_start"), F.col(f"_r.{end}").alias("repeat_end"), F.when(F.col("_r.same"), "nested").otherwise("unnested").alias("nesting"))
    return points.join(kept, keys, "left").withColumn("nesting", F.coalesce("nesting", F.lit("")))
