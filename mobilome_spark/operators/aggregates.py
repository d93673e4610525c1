"""Grouped aggregates of evidence: labels, modes, coherence and backgrounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.functions import seq


def top_label(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per group the label with the largest summed score (ties: the smaller label)
    and its share of the whole (``purity``, 0 where the whole is 0)."""
    summed = df.groupBy(*keys, label).agg(F.sum(score).alias("_s"))
    w = Window.partitionBy(*keys)
    ranked = summed.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_s"), label))).withColumn("_all", F.sum("_s").over(w))
    return ranked.filter("_n = 1").select(*keys, F.col(label).alias("top_label"), F.col("_s").alias("top_score"), F.coalesce(F.try_divide("_s", "_all"), F.lit(0.0)).alias("purity"))


def breakpoint_mode(df: DataFrame, keys: list[str], pos: str, read: str) -> DataFrame:
    """Per group the position with most distinct reads (ties: the smallest), those
    reads, all reads by position and the number of positions."""
    per = df.groupBy(*keys, pos).agg(F.countDistinct(read).alias("_reads"))
    best = F.min(F.struct((-F.col("_reads")).alias("r"), F.col(pos).alias("p"))).alias("_b")
    out = per.groupBy(*keys).agg(best, F.sum("_reads").alias("total_reads"), F.count(F.lit(1)).alias("unique_positions"))
    return out.select(*keys, F.col("_b.p").alias("mode_pos"), (-F.col("_b.r")).alias("mode_reads"), "total_reads", "unique_positions")


def bin_mode_fraction(df: DataFrame, keys: list[str], value: str, width: int, read: str) -> DataFrame:
    """Share of the fullest bin in the distinct reads of all bins."""
    per = df.groupBy(*keys, F.floor(F.col(value) / width).alias("_bin")).agg(F.countDistinct(read).alias("_reads"))
    return per.groupBy(*keys).agg((F.max("_reads") / F.sum("_reads")).alias("bin_mode_fraction"))


def abs_spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Absolute rank correlation with mean ranks for ties: 1 for fewer than three
    rows, 0 where one side is constant."""

    def rank(c: str) -> Column:
        by = Window.partitionBy(*keys).orderBy(c)
        same = Window.partitionBy(*keys, c)
        return F.rank().over(by) + (F.count(F.lit(1)).over(same) - 1) / 2.0

    ranked = df.withColumn("_x", rank(x)).withColumn("_y", rank(y))
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.avg(F.col("_x") * F.col("_y")).alias("mxy"), F.avg(F.col("_x") * F.col("_x")).alias("mxx"), F.avg(F.col("_y") * F.col("_y")).alias("myy")
    )
    spread = (F.col("mxx") - F.col("mx") * F.col("mx")) * (F.col("myy") - F.col("my") * F.col("my"))
    value = F.when(F.col("n") < 3, 1.0).when(spread <= 1e-9, 0.0).otherwise(F.abs(F.col("mxy") - F.col("mx") * F.col("my")) / F.sqrt(spread))
    return g.select(*keys, "n", value.alias("spearman"))


def case_control(df: DataFrame, keys: list[str], sample: str, read: str, totals: dict[str, int], pseudo: float = 0.1) -> DataFrame:
    """Rows and distinct reads per sample, counts per million of ``totals`` and the
    ratio and difference of disease over control, in one pass."""
    is_ = {s: F.col(sample) == s for s in ("disease", "control")}
    out = df.groupBy(*keys).agg(*[x for s, m in is_.items() for x in (F.count_if(m).alias(f"{s}_rows"), F.countDistinct(F.when(m, F.col(read))).alias(f"{s}_reads"))])
    for s in is_:
        out = out.withColumn(f"{s}_cpm", F.col(f"{s}_rows") * 1e6 / totals[s] if totals[s] > 0 else F.lit(0.0))
    ratio = (F.col("disease_cpm") + pseudo) / (F.col("control_cpm") + pseudo)
    return out.withColumn("enrichment_ratio", ratio).withColumn("delta_cpm", F.col("disease_cpm") - F.col("control_cpm"))


def pair_swings(df: DataFrame, keys: list[str], anchor: str, target: str) -> DataFrame:
    """Distinct (anchor, target) rows with ``_s``: how far the target moves against the
    anchor from the row before, the lesser of |dt - da| and |dt + da|."""
    order = Window.partitionBy(*keys).orderBy(anchor, target)
    da, dt = F.col(anchor) - F.lag(anchor).over(order), F.col(target) - F.lag(target).over(order)
    return df.select(*keys, anchor, target).distinct().withColumn("_s", F.least(F.abs(dt - da), F.abs(dt + da))).withColumn("_at", F.struct(anchor, target))


def first_violation(swing: str, limit: Column | float) -> Column:
    """Aggregate (max_swing, violates): the largest swing up to and with the first one
    above ``limit``; a group without any swing has 0."""
    s, limit = F.col(swing), F.lit(limit) if isinstance(limit, (int, float)) else limit
    calm, first = F.max(F.when(s <= limit, s)), F.min(F.when(s > limit, F.struct("_at", s.alias("s"))))
    # below the limit nothing can exceed the first violation, so its place settles the rest
    return F.struct(F.coalesce(first["s"], calm, F.lit(0)).alias("max_swing"), first.isNotNull().cast("int").alias("violates"))


def jump_violation(df: DataFrame, keys: list[str], anchor: str, target: str, limit: float) -> DataFrame:
    """Adjacent pairs by anchor: the group violates if some pair swings by more than
    ``limit``; the largest swing counts up to the first such pair only."""
    out = pair_swings(df, keys, anchor, target).groupBy(*keys).agg(first_violation("_s", limit).alias("_v"))
    return out.select(*keys, "_v.max_swing", "_v.violates")


def empirical_tail(values: DataFrame, background: DataFrame, keys: list[str], chrom: str, value: str, least: int = 50) -> DataFrame:
    """Upper-tail probability (k + 1) / (n + 1) of each value in its contig's
    background, or in the whole one where the contig has fewer than ``least`` rows.

    Both sides are merged and counted by one descending window per background:
    nothing is joined by range.
    """
    sizes = background.groupBy(chrom).agg(F.count(F.lit(1)).alias("_n"))
    n_all = background.count()
    rows = values.join(sizes, chrom, "left").withColumn("_own", F.coalesce(F.col("_n"), F.lit(0)) >= least)
    group = F.when(F.col("_own"), F.col(chrom)).otherwise(F.lit("*"))
    asked = rows.select(*keys, F.col(value).alias("_v"), group.alias("_g"), F.when(F.col("_own"), F.col("_n")).otherwise(n_all).alias("_n"))
    # distinct background values with counts keep the windows small
    held = background.groupBy(F.col(chrom).cast("string").alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    held = held.unionByName(background.groupBy(F.lit("*").alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    want = asked.select("_g", "_v").distinct()
    both = held.unionByName(want.withColumn("_c", F.lit(0).cast("bigint"))).groupBy("_g", "_v").agg(F.sum("_c").alias("_c"))
    above = both.withColumn("_k", F.sum("_c").over(Window.partitionBy("_g").orderBy(F.desc("_v"))))
    return asked.join(above.select("_g", "_v", "_k"), ["_g", "_v"]).select(*keys, ((F.col("_k") + 1) / (F.col("_n") + 1)).alias("p_high"))


def depth(intervals: DataFrame, chrom: str, start: str, end: str) -> DataFrame:
    """(chrom, from_pos, to_pos, depth): runs of equal coverage by closed intervals, by a sweep of ends."""
    ends = intervals.select(chrom, F.col(start).alias("_p"), F.lit(1).alias("_d")).unionByName(intervals.select(chrom, (F.col(end) + 1).alias("_p"), F.lit(-1).alias("_d")))
    steps = ends.groupBy(chrom, "_p").agg(F.sum("_d").alias("_d"))
    order = Window.partitionBy(chrom).orderBy("_p")
    runs = steps.withColumn("depth", F.sum("_d").over(order)).withColumn("to_pos", F.lead("_p").over(order) - 1)
    return runs.filter("depth > 0").select(chrom, F.col("_p").alias("from_pos"), "to_pos", "depth")


def clip_overlap(clips: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """(informative_reads, overlap_median, overlap_share) of a group's soft clips.

    Each read gives its clip of the largest ``score``, and the ``most`` best reads
    count (ties: read name). Informative clips are compared pairwise near the
    breakpoint, scaled above chance: the median similarity times the share of the
    commonest position, and the share of pairs of at least 0.2. Below two clips 0.
    A group holds at most ``most`` clips, so its pairs stay within one expression.
    """
    best = F.max_by(F.struct("pos", "clip_side", "clip_seq"), F.struct("score", -F.col("pos"), "clip_side", "clip_seq")).alias("_b")
    reads = clips.groupBy(*keys, "read_name").agg(F.max("score").alias("score"), best)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "read_name")
    kept = reads.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select(*keys, "_n", "_b.*")
    near = F.when(F.col("clip_side") == "L", F.right(seq.normalized_clip(F.col("clip_seq"), 200), F.lit(40))).otherwise(seq.normalized_clip(F.col("clip_seq"), 40))
    kept = kept.withColumn("_near", F.when(seq.informative_clip(seq.normalized_clip(F.col("clip_seq"))) & (F.length(near) >= 12), near))
    groups = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_near").isNotNull(), F.struct("_n", "pos", "_near")))).alias("_c"))
    c = F.col("_c")
    above = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (seq.clip_identity(a["_near"], b["_near"]) - 0.25) / 0.75))
    pairs = F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda b: above(a, b))))
    groups = groups.withColumn("_s", F.sort_array(pairs)).withColumn("_m", F.size("_s"))
    at = lambda k: F.get("_s", k.cast("int"))
    median = (at(F.floor((F.col("_m") - 1) / 2)) + at(F.floor(F.col("_m") / 2))) / 2
    mode = F.array_max(F.transform(c, lambda a: F.size(F.filter(c, lambda b: b["pos"] == a["pos"])))) / F.nullif(F.size(c), F.lit(0))
    share = F.size(F.filter("_s", lambda x: x >= 0.2)) / F.nullif(F.col("_m"), F.lit(0))
    return groups.select(*keys, F.size(c).cast("bigint").alias("informative_reads"), F.coalesce(median * mode, F.lit(0.0)).alias("overlap_median"), F.coalesce(share, F.lit(0.0)).alias("overlap_share"))
