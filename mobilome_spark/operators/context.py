"""What the alignments around a locus look like: reference reads, depth and random windows to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.operators import aggregates, intervals


def plain_read(min_clip: int = 20, tlen: int = 1000) -> Column:
    """Primary reads without a long clip at an end, a split or an unusual mate."""
    c = F.col
    clip = F.greatest(*[F.coalesce(F.regexp_extract("cigar", p, 1).try_cast("int"), F.lit(0)) for p in ("^([0-9]+)S", "[MIDNSHP=X]([0-9]+)S$")])
    primary = ~(c("is_unmapped") | c("is_qcfail") | c("is_duplicate") | c("is_secondary") | c("is_supplementary"))
    mate = ~c("mate_is_unmapped") & F.coalesce(c("mate_chrom") == c("chrom"), F.lit(False)) & (F.abs("template_len") < tlen) & c("is_proper_pair")
    return primary & (clip < min_clip) & (F.coalesce(c("sa"), F.lit("")) == "") & (~c("is_paired") | mate)


def context_metrics(reads: DataFrame, windows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per window that some read overlaps: reads, mapping quality and mismatches per 100 aligned bases.

    ``reads``: chrom, pos, ref_end, mapq, nm, aligned_len, already chosen by ``plain_read``.
    """
    hit = intervals.overlaps(reads, windows.select(*dict.fromkeys(["chrom", *keys, start, end])), "chrom", "pos", "ref_end", start, end)
    rate = F.when(F.col("aligned_len") > 0, 100.0 * F.col("nm") / F.col("aligned_len"))
    return hit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("context_non_sv_reads"), F.avg("mapq").alias("context_mapq_mean"), F.avg((F.col("mapq") < 20).cast("int")).alias("context_mapq_lt20_fraction"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("context_nm_per_100bp_mean"), F.coalesce(F.percentile(rate, 0.9), F.lit(0.0)).alias("context_nm_per_100bp_p90"),
    )


def depth_stats(blocks: DataFrame, windows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, mean_depth, peak_depth) of every window from aligned blocks (chrom, start_pos, end_pos).

    Bases without coverage count in the mean. Blocks become runs of equal depth
    first, so a window meets few rows however deep it is.
    """
    runs = aggregates.depth(blocks, "chrom", "start_pos", "end_pos")
    keyed = windows.select(*dict.fromkeys(["chrom", *keys, start, end])).distinct()
    hit = intervals.overlaps(keyed, runs, "chrom", start, end, "from_pos", "to_pos")
    per = hit.groupBy(*keys).agg(F.sum(F.col("depth") * F.col("overlap_bp")).alias("_sum"), F.max("depth").alias("_peak"))
    out = keyed.join(per, keys, "left")
    span = F.col(end) - F.col(start) + 1
    return out.select(*keys, F.coalesce(F.col("_sum") / span, F.lit(0.0)).alias("mean_depth"), F.coalesce("_peak", F.lit(0)).alias("peak_depth"))


def random_windows(contigs: DataFrame, n: int, span: int, seed: int = 13, avoid: DataFrame | None = None, tries: int = 50, least: int = 1000) -> DataFrame:
    """(chrom, window_start, window_end): up to ``n`` windows of ``span`` bases on every contig, clear of ``avoid``.

    ``contigs``: chrom, length. Places come from the MD5 of contig, seed and number,
    so that reruns and any partitioning agree; ``tries`` times as many are drawn as
    asked for, at least ``least``, those that touch ``avoid`` (chrom, start_pos, end_pos)
    go, and the first ``n`` by number stay. A contig that is nearly covered gives fewer.
    """
    drawn = contigs.filter(F.col("length") >= span).select("chrom", "length", F.explode(F.sequence(F.lit(0), F.lit(max(least, n * tries) - 1))).alias("draw"))
    digest = F.conv(F.left(F.md5(F.concat_ws(":", "chrom", F.lit(seed), "draw")), F.lit(15)), 16, 10).cast("bigint")
    at = digest % (F.col("length") - span + 1) + 1
    drawn = drawn.select("chrom", "draw", at.alias("window_start"), (at + span - 1).alias("window_end"))
    if avoid is not None:
        drawn = intervals.overlapping(drawn, avoid, "chrom", "window_start", "window_end", "start_pos", "end_pos", ["chrom", "draw", "window_start", "window_end"], inverse=True)
    # the number of draws of a contig is bounded by the request
    kept = drawn.groupBy("chrom").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "window_start", "window_end"))), 1, n).alias("_w"))
    return kept.select("chrom", F.inline("_w")).drop("draw")
