"""Extraction of split and discordant evidence from alignment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.operators import rules


def passing(min_mapq: int) -> Column:
    """Mapped primary or supplementary reads that are neither failed nor duplicates."""
    return ~F.col("is_unmapped") & ~F.col("is_qcfail") & ~F.col("is_duplicate") & ~F.col("is_secondary") & (F.col("mapq") >= min_mapq)


def split_evidence(alignments: DataFrame, min_mapq: int = 20, min_clip: int = 20, rescue_clip: int = 8, rescue_run: int = 8, rescue_fraction: float = 0.8) -> DataFrame:
    """A row per soft-clipped end: long clips, and shorter ones that are poly-A/T tails."""
    left = F.regexp_extract("cigar", "^([0-9]+)S", 1).try_cast("int")
    right = F.regexp_extract("cigar", "[MIDNSHP=X]([0-9]+)S$", 1).try_cast("int")
    ends = F.array(
        F.struct(F.lit("L").alias("clip_side"), left.alias("clip_len"), F.col("pos").alias("at"), F.left("seq", F.coalesce(left, F.lit(0))).alias("clip_seq")),
        F.struct(F.lit("R").alias("clip_side"), right.alias("clip_len"), F.col("ref_end").alias("at"), F.right("seq", F.coalesce(right, F.lit(0))).alias("clip_seq")),
    )
    rows = alignments.filter(passing(min_mapq)).select("sample", "chrom", "mapq", "is_reverse", "read_name", "sa", "nm", F.inline(F.filter(ends, lambda e: e["clip_len"] >= rescue_clip)))
    clip = F.col("clip_seq")
    rows = rows.withColumns({"clip_poly_at_run": seq.poly_at_run(clip), "clip_poly_at_fraction": seq.poly_at_fraction(clip), "clip_poly_base": seq.poly_at_base(clip)})
    rescued = (F.col("clip_len") < min_clip) & (F.col("clip_poly_at_run") >= rescue_run) & (F.col("clip_poly_at_fraction") >= rescue_fraction)
    kept = rows.withColumn("poly_tail_rescued", rescued).filter((F.col("clip_len") >= min_clip) | F.col("poly_tail_rescued"))
    return kept.select(
        "sample", "chrom", F.col("at").cast("int").alias("pos"), "clip_side", "clip_len", F.col("mapq").cast("int"), "is_reverse", "read_name", F.col("sa").isNotNull().alias("has_sa"),
        F.coalesce("sa", F.lit("")).alias("sa_raw"), "clip_seq", F.coalesce("nm", F.lit(-1)).alias("nm"), "clip_poly_at_run", "clip_poly_at_fraction", "clip_poly_base", "poly_tail_rescued",
    )


def insert_threshold(alignments: DataFrame, quantile: float = 0.995, least: int = 1000) -> DataFrame:
    """(sample, threshold): the truncated quantile of template lengths, at least ``least``."""
    good = F.col("is_read1") & ~F.col("is_unmapped") & ~F.col("mate_is_unmapped") & (F.col("chrom") == F.col("mate_chrom")) & (F.col("template_len") != 0)
    size = F.percentile(F.when(good, F.abs("template_len")), quantile)
    return alignments.groupBy("sample").agg(F.greatest(F.floor(F.coalesce(size, F.lit(0.0))), F.lit(least)).cast("int").alias("threshold"))


def discordant_evidence(
    alignments: DataFrame, min_mapq: int = 20, quantile: float = 0.995, least: int = 1000, rescue_window: int = 25, rescue_run: int = 10, rescue_fraction: float = 0.8, rescue_tlen: int = 500, require_strong: bool = True
) -> DataFrame:
    """Reads of pairs with a discordant reason, strong unless told otherwise, with all of their reasons.

    A poly-A/T tail at an end of the read is a strong reason where anything else
    about the pair is unusual.
    """
    limits = insert_threshold(alignments, quantile, least)
    rows = alignments.filter(F.col("is_paired") & passing(min_mapq)).join(limits, "sample")
    other = ~F.coalesce(F.col("mate_chrom") == F.col("chrom"), F.lit(False))
    same = F.col("is_reverse") == F.col("mate_is_reverse")
    unusual = F.col("mate_is_unmapped") | other | (F.abs("template_len") >= rescue_tlen) | same | ~F.col("is_proper_pair")
    rows = rows.withColumn("_end", seq.poly_at_end(F.col("seq"), rescue_window))
    rows = rows.withColumn("_rescued", (F.col("_end.run") >= rescue_run) & (F.col("_end.fraction") >= rescue_fraction) & unusual)
    why = rules.discordant_reasons(F.col("mate_is_unmapped"), other, F.col("template_len"), F.col("threshold"), same, F.col("is_proper_pair"), F.col("_rescued"))
    rows = rows.withColumn("discordant_reasons", why).filter(rules.has_strong_reason(F.col("discordant_reasons")) if require_strong else F.col("discordant_reasons") != "")
    return rows.select(
        "sample", "chrom", F.col("pos").cast("int"), F.coalesce("mate_chrom", F.lit("*")).alias("mate_chrom"), F.coalesce("mate_pos", F.lit(0)).cast("int").alias("mate_pos"), F.col("mapq").cast("int"),
        F.col("template_len").cast("int"), "is_reverse", "mate_is_reverse", "is_proper_pair", "is_read1", "read_name", "discordant_reasons", F.coalesce("nm", F.lit(-1)).alias("nm"), F.col("seq").alias("read_seq"),
        F.col("_end.run").alias("anchor_poly_at_run"), F.col("_end.fraction").alias("anchor_poly_at_fraction"), F.col("_end.base").alias("anchor_poly_base"), F.col("_end.side").alias("anchor_poly_side"), F.col("_rescued").alias("poly_tail_anchor_rescued"),
    )


def summary(alignments: DataFrame, min_mapq: int = 20) -> DataFrame:
    """(sample, total_reads_scanned, passing_reads) in one pass."""
    return alignments.groupBy("sample").agg(F.count(F.lit(1)).alias("total_reads_scanned"), F.count_if(passing(min_mapq)).alias("passing_reads"))
