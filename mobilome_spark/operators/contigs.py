"""Assembled contigs of loci: breakpoints, topology, and the choice between samples.

Assembly and alignment are outside; hits of contigs to the element panel and to
the reference come as rows: ``KEY``, sample, contig_id, target_set (mei or ref),
qstart, qend, strand, tname, tstart, tend (0-based, half-open), nmatch, alnlen, mapq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.operators.loci import KEY

CONTIG = [*KEY, "sample", "contig_id"]
#: Reference flanks may reach this far into the element's part of a contig.
SLACK = 20
CLASSES = ("unknown", "simple_mei", "mei_plus_sv", "multi_junction")


def read_priority(reads: DataFrame, cap: int, preferred: Column) -> DataFrame:
    """The reads of a locus and sample to assemble, one per name and mate, at most ``cap``: preferred ones,
    then those with any difference from the reference, then the clean ones, by position."""
    c = F.col
    clean = (c("mapq") >= 60) & ~c("cigar").rlike("[IDNSH]") & (F.coalesce(c("nm"), F.lit(0)) == 0) & ~c("mate_is_unmapped") & c("is_proper_pair")
    usable = reads.filter(~(c("is_secondary") | c("is_supplementary") | c("is_duplicate") | c("is_qcfail")) & (F.coalesce(c("seq"), F.lit("")) != ""))
    ranked = usable.withColumn("_turn", F.when(preferred, 0).when(~clean, 1).otherwise(2))
    name = [*KEY, "sample", "read_name", "is_read1"]
    one = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(*name).orderBy("_turn", "pos"))).filter("_k = 1")
    order = Window.partitionBy(*KEY, "sample").orderBy("_turn", "pos", "read_name", "is_read1")
    return one.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= cap).drop("_k", "_turn")


def contig_breakpoints(hits: DataFrame) -> DataFrame:
    """One row per contig: its best element hit (aligned bases, quality, matches), the reference hits that
    flank it, and what they say: side_status, breakpoint, length of the duplication, partner and class."""
    c = F.col
    best = F.max_by(F.struct("qstart", "qend", "alnlen", "tname", "strand"), F.struct("alnlen", "mapq", "nmatch", -c("qstart"), "tname"))
    mei = hits.filter("target_set = 'mei'").groupBy(*CONTIG).agg(best.alias("m"))
    ref = hits.filter("target_set = 'ref'").join(mei, CONTIG, "full_outer")
    place = lambda end: F.struct("tname", "strand", end.cast("bigint").alias("pos"))
    left = F.max_by(place(c("tend")), F.when(c("qend") <= c("m.qstart") + SLACK, F.struct("qend", "alnlen", "mapq", "nmatch", "tname", "tend")))
    right = F.min_by(place(c("tstart") + 1), F.when(c("qstart") >= c("m.qend") - SLACK, F.struct("qstart", -c("alnlen"), -c("mapq"), -c("nmatch"), "tname", "tstart")))
    solid = (c("alnlen") >= 80) & (c("mapq") >= 20)
    mixed = lambda x: F.min(F.when(solid, x)) != F.max(F.when(solid, x))
    per = ref.groupBy(*CONTIG).agg(
        F.first("m").alias("m"), left.alias("l"), right.alias("r"), F.count_if(solid).alias("ref_blocks"), F.coalesce(mixed(c("tname")) | mixed(c("strand")), F.lit(False)).alias("_mixed"), F.coalesce(F.max("alnlen"), F.lit(0)).alias("ref_aln_len")
    )
    has_l, has_r = c("l").isNotNull(), c("r").isNotNull()
    per = per.withColumn("side_status", F.when(has_l & has_r, "both").when(has_l, "left_only").when(has_r, "right_only").otherwise("none"))
    same = c("l.tname") == c("r.tname")
    one = F.when(c("side_status") == "left_only", c("l")).when(c("side_status") == "right_only", c("r"))
    kind = F.when(one.isNotNull(), "single_flank_ref_only").when(has_l & has_r, F.when(~same, "interchrom_breakend").when(c("l.strand") != c("r.strand"), "inversion_breakend").when(F.abs(c("r.pos") - c("l.pos")) > 1000, "large_gap_breakend"))
    per = per.withColumn("partner_type", F.coalesce(kind, F.lit("")))
    partner = F.when(c("partner_type") != "", F.coalesce(one, c("r")))
    class_ = F.when(c("m").isNull(), F.when((c("ref_blocks") >= 3) | c("_mixed"), CLASSES[3]).otherwise(CLASSES[0])).when(c("ref_blocks") >= 3, CLASSES[3]).when((c("partner_type") != "") | c("_mixed"), CLASSES[2]).otherwise(CLASSES[1])
    joint = has_l & has_r & same
    place_of = F.when(joint, F.floor((c("l.pos") + c("r.pos")) / 2).cast("bigint")).otherwise(F.coalesce(c("l.pos"), c("r.pos")))
    return per.select(
        *CONTIG, F.coalesce("m.alnlen", F.lit(0)).alias("mei_aln_len"), F.coalesce("m.tname", F.lit("")).alias("mei_target"), "ref_aln_len", "ref_blocks", "side_status", F.coalesce("l.tname", "r.tname", F.lit("")).alias("breakpoint_chrom"),
        F.coalesce(place_of, F.lit(0).cast("bigint")).alias("breakpoint_pos"), F.when(joint & (c("r.pos") >= c("l.pos")), c("r.pos") - c("l.pos") + 1).otherwise(0).alias("tsd_len"),
        "partner_type", F.coalesce(partner["tname"], F.lit("")).alias("partner_chrom"), F.coalesce(partner["pos"], F.lit(-1).cast("bigint")).alias("partner_pos"), class_.alias("complex_class"),
    )


def complexity_key() -> Column:
    """Order of topologies: class, sides that are flanked, a partner, aligned element bases."""
    rank = F.array_position(F.array(*[F.lit(k) for k in CLASSES]), F.col("complex_class"))
    sides = F.when(F.col("side_status") == "both", 2).when(F.col("side_status") == "none", 0).otherwise(1)
    return F.struct(rank.alias("class"), sides.alias("sides"), (F.col("partner_type") != "").cast("int").alias("partner"), F.col("mei_aln_len").alias("aln"))


def topology(breakpoints: DataFrame, lengths: DataFrame, top: int = 3) -> DataFrame:
    """One row per locus and sample: the most complex of the ``top`` contigs by aligned bases, and their names.

    ``lengths``: ``CONTIG`` and contig_len. Ties go to the longer and the later name, as among the top.
    """
    order = Window.partitionBy(*KEY, "sample").orderBy(F.desc("_score"), F.desc("contig_len"), F.desc("contig_id"))
    rows = breakpoints.withColumn("_score", F.col("mei_aln_len") + F.col("ref_aln_len")).join(lengths.select(*CONTIG, "contig_len"), CONTIG, "left").withColumn("contig_len", F.coalesce("contig_len", F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
    fields = ("complex_class", "side_status", "partner_chrom", "partner_pos", "partner_type", "mei_aln_len")
    best = F.max_by(F.struct(*fields), F.struct(complexity_key(), -F.col("_n"))).alias("_b")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "contig_id"))), lambda x: x["contig_id"].cast("string")), ",").alias("top_contigs")
    return rows.groupBy(*KEY, "sample").agg(best, names).select(*KEY, "sample", "_b.*", "top_contigs")


def choose_sample(features: DataFrame) -> DataFrame:
    """(``KEY``, picked, complex_source): the sample whose assembly is told, '' if none informs, and the more complex one.

    ``features``: ``KEY``, sample, insertion_mei_start, insertion_mei_end (start is the
    higher), left_anchor, right_anchor, mei_aln_len, coord_model and the topology. The
    disease wins ties; valid coordinates, anchored sides and length come first.
    """
    c = F.col
    valid = (c("insertion_mei_end") > 0) & (c("insertion_mei_start") >= c("insertion_mei_end"))
    sides = sum((c(f"{k}_anchor") >= 30).cast("int") for k in ("left", "right"))
    score = F.struct(valid.cast("int").alias("valid"), sides.alias("sides"), F.greatest("left_anchor", "right_anchor", "mei_aln_len").alias("aln"), (~c("coord_model").isin("", "no_contigs", "no_mei_hits")).cast("int").alias("model"))
    informs = (score["valid"] + score["sides"] + score["aln"] + score["model"]) > 0
    first = (c("sample") == "disease").cast("int")
    picked = F.max_by("sample", F.when(informs, F.struct(score, first.alias("first"))))
    return features.groupBy(*KEY).agg(F.coalesce(picked, F.lit("")).alias("picked"), F.max_by("sample", F.struct(complexity_key(), first.alias("first"))).alias("complex_source"))


def needs_more_reads(status: Column, disease_reads: Column, control_reads: Column, picked: Column, disease_contigs: Column, control_contigs: Column, cap: int = 600, most: int = 1000) -> Column:
    """An assembly that both samples' caps cut short and that tells nothing, or has at most one contig each."""
    poor = (picked == "") | ((disease_contigs <= 1) & (control_contigs <= 1))
    return F.lit(cap < most) & status.startswith("assembled") & (disease_reads >= cap) & (control_reads >= cap) & poor
