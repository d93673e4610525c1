"""Mobile-element support of a locus: per sample and side, from aligned clips and mates.

All samples, sides and panels are grouping columns of one plan; ``spread`` turns
the long tables into one row per locus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.operators import aggregates
from mobilome_spark.operators.loci import KEY, REASONS, SAMPLES

SIDE = [*KEY, "sample", "clip_side"]
#: Coordinates of the element are taken from hits that reach all of these: quality, coverage, identity, aligned bases.
STRICT, RELAXED = (20, 0.60, 0.85, 25), (10, 0.35, 0.75, 15)
#: A longer run of A or T marks a clip as a tail.
TAIL_RUN = 8


def effective(clips: DataFrame) -> DataFrame:
    """Best known hit columns: the whole clip's, else those of the clip without its tail (``_coord``)."""
    first = lambda a: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.coalesce(f"{a}_coord", F.lit("")))
    larger = lambda a: F.coalesce(F.greatest(a, f"{a}_coord"), F.lit(0))
    score = F.when(F.col("score") > 0, F.col("score")).otherwise(F.coalesce("score_coord", F.lit(0.0)))
    return clips.withColumns({"score": score, **{c: first(c) for c in ("family", "target", "strand")}, "alnlen": larger("alnlen"), "target_len": larger("target_len")})


def best_labels(rows: DataFrame, keys: list[str], labels: list[str], score: str) -> DataFrame:
    """``top_label`` of several label columns in one pass: (keys, <label>, <label>_purity)."""
    long = rows.select(*keys, F.col(score).alias("_w"), F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(n, F.lit("")).alias("label")) for n in labels])).alias("_l"))
    summed = long.groupBy(*keys, "_l").agg(F.sum("_w").alias("_s"))
    out = []
    for n in labels:
        mine = F.col("_l.kind") == n
        top = F.min(F.when(mine, F.struct((-F.col("_s")).alias("s"), F.col("_l.label").alias("label"))))
        out += [top["label"].alias(n), F.coalesce(F.try_divide(-top["s"], F.sum(F.when(mine, F.col("_s")))), F.lit(0.0)).alias(f"{n}_purity")]
    return summed.groupBy(*keys).agg(*out)


def _usable(limits: tuple) -> Column:
    """Hits whose place on the element can be trusted; repetitive ones need to be long and clean."""
    mapq, cover, identity, length = limits
    repetitive = (F.col("qcov") >= 0.90) & (F.col("pid") >= 0.90) & (F.col("alnlen") >= 40)
    return ((F.col("mapq") >= mapq) | repetitive) & (F.col("qcov") >= cover) & (F.col("pid") >= identity) & (F.col("alnlen") >= length) & (F.col("_run") < TAIL_RUN)


def element_interval(clips: DataFrame, tops: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(``SIDE``, mei_start, mei_end): where the trusted hits of the preferred target lie.

    The relaxed limits hold for a sample's side only where no locus at all has a
    strict hit there. Of a locus, hits to its ``preferred`` target (columns ``KEY``,
    preferred) count, else those to the side's top target, else none.
    """
    known = clips.withColumn("_strict", _usable(STRICT)).filter(_usable(RELAXED))
    # a row per sample and side: four rows
    any_strict = known.groupBy("sample", "clip_side").agg(F.max("_strict").alias("_any"))
    known = known.join(F.broadcast(any_strict), ["sample", "clip_side"]).filter(F.col("_strict") | ~F.col("_any"))
    known = known.join(tops.select(*SIDE, F.col("target").alias("_top")), SIDE)
    known = known.withColumn("preferred", F.lit("")) if preferred is None else known.join(preferred.select(*KEY, "preferred"), KEY, "left")
    rank = F.when((F.col("preferred") != "") & (F.col("target") == F.col("preferred")), 0).when(F.col("target") == F.col("_top"), 1)
    ends = known.withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy(*SIDE, "_rank").agg(F.min("target_start").alias("s"), F.max("target_end").alias("e"))
    return ends.groupBy(*SIDE).agg(F.min(F.struct("_rank", "s", "e")).alias("_b")).select(*SIDE, F.col("_b.s").alias("mei_start"), F.col("_b.e").alias("mei_end"))


def side_metrics(clips: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """One row per (``SIDE``) with the support that clips aligned to an element give.

    ``clips``: ``SIDE``, read_name, pos, clip_seq and a hit's score, family, target,
    strand, alnlen, target_len, target_start, target_end, mapq, qcov and pid.
    Rows are folded per read, so a deep locus is combined before it moves.
    """
    clips = clips.withColumn("_run", seq.poly_at_run(F.upper("clip_seq")))
    sums = [F.sum("score").alias("score"), F.max("alnlen").alias("alnlen"), F.max("target_len").alias("target_len"), F.max("_run").alias("run")]
    sums += [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_run") >= TAIL_RUN).alias("tails")]
    per_read = clips.groupBy(*SIDE, "read_name").agg(*sums)
    known = F.col("read_name").isNotNull()
    base = per_read.groupBy(*SIDE).agg(
        F.count_if(known).alias("mei_supported_reads"), F.sum("score").alias("mei_score_sum"), F.max("alnlen").alias("mei_anchor_bp_max"), F.max("target_len").alias("mei_target_len"),
        F.count_if(known & (F.col("run") >= TAIL_RUN)).alias("poly_at_reads"), F.max("run").alias("poly_at_max_run"), (F.sum("tails") / F.sum("rows")).alias("poly_at_fraction"),
    )
    tops = best_labels(clips, SIDE, ["family", "target", "strand"], "score")
    modes = aggregates.breakpoint_mode(clips, SIDE, "pos", "read_name")
    overlap = aggregates.clip_overlap(clips.withColumn("_side", F.col("clip_side")), [*KEY, "sample", "_side"]).withColumnRenamed("_side", "clip_side")
    out = base.join(tops, SIDE).join(modes, SIDE).join(overlap, SIDE).join(element_interval(clips, tops, preferred), SIDE, "left")
    return out.select(
        *SIDE, "mei_supported_reads", "mei_score_sum", F.col("family").alias("mei_family"), F.col("target").alias("mei_subfamily"), F.col("strand").alias("mei_strand"),
        F.coalesce("mei_start", F.lit(0)).cast("bigint").alias("mei_start"), F.coalesce("mei_end", F.lit(0)).cast("bigint").alias("mei_end"), "mei_anchor_bp_max", "mei_target_len", F.col("target_purity").alias("mei_subfamily_purity"),
        F.col("mode_pos").alias("mei_breakpoint_mode"), (F.col("mode_reads") / F.col("mei_supported_reads")).alias("mei_breakpoint_mode_fraction"), F.col("unique_positions").alias("mei_breakpoint_unique_positions"),
        "poly_at_reads", "poly_at_fraction", "poly_at_max_run", F.col("informative_reads").alias("clip_overlap_informative_reads"), F.col("overlap_median").alias("clip_overlap_jaccard_median"), F.col("overlap_share").alias("clip_overlap_pair_ge20_fraction"),
    )


def spread(long: DataFrame, by: list[str], name: str, values: dict[str, list[str]]) -> DataFrame:
    """One row per locus: metrics of the long table named by its ``by`` columns.

    ``name`` is a pattern such as ``{sample}_{clip_side}_{metric}``; ``values`` lists
    what each ``by`` column can hold. Missing numbers are 0, texts '' and flags false.
    """
    cells = [{}]
    for c in by:
        cells = [{**cell, c: v} for cell in cells for v in values[c]]
    kinds = dict(long.drop(*KEY, *by).dtypes)
    empty = lambda t: F.lit("") if t == "string" else F.lit(False) if t == "boolean" else F.lit(0).cast(t)
    out = []
    for cell in cells:
        here = F.lit(True)
        for c, v in cell.items():
            here = here & (F.col(c) == v)
        out += [F.coalesce(F.max(F.when(here, F.col(m))), empty(t)).alias(name.format(metric=m, **cell)) for m, t in kinds.items()]
    return long.groupBy(*KEY).agg(*out)


def spread_sides(long: DataFrame) -> DataFrame:
    return spread(long, ["sample", "clip_side"], "{sample}_{clip_side}_{metric}", {"sample": list(SAMPLES), "clip_side": ["L", "R"]})


def anchor_side(pos: Column) -> Column:
    """Left of the window's middle, itself included, or right of it."""
    return F.when(pos <= F.floor((F.col("window_start") + F.col("window_end")) / 2), "L").otherwise("R")


def anchor_sides(rows: DataFrame) -> DataFrame:
    """(``KEY``, sample, side, unique_reads, mapq_mean, complex_reason_max_fraction) of all
    discordant rows: the largest share of a reason, or of any strong one."""
    has = {r: F.contains("discordant_reasons", F.lit(r)) for r in REASONS}
    strong = has["interchrom"] | has["mate_unmapped"] | has["large_insert"]
    folded = rows.withColumn("side", anchor_side(F.col("pos"))).groupBy(*KEY, "sample", "side", "read_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("q"), *[F.count_if(c).alias(f"_{n}") for n, c in {**has, "any": strong}.items()]
    )
    share = lambda n: F.sum(f"_{n}") / F.sum("n")
    return folded.groupBy(*KEY, "sample", "side").agg(
        F.count_if(F.col("read_name").isNotNull()).alias("unique_reads"), (F.sum("q") / F.sum("n")).alias("mapq_mean"), F.greatest(*[share(n) for n in (*has, "any")]).alias("complex_reason_max_fraction")
    )


def discordant_support(rows: DataFrame) -> DataFrame:
    """One row per (``KEY``, sample): what mates aligned to an element say together.

    ``rows``: ``KEY``, sample, read_name, pos, family, target, strand, score,
    target_start, target_end, template_len. Sides are consistent in geometry if both
    have reads, their medians come in the order the strand asks for, and lie 30 to
    8000 bases apart; they are consistent in themselves if no neighbouring pair
    swings by over three deviations of the insert size (50 at least) and, where both
    have three reads, positions cluster or rank alike.
    """
    sided = [*KEY, "sample", "side"]
    whole = [*KEY, "sample"]
    rows = rows.withColumn("side", anchor_side(F.col("pos"))).withColumn("mid", F.floor((F.col("target_start") + F.col("target_end")) / 2))
    # a row per sample: at most two
    spreads = rows.groupBy("sample").agg(F.greatest(F.lit(50.0), F.coalesce(F.stddev_pop(F.abs("template_len")), F.lit(0.0))).alias("sd"))
    reads = rows.groupBy(*sided, "read_name").agg(F.sum("score").alias("s")).groupBy(*sided).agg(F.count_if(F.col("read_name").isNotNull()).alias("reads"), F.sum("s").alias("score"))
    medians = rows.groupBy(*sided).agg(F.percentile("mid", 0.5).alias("median"))
    sub = best_labels(rows, sided, ["target"], "score").select(*sided, F.col("target").alias("subfamily"))
    bins = [aggregates.bin_mode_fraction(rows, sided, c, w, "read_name").withColumnRenamed("bin_mode_fraction", n) for c, w, n in (("pos", 10, "pos_bin"), ("mid", 25, "mid_bin"))]
    ranks = aggregates.abs_spearman(rows, sided, "pos", "mid").drop("n")
    swings = aggregates.pair_swings(rows, sided, "pos", "mid").join(F.broadcast(spreads), "sample")
    swings = swings.groupBy(*sided).agg(aggregates.first_violation("_s", 3 * F.col("sd"))["max_swing"].alias("swing"), F.max(F.col("_s") > 3 * F.col("sd")).alias("jump"))
    per = reads
    for part in (medians, sub, *bins, ranks, swings):
        per = per.join(part, sided)
    at = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    both = {f"{n}_{c}": F.coalesce(at(c, s), z) for n, s in (("left", "L"), ("right", "R")) for c, z in (("reads", F.lit(0)), ("median", F.lit(0.0)), ("subfamily", F.lit("")), ("pos_bin", F.lit(0.0)), ("mid_bin", F.lit(0.0)), ("spearman", F.lit(0.0)), ("swing", F.lit(0.0)), ("jump", F.lit(False)))}
    out = per.groupBy(*whole).agg(F.sum("score").alias("score_sum"), *[c.alias(n) for n, c in both.items()])
    names = rows.groupBy(*whole, "read_name").agg(F.lit(1).alias("_")).groupBy(*whole).agg(F.count_if(F.col("read_name").isNotNull()).alias("supported_reads"))
    out = out.join(names, whole).join(best_labels(rows, whole, ["family", "target", "strand"], "score"), whole)
    c = F.col
    span = F.abs(c("right_median") - c("left_median")) + 1
    ordered = ((c("strand") == "+") & (c("right_median") >= c("left_median"))) | ((c("strand") == "-") & (c("left_median") >= c("right_median")))
    two = (c("left_reads") >= 1) & (c("right_reads") >= 1)
    tight = F.least("left_pos_bin", "left_mid_bin", "right_pos_bin", "right_mid_bin")
    alike = F.least("left_spearman", "right_spearman")
    calm = (F.least("left_reads", "right_reads") < 3) | (tight >= 0.5) | (alike >= 0.6)
    return out.select(
        *whole, "supported_reads", "score_sum", F.col("left_reads").alias("left_supported_reads"), F.col("right_reads").alias("right_supported_reads"), "family", "family_purity", F.col("target").alias("subfamily"),
        F.col("target_purity").alias("subfamily_purity"), "strand", "strand_purity", F.col("left_median").alias("left_target_pos_median"), F.col("right_median").alias("right_target_pos_median"),
        "left_subfamily", "right_subfamily", ((c("left_subfamily") != "") & (c("left_subfamily") == c("right_subfamily"))).alias("side_subfamily_consistent"),
        tight.alias("side_coherence_min"), alike.alias("anchor_target_spearman_abs_min"), F.greatest("left_swing", "right_swing").alias("max_pair_swing"), (c("left_jump") | c("right_jump")).alias("any_local_jump_violation"),
        span.alias("insertion_span_estimate"), two.alias("two_sided_support"), ordered.alias("orientation_order_consistent"), (two & ordered & span.between(30, 8000)).alias("geometry_consistent"),
        (~(c("left_jump") | c("right_jump")) & calm).alias("self_consistent"),
    )


def support_counts(rows: DataFrame) -> DataFrame:
    """One row per locus: reads that support it, as counts and as a text per sample.

    ``rows``: ``KEY``, sample, read_name, side, kind (split, indel or discordant) and
    the flags mei and tail. A locus where no sample has an element read counts
    nothing. Where the other sample has element reads and this one has none, or only
    weak ones, just its informative reads count: element, tail and indel reads.
    """
    split = F.col("kind").isin("split", "indel")
    telling = F.col("mei") | F.col("tail") | (F.col("kind") == "indel")
    cells = {"sr": split, "dpe": ~split}
    flags = {f"{p}_{k}_{s}": m & (F.col("side") == s) & t for p, t in (("raw", F.lit(True)), ("strict", F.col("_telling"))) for k, m in cells.items() for s in "LR"}
    flags |= {"mei": F.col("mei"), "mei_split": F.col("mei") & (F.col("kind") == "split"), "mei_disc": F.col("mei") & (F.col("kind") == "discordant"), "tail_split": F.col("tail") & split, "raw_sr": split, "raw_dpe": ~split}
    # a read is informative in its sample whatever row of it says so
    said = rows.filter(telling).select(*KEY, "sample", "read_name").distinct().withColumn("_telling", F.lit(True))
    known = rows.filter("read_name IS NOT NULL").join(said, [*KEY, "sample", "read_name"], "left").withColumn("_telling", F.coalesce("_telling", F.lit(False)))
    reads = known.groupBy(*KEY, "sample", "read_name").agg(*[F.max(m).alias(n) for n, m in flags.items()])
    out = reads.groupBy(*KEY).agg(*[F.count_if((F.col("sample") == s) & F.col(n)).alias(f"{s}_{n}") for s in SAMPLES for n in flags])
    for s, o in (SAMPLES, SAMPLES[::-1]):
        n = lambda c, s=s: F.col(f"{s}_{c}")
        faint = (n("mei_split") == 0) & (n("tail_split") == 0) & (n("mei_disc") <= 2)
        pairs_only = (n("raw_sr") == 0) & (n("raw_dpe") <= 2) & (n("tail_split") == 0)
        strict = (F.col(f"{o}_mei") > 0) & ((n("mei") == 0) | faint | pairs_only)
        any_mei = (n("mei") + F.col(f"{o}_mei")) > 0
        shown = {f"{k.upper()}_{side}": F.when(any_mei, F.when(strict, n(f"strict_{k}_{side}")).otherwise(n(f"raw_{k}_{side}"))).otherwise(0) for k in cells for side in "LR"}
        shown["MEI_MAPPED"] = n("mei")
        text = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in shown.items()])
        out = out.withColumns({f"{s}_supporting_reads": text, f"{s}_strict": strict, f"{s}_support_total": sum(v for k, v in shown.items() if k != "MEI_MAPPED")})
    return out.select(*KEY, *[f"{s}_{c}" for s in SAMPLES for c in ("supporting_reads", "strict", "support_total")])
