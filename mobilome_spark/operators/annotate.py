"""The annotation stage end to end: loci with the support of aligned clips and mates, scored, staged and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.operators import breakpoints, calls, refine, rules, support
from mobilome_spark.operators.loci import KEY, SAMPLES
from mobilome_spark.sources.scratch import written

_SIDED = {"sample": list(SAMPLES), "side": ["L", "R"]}


def metrics(loci: DataFrame, split: DataFrame, discordant: DataFrame) -> DataFrame:
    """``loci`` with every metric of their rows; one left join per metric table, all on the key.

    ``split`` and ``discordant`` are evidence rows assigned to loci; those with a
    ``target`` are aligned to an element (see ``support`` for their columns).
    """
    hit = F.coalesce("target", F.lit("")) != ""
    clips, mates = split.filter(hit), discordant.filter(hit)
    # written: it also names the preferred targets
    pairs = written(support.discordant_support(mates), "locus-pairs")
    preferred = pairs.filter("subfamily <> ''").groupBy(*KEY).agg(F.min_by("subfamily", F.when(F.col("sample") == "disease", 0).otherwise(1)).alias("preferred"))
    tail = F.col("poly_tail_rescued") | (F.col("clip_poly_at_run") >= support.TAIL_RUN)
    rows = split.select(*KEY, "sample", "read_name", F.col("clip_side").alias("side"), F.lit("split").alias("kind"), hit.alias("mei"), tail.alias("tail"))
    pair_tail = F.col("poly_tail_anchor_rescued") | (F.col("anchor_poly_at_run") >= support.TAIL_RUN)
    rows = rows.unionByName(discordant.select(*KEY, "sample", "read_name", support.anchor_side(F.col("pos")).alias("side"), F.lit("discordant").alias("kind"), hit.alias("mei"), pair_tail.alias("tail")))
    anchors = support.anchor_sides(discordant).withColumn("side", F.when(F.col("side") == "L", "left").otherwise("right"))
    parts = [
        support.spread_sides(support.side_metrics(clips, preferred)), support.spread(pairs, ["sample"], "{sample}_discordant_mei_{metric}", {"sample": list(SAMPLES)}),
        support.spread(anchors, ["sample", "side"], "{sample}_discordant_anchor_{side}_{metric}", {"sample": list(SAMPLES), "side": ["left", "right"]}),
        breakpoints.breakpoint_modes(split), support.support_counts(rows),
    ]
    for part in parts:
        loci = loci.join(part, KEY, "left")
    return loci


def full_panel(loci: DataFrame, split: DataFrame, discordant: DataFrame) -> DataFrame:
    """``loci`` with the support that the panel of full elements gives (``{sample}_full_...``), from
    rows as for ``metrics`` aligned to that panel; a locus without any has none."""
    hit = F.coalesce("target", F.lit("")) != ""
    sides = support.spread(support.side_metrics(split.filter(hit)), ["sample", "clip_side"], "{sample}_full_{clip_side}_{metric}", {"sample": list(SAMPLES), "clip_side": ["L", "R"]})
    pairs = support.spread(support.discordant_support(discordant.filter(hit)), ["sample"], "{sample}_full_discordant_mei_{metric}", {"sample": list(SAMPLES)})
    loci = loci.join(sides, KEY, "left").join(pairs, KEY, "left")
    reads = lambda s: [f"{s}_full_L_mei_supported_reads", f"{s}_full_R_mei_supported_reads", f"{s}_full_discordant_mei_supported_reads"]
    return loci.withColumns({f"{s}_full_mei_supported_reads": sum(F.coalesce(c, F.lit(0)) for c in reads(s)) for s in SAMPLES})


def _placed(df: DataFrame) -> DataFrame:
    df = df.withColumn("_b", breakpoints.breakpoint_choice())
    return df.withColumns({"insertion_breakpoint_pos": F.col("_b.pos"), "insertion_breakpoint_source": F.col("_b.source")}).drop("_b")


def annotate(
    loci: DataFrame, split: DataFrame, discordant: DataFrame, by: list[str] | None = None, blocks: DataFrame | None = None, full: tuple[DataFrame, DataFrame] | None = None,
    assembled: DataFrame | None = None, empirical: list[str] | None = None,
) -> DataFrame:
    """Scored, staged and ranked loci; a locus without rows keeps zeros and stays bronze.

    With reference ``blocks`` duplications are also sought in and read from the
    reference, and breakpoints are matched with motifs. ``full``: the split and the
    discordant rows aligned to the panel of full elements. ``assembled``: values of
    local assemblies, which go before those of single reads. ``empirical``: columns of
    ``loci`` with probabilities against a background, for the gold stage. Loci without
    ``junk_flag_count`` count as flagged.
    """
    modes = {f"{s}_{k}_{t}_breakpoint_{m}": 0 for s in SAMPLES for k in "LR" for t in ("split", "poly") for m in ("mode", "support")}
    rescued = {f"{t}_{s}_poly_tail_rescued_unique_reads": 0 for t in ("split", "discordant") for s in SAMPLES}
    placed = ("tsd_detected", "insertion_breakpoint_pos", "insertion_breakpoint_interval_width_bp")
    found = metrics(loci, split, discordant)
    found = found if full is None else full_panel(found, *full)
    df = calls.conform(found, {n: v for n, v in calls.locus_defaults().items() if n not in placed} | modes | rescued)
    # written once: the stages below read the loci more than once
    df = calls.insertion_spans(calls.totals(written(df, "locus-metrics")))
    at = lambda k, m: {s: F.col(f"{s}_{k}_{m}") for s in SAMPLES}
    reads = {s: F.col(f"{s}_L_mei_supported_reads") + F.col(f"{s}_R_mei_supported_reads") for s in SAMPLES}
    df = df.withColumn("_t", rules.tsd_pair(at("L", "mei_breakpoint_mode"), at("R", "mei_breakpoint_mode"), reads))
    names = {"tsd_left_breakpoint": "left", "tsd_right_breakpoint": "right", "tsd_len_estimate": "length", "tsd_evidence_source": "source"}
    df = breakpoints.rescue_tsd(df.withColumns({n: F.col(f"_t.{f}") for n, f in names.items()}).drop("_t"))
    df = _placed(df)
    if blocks is not None:
        df = _placed(breakpoints.rescue_tsd(breakpoints.near(df, blocks), [breakpoints.reference_rescue()]))
        df = breakpoints.sequence_metrics(df).drop("region", "region_start0")
    df = _placed(breakpoints.drop_tail_like(df))
    found = [F.col(c) for c in ("tsd_left_breakpoint", "tsd_right_breakpoint", *[f"{s}_{k}_mei_breakpoint_mode" for s in SAMPLES for k in "LR"])]
    left, right, width, tier, pos = rules.breakpoint_interval([f.cast("bigint") for f in found], F.col("insertion_breakpoint_pos"), F.col("window_start"), F.col("window_end"))
    prefix = "insertion_breakpoint_interval_"
    df = df.withColumns({f"{prefix}start": left, f"{prefix}end": right, f"{prefix}width_bp": width, f"{prefix}tier": tier, "insertion_breakpoint_pos": pos})
    df = refine.local_support(df).withColumn("consistent_mei_family", refine.consistent_family())
    if assembled is not None:
        base = {"breakpoint_evidence_source": "", "tsd_seq": "", "tsd_len_estimate": 0, "poly_at_max_run": 0, "insertion_orientation": "", "insertion_mei_span": 0}
        base |= {f"{s}_insertion_mei_{e}": 0 for s in SAMPLES for e in ("start", "end")}
        df = refine.assembly_overrides(calls.conform(df, base), assembled)
    # written once: the gold stage reads the silver one twice
    silver = written(calls.silver_stage(calls.model_scores(calls.event_labels(df))), "locus-silver")
    return calls.prioritize(calls.allele_fractions(calls.gold_stage(silver, empirical)), by)
