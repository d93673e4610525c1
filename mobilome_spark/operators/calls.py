"""From support metrics of a locus to scores, call tiers, stages and ranks.

Rows are loci with the flat metrics that ``support`` spreads
(``disease_L_mei_supported_reads`` and so on). Every block adds columns by
expressions alone, so a chain of blocks stays one projection over the loci;
only the depth guard needs a summary of all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.operators import rules
from mobilome_spark.operators.loci import KEY, REASONS, SAMPLES
from mobilome_spark.sources.scratch import written

#: Aligned bases an end needs, strictly and relaxed; run of A or T that stands for an end.
ANCHOR_BP, ANCHOR_BP_RELAXED, END_RUN = 25, 15, 12
#: Weights of the score's parts.
WEIGHTS = {
    "purity": 0.20, "mode": 0.16, "enrichment": 0.15, "fraction": 0.10, "family": 0.12, "subfamily": 0.04, "strand": 0.06,
    "tsd": 0.07, "tail": 0.05, "motif": 0.03, "logodds": 0.02, "overlap": 0.08, "mapq": 0.05,
}
SIDES = {"L": "left", "R": "right"}


def conform(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns of ``defaults`` that are missing are added, nulls in those present filled."""
    present = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in present else F.lit(v) for c, v in defaults.items()})


def locus_defaults() -> dict[str, object]:
    """Every metric that the blocks read, with the value of a locus that lacks it.

    Fixed value: a locus whose tracks were not looked up counts as flagged (999)."""
    side = {
        "mei_supported_reads": 0, "mei_score_sum": 0.0, "mei_family": "", "mei_subfamily": "", "mei_strand": "", "mei_start": 0, "mei_end": 0, "mei_anchor_bp_max": 0, "mei_target_len": 0, "mei_subfamily_purity": 0.0, "mei_breakpoint_mode": 0,
        "mei_breakpoint_mode_fraction": 0.0, "poly_at_reads": 0, "poly_at_fraction": 0.0, "poly_at_max_run": 0, "clip_overlap_informative_reads": 0, "clip_overlap_jaccard_median": 0.0,
    }
    disc = {
        "supported_reads": 0, "score_sum": 0.0, "left_supported_reads": 0, "right_supported_reads": 0, "family": "", "family_purity": 0.0, "subfamily": "", "left_subfamily": "", "right_subfamily": "", "strand": "", "strand_purity": 0.0,
        "left_target_pos_median": 0.0, "right_target_pos_median": 0.0, "two_sided_support": False, "geometry_consistent": False, "self_consistent": True,
    }
    anchor = {"unique_reads": 0, "complex_reason_max_fraction": 0.0}
    out: dict[str, object] = {"junk_flag_count": 999, "tsd_detected": False, "tsd_seq": "", "tsd_poly_at_filter_applied": False, "breakpoint_l1_en_motif_like": False, "breakpoint_yyrrrr_logodds_shift1_mt_adj": 0.0}
    out |= {"insertion_breakpoint_pos": 0, "insertion_breakpoint_interval_width_bp": 0, "known_mei_polymorphism": False}
    for s in SAMPLES:
        out |= {f"{s}_{k}_{m}": v for k in SIDES for m, v in side.items()}
        out |= {f"{s}_discordant_mei_{m}": v for m, v in disc.items()}
        out |= {f"{s}_discordant_anchor_{k}_{m}": v for k in SIDES.values() for m, v in anchor.items()}
        out |= {f"discordant_{s}_{r}_fraction": 0.0 for r in REASONS}
        out |= {f"split_{s}_mapq_mean": 0.0, f"{s}_total_rows": 0, f"{s}_full_mei_supported_reads": 0, f"{s}_supporting_reads": "", f"{s}_local_bam_peak_depth": 0.0, f"{s}_local_bam_mean_depth": 0.0}
    return out


def _c(*parts: str) -> Column:
    return F.col("_".join(parts))


def _either(make) -> Column:
    """Holds in one of the samples."""
    return reduce(or_, [make(s) for s in SAMPLES])


def _larger(make) -> Column:
    return F.greatest(*[make(s) for s in SAMPLES])


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _signed(x: Column) -> Column:
    return x.isin("+", "-")


def totals(df: DataFrame) -> DataFrame:
    """Reads and scores of both sides and of pairs, weighted shares, coherence and the enrichment of scores.

    Shares are weighted by split reads but divided by all element reads, pairs included.
    """
    for s in SAMPLES:
        both = lambda m, s=s: _c(s, "L", m) + _c(s, "R", m)
        sums = {f"{s}_split_mei_supported_reads": both("mei_supported_reads"), f"{s}_mei_supported_reads": both("mei_supported_reads") + _c(s, "discordant_mei_supported_reads")}
        sums |= {f"{s}_mei_score_sum": both("mei_score_sum") + _c(s, "discordant_mei_score_sum"), f"{s}_poly_at_reads": both("poly_at_reads")}
        df = df.withColumns(sums | {f"{s}_poly_at_max_run": F.greatest(_c(s, "L_poly_at_max_run"), _c(s, "R_poly_at_max_run"))})
        whole = F.greatest(_c(s, "mei_supported_reads"), F.lit(1))
        shares = {"breakpoint_mode_fraction": "mei_breakpoint_mode_fraction", "subfamily_purity": "mei_subfamily_purity", "poly_at_fraction": "poly_at_fraction"}
        weighted = lambda m, s=s, whole=whole: sum(_c(s, k, m) * _c(s, k, "mei_supported_reads") for k in SIDES) / whole
        df = df.withColumns({f"{s}_{n}_weighted": weighted(m) for n, m in shares.items()})
    coherence = 0.4 * F.col("disease_breakpoint_mode_fraction_weighted") + 0.4 * F.col("disease_subfamily_purity_weighted") + 0.2 * _unit(F.col("split_disease_mapq_mean") / 60)
    return df.withColumn("coherence_score", coherence).withColumn("mei_score_enrichment_ratio", (F.col("disease_mei_score_sum") + 0.1) / (F.col("control_mei_score_sum") + 0.1))


def _span_of(s: str) -> Column:
    """(low, high) on the element in one sample, or null: both ends, one end and an
    opposite tail, or the medians of pairs."""
    def end(k: str, least: int) -> Column:
        return (_c(s, k, "mei_supported_reads") >= 1) & (_c(s, k, "mei_anchor_bp_max") >= least) & (_c(s, k, "mei_start") > 0) & (_c(s, k, "mei_end") >= _c(s, k, "mei_start"))

    def pair(low: Column, high: Column) -> Column:
        return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    tail = {k: (_c(s, k, "poly_at_reads") >= 1) & (_c(s, k, "poly_at_max_run") >= END_RUN) for k in SIDES}
    length = F.greatest(_c(s, "L_mei_target_len"), _c(s, "R_mei_target_len"))
    steps = [F.when(end("L", least) & end("R", least), pair(F.least(_c(s, "L_mei_start"), _c(s, "R_mei_start")), F.greatest(_c(s, "L_mei_end"), _c(s, "R_mei_end")))) for least in (ANCHOR_BP, ANCHOR_BP_RELAXED)]
    # strict ends are relaxed ends too, and give the same span
    left, right = ((end(k, ANCHOR_BP_RELAXED) & tail[o], pair(_c(s, k, "mei_start"), F.greatest(length, _c(s, k, "mei_end")))) for k, o in (("L", "R"), ("R", "L")))
    half = F.when(*left).when(*right)
    d = lambda m: _c(s, "discordant_mei", m)
    low, high = F.least(d("left_target_pos_median"), d("right_target_pos_median")), F.greatest(d("left_target_pos_median"), d("right_target_pos_median"))
    mates = F.when(d("two_sided_support") & d("geometry_consistent") & (low.cast("bigint") > 0), pair(low, high))
    return F.coalesce(*steps, F.when(length > 0, half), mates)


def insertion_spans(df: DataFrame) -> DataFrame:
    """Span on the element (start is its higher end) and orientation per sample, and of the event."""
    for s in SAMPLES:
        strands = F.array_distinct(F.filter(F.array(_c(s, "L_mei_strand"), _c(s, "R_mei_strand")), _signed))
        split = F.when(F.size(strands) == 1, strands[0]).when(F.size(strands) == 2, "mixed").otherwise("")
        mates = _c(s, "discordant_mei_strand")
        df = df.withColumns({"_span": _span_of(s), f"{s}_insertion_orientation": F.when(~_signed(split) & _signed(mates), mates).otherwise(split)})
        number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        high, low = F.col("_span.high"), F.col("_span.low")
        df = df.withColumns({f"{s}_insertion_mei_start": number(high), f"{s}_insertion_mei_end": number(low), f"{s}_insertion_mei_span": number(high - low + 1)}).drop("_span")
    two = {s: reduce(and_, [_c(s, k, "mei_supported_reads") >= 1 for k in SIDES]) | reduce(and_, [_c(s, "discordant_mei", k, "supported_reads") >= 1 for k in SIDES.values()]) for s in SAMPLES}
    ways = {s: _c(s, "insertion_orientation") for s in SAMPLES}
    voices = [ways[s] for s in SAMPLES] + [_c(s, m) for s in SAMPLES for m in ("discordant_mei_strand", "L_mei_strand", "R_mei_strand")]
    orientation = F.coalesce(*[F.when(two[s] & _signed(ways[s]), ways[s]) for s in SAMPLES], *[F.when(_signed(v), v) for v in voices], F.lit(""))
    d, c = (_c(s, "insertion_mei_span") for s in SAMPLES)
    more = F.when((d > 0) & (c > 0), F.when(F.col("disease_mei_supported_reads") >= F.col("control_mei_supported_reads"), d).otherwise(c)).otherwise(F.greatest(d, c))
    span = F.coalesce(*[F.when(two[s] & (x > 0), x) for s, x in zip(SAMPLES, (d, c), strict=True)], more)
    return df.withColumns({"insertion_orientation": orientation, "insertion_mei_span": span})


def event_labels(df: DataFrame) -> DataFrame:
    """Subfamily with most reads (the first of equal ones) and first family named, of pairs and sides of both samples."""
    label = lambda s, place: (_c(s, place, "subfamily"), _c(s, place, "supported_reads"))
    seen = []
    for s in SAMPLES:
        seen += [label(s, "discordant_mei"), *[label(s, f"discordant_mei_{k}") for k in SIDES.values()], *[label(s, f"{k}_mei") for k in SIDES]]
    votes = F.array(*[F.struct((-n).cast("bigint").alias("n"), F.lit(i).alias("turn"), x.alias("label")) for i, (x, n) in enumerate(seen)])
    best = F.array_min(F.filter(votes, lambda v: (v["label"] != "") & (v["n"] < 0)))["label"]
    texts = [_c(s, place, kind) for kind in ("family", "subfamily") for s in SAMPLES for place in ("discordant_mei", "L_mei", "R_mei")]
    families = [F.nullif(rules.mei_family(t, ("ALU", "SVA", "LINE1"), ""), F.lit("")) for t in texts]
    return df.withColumns({"event_subfamily": F.coalesce(best, F.lit("")), "event_family": F.coalesce(*families, F.lit(""))})


def model_scores(df: DataFrame) -> DataFrame:
    """Score in 0..1, companion signs of other rearrangements, call tier and status of the samples."""
    for s in SAMPLES:
        df = df.withColumns({f"{s}_{n}_agreement": rules.agreement(_c(s, "L_mei", n), _c(s, "R_mei", n)) for n in ("family", "subfamily", "strand")})
        d = lambda m, s=s: _c(s, "discordant_mei", m)
        reads = {k: _c(s, k, "mei_supported_reads") for k in SIDES}
        agreeing = (d("left_supported_reads") >= 1) & (d("right_supported_reads") >= 1) & (d("family_purity") >= 0.6) & (d("strand_purity") >= 0.6) & d("geometry_consistent") & d("self_consistent")
        complex_ = {k: (_c(s, "discordant_anchor", k, "unique_reads") >= 2) & (_c(s, "discordant_anchor", k, "complex_reason_max_fraction") >= 0.6) & (d(f"{k}_supported_reads") <= 1) for k in SIDES.values()}
        firm = {k: (reads[k] >= 2) & (_c(s, k, "mei_subfamily_purity") >= 0.7) & (_c(s, k, "mei_breakpoint_mode_fraction") >= 0.5) for k in SIDES}
        df = df.withColumns({
            f"{s}_two_sided_support": (reads["L"] >= 1) & (reads["R"] >= 1), f"{s}_discordant_mei_consistent_support": agreeing, **{f"{s}_discordant_anchor_{k}_complex_side": m for k, m in complex_.items()},
            f"{s}_mei_with_complex_sidepair": (firm["L"] & complex_["right"]) | (firm["R"] & complex_["left"]),
        })
    fraction = lambda r, s="disease": _c("discordant", s, r, "fraction")
    strong, weak = ("large_insert", "interchrom", "mate_unmapped"), ("same_strand", "improper_pair")
    overlaps = [(_c(s, k, "clip_overlap_informative_reads"), _c(s, k, "clip_overlap_jaccard_median")) for s in SAMPLES for k in SIDES]
    held = [(n, F.when(n >= 2, m).otherwise(0.0)) for n, m in overlaps]
    named = F.concat_ws("+", *[F.when(fraction(r) >= 0.6, r) for r in strong])
    df = df.withColumns({
        "event_clip_overlap_consistency": _unit(F.greatest(*[m for _, m in held])), "event_clip_overlap_informative_reads_max": F.greatest(*[n for n, _ in held]),
        "event_one_side_overlap_anchor": reduce(or_, [((n >= 3) & (m >= 0.55)) | ((n >= 2) & (m >= 0.70)) for n, m in held]),
        "complex_sv_signal_score": F.greatest(*[fraction(r, s) for s in SAMPLES for r in REASONS]), "complex_sv_companion_signal": F.greatest(*[fraction(r, s) for s in SAMPLES for r in strong]) >= 0.6,
        "complex_sv_signature_label": F.when(named != "", named).when(fraction(weak[0]) >= 0.5, weak[0]).when(fraction(weak[1]) >= 0.5, weak[1]).otherwise("none"),
        "event_mapq_scaled": _larger(lambda s: _unit(_c("split", s, "mapq_mean") / 60)), "event_poly_at_fraction": _unit(_larger(lambda s: _c(s, "poly_at_fraction_weighted"))),
        "event_logodds_scaled": _unit(F.col("breakpoint_yyrrrr_logodds_shift1_mt_adj") / 6),
    })
    e, c = F.col("mei_score_enrichment_ratio"), F.col
    parts = {
        "purity": _larger(lambda s: _c(s, "subfamily_purity_weighted")), "mode": _larger(lambda s: _c(s, "breakpoint_mode_fraction_weighted")), "enrichment": _unit(e / (e + 1)),
        "fraction": _larger(lambda s: _unit(_c(s, "mei_supported_reads") / F.greatest(_c(s, "total_rows"), F.lit(1)))), **{n: _larger(lambda s, n=n: _c(s, n, "agreement")) for n in ("family", "subfamily", "strand")},
        "tsd": c("tsd_detected").cast("double"), "tail": c("event_poly_at_fraction"), "motif": c("breakpoint_l1_en_motif_like").cast("double"), "logodds": c("event_logodds_scaled"),
        "overlap": c("event_clip_overlap_consistency"), "mapq": c("event_mapq_scaled"),
    }
    reads = {k: c(f"disease_{k}_mei_supported_reads") for k in SIDES}
    one_sided = (F.greatest(*reads.values()) >= 2) & (F.least(*reads.values()) < 2)
    firm_pairs = _either(lambda s: _c(s, "discordant_mei_consistent_support"))
    two_like = (F.least(*reads.values()) >= 2) | (one_sided & (c("disease_discordant_mei_supported_reads") >= 3)) | c("control_two_sided_support") | firm_pairs
    df = df.withColumns({
        "insertion_model_score": _unit(sum(WEIGHTS[n] * x for n, x in parts.items())), "event_two_sided_like_support": two_like,
        "mei_with_complex_sv_signature": c("complex_sv_companion_signal") & (c("disease_mei_supported_reads") >= 2),
        "event_family_consistent": _either(lambda s: _c(s, "family_agreement") == 1), "event_strand_consistent": _either(lambda s: _c(s, "strand_agreement") == 1),
        "event_side_breakpoint_consistency": F.greatest(F.least("disease_L_mei_breakpoint_mode_fraction", "disease_R_mei_breakpoint_mode_fraction"), "control_breakpoint_mode_fraction_weighted"),
        "event_polyA_or_tsd_or_motif": c("tsd_detected") | (c("event_poly_at_fraction") >= 0.2) | c("breakpoint_l1_en_motif_like") | (c("event_logodds_scaled") >= 0.25),
        "event_quality_clean": (c("junk_flag_count") == 0) & (c("event_mapq_scaled") >= 0.3), "_rescued": c("event_one_side_overlap_anchor") & (c("tsd_detected") | firm_pairs),
        "_simple": (c("event_poly_at_fraction") >= 0.2) | c("tsd_poly_at_filter_applied"), "_sidepair": _either(lambda s: _c(s, "mei_with_complex_sidepair")),
    })
    fits = lambda least: ~c("_simple") | (c("event_clip_overlap_consistency") >= least) | c("_rescued")
    above = lambda score, coherence: (c("insertion_model_score") >= score) & (c("coherence_score") >= coherence)
    labelled = c("event_family_consistent") & c("event_strand_consistent")
    high = above(0.60, 0.55) & c("event_two_sided_like_support") & labelled & (c("event_side_breakpoint_consistency") >= 0.55) & c("event_quality_clean") & c("event_polyA_or_tsd_or_motif") & fits(0.20)
    some = c("event_two_sided_like_support") | _either(lambda s: _c(s, "mei_supported_reads") >= 1)
    df = df.withColumn("passes_insertion_model", high)
    df = df.withColumn("passes_insertion_model_provisional", ~c("passes_insertion_model") & above(0.55, 0.50) & some & c("event_family_consistent") & fits(0.12))
    neither = ~c("passes_insertion_model") & ~c("passes_insertion_model_provisional")
    tier = F.when(c("passes_insertion_model"), "high_conf_two_sided").when(c("_sidepair"), "mei_with_complex").when(c("passes_insertion_model_provisional"), "provisional_one_sided").otherwise("none")
    seen = {s: sum(rules.support_field(_c(s, "supporting_reads"), n) for n in ("SR_L", "SR_R", "DPE_L", "DPE_R")) >= 1 for s in SAMPLES}
    status = F.when(seen["disease"] & seen["control"], "shared").when(seen["disease"], "disease_only").when(seen["control"], "control_only").otherwise("low_support")
    return df.withColumns({
        "passes_insertion_model_complex": neither & c("_sidepair") & labelled & c("event_quality_clean") & above(0.50, 0.45), "complex_mei_event": c("_sidepair") | c("mei_with_complex_sv_signature"),
        "insertion_call_tier": tier, "sample_status_label": status, "likely_false_positive_control_only": status == "control_only",
    }).drop("_rescued", "_simple", "_sidepair")


def silver_stage(df: DataFrame) -> DataFrame:
    """Loci that are clean, carry element reads, and are supported or resolved, and consistent or resolved; else the reasons."""
    c = F.col
    has = {(s, k): (_c(s, k, "mei_supported_reads") >= 1) | (_c(s, "discordant_mei", n, "supported_reads") >= 1) for s in SAMPLES for k, n in SIDES.items()}
    tail = {(s, k): _c(s, k, "poly_at_reads") >= 1 for s in SAMPLES for k in SIDES}
    other = {(s, k): _c(s, "discordant_anchor", n, "complex_side") for s in SAMPLES for k, n in SIDES.items()}
    # the control's direction is that of its pairs
    way = {"disease": c("disease_insertion_orientation"), "control": c("control_discordant_mei_strand")}
    # a tail belongs right of a forward insertion and left of a reverse one
    fitting = {"R": "+", "L": "-"}
    facing = (("L", "R"), ("R", "L"))
    firm, tails, whole, aside, lopsided = [], [], [], [], []
    for s in SAMPLES:
        d = lambda m, s=s: _c(s, "discordant_mei", m)
        firm.append(_c(s, "two_sided_support") & (_c(s, "family_agreement") == 1) & (_c(s, "strand_agreement") == 1))
        firm.append((d("left_supported_reads") >= 1) & (d("right_supported_reads") >= 1) & (d("family_purity") >= 0.95) & (d("strand_purity") >= 0.95) & d("geometry_consistent") & d("self_consistent"))
        tails += [tail[s, k] & has[s, o] & ((way[s] == "") | (way[s] == fitting[k])) for k, o in facing]
        whole.append(reduce(and_, [has[s, k] | tail[s, k] | other[s, k] for k in SIDES]))
        aside += [has[s, k] & (other[s, o] | tail[s, o]) for k, o in facing]
        against = {k: has[s, k] | (way[s].isin("", fitting[k]) & tail[s, k]) for k in SIDES}
        lopsided.append(reduce(or_, [has[s, k] & against[o] for k, o in facing]) & ((_c(s, "family_agreement") == 1) | (d("family_purity") >= 0.95)) & d("self_consistent"))
    any_ = lambda parts: reduce(or_, parts)
    placed = any_([(_c(s, k, "mei_supported_reads") >= 1) & (_c(s, k, "mei_breakpoint_mode") > 0) for s in SAMPLES for k in SIDES])
    df = df.withColumns({
        "bronze_stage_pass": F.lit(True), "silver_bilateral_support_any": _either(lambda s: has[s, "L"] & has[s, "R"]), "silver_polyA_sidepair_support": any_(tails), "silver_asymmetric_insertion_like": any_(lopsided),
        "silver_complex_structural_consistent": any_(whole) & any_(aside) & (_either(lambda s: _c(s, "mei_with_complex_sidepair")) | c("mei_with_complex_sv_signature")),
        "silver_breakpoint_or_span_resolved": placed | (c("insertion_breakpoint_interval_width_bp") > 0) | (c("insertion_mei_span") > 0),
        "silver_any_mei_support": _either(lambda s: (_c(s, "mei_supported_reads") >= 1) | (_c(s, "full_mei_supported_reads") >= 1)),
    })
    consistent = any_(firm) | (c("event_family_consistent") & (c("event_strand_consistent") | c("silver_polyA_sidepair_support"))) | c("silver_complex_structural_consistent") | c("silver_asymmetric_insertion_like")
    df = df.withColumn("silver_consistency_pass", consistent)
    supported = any_([c(n) for n in ("silver_bilateral_support_any", "silver_polyA_sidepair_support", "silver_complex_structural_consistent", "silver_breakpoint_or_span_resolved", "silver_asymmetric_insertion_like")])
    tests = {
        "junk_region_flagged": c("junk_flag_count") == 0, "no_mei_signal": c("silver_any_mei_support"), "no_bilateral_or_breakpoint_span_support": supported,
        "no_consistency_signal": c("silver_consistency_pass") | c("silver_breakpoint_or_span_resolved"),
    }
    passed = reduce(and_, tests.values())
    return df.withColumns({"silver_stage_pass": passed, "stage_fail_reason": F.concat_ws(";", *[F.when(~m, n) for n, m in tests.items()]), "analysis_stage_tier": F.when(passed, "silver").otherwise("bronze")})


def gold_stage(df: DataFrame, empirical: list[str] | None = None, threshold: float = 0.001) -> DataFrame:
    """Silver loci that no background test (``empirical``: p-value columns) and no depth outlier speaks against.

    The depth of a locus is the larger peak, or mean where no locus has a peak; three
    deviations above the silver loci's depths is too deep, save for known insertions.
    """
    c = F.col
    peak, mean = (_larger(lambda s, k=k: _c(s, f"local_bam_{k}_depth")) for k in ("peak", "mean"))
    depths = df.select(c("silver_stage_pass").alias("_silver"), peak.alias("_peak"), mean.alias("_mean"))
    # one row
    whole = depths.agg(
        (F.max("_peak") > 0).alias("_peaks"),
        *[f(F.when(m & (c(v) > 0), c(v))).alias(f"_{f.__name__}{v}{n}") for f in (F.avg, F.stddev_pop) for v in ("_peak", "_mean") for n, m in (("_silver", c("_silver")), ("_all", F.lit(True)))],
    )
    pick = lambda f, v: F.coalesce(c(f"_{f}{v}_silver"), c(f"_{f}{v}_all"), F.lit(0.0))
    whole = whole.select("_peaks", *[F.when(c("_peaks"), pick(f, "_peak")).otherwise(pick(f, "_mean")).alias(n) for f, n in (("avg", "_centre"), ("stddev_pop", "_sigma"))])
    df = df.join(F.broadcast(whole))
    deep = (c("_sigma") > 1e-6) & ((F.when(c("_peaks"), peak).otherwise(mean) - c("_centre")) >= 3 * c("_sigma"))
    odd = reduce(or_, [F.coalesce(c(p), F.lit(1.0)) < threshold for p in empirical]) if empirical else F.lit(False)
    df = df.withColumns({"gold_empirical_outlier": odd, "_deep": deep & ~c("known_mei_polymorphism")})
    why = F.concat_ws(";", F.when(c("gold_empirical_outlier"), "empirical_outlier"), F.when(c("_deep"), "depth_pileup_artifact"))
    gold, silver = c("silver_stage_pass") & (why == ""), c("silver_stage_pass")
    out = df.withColumns({
        "gold_stage_pass": gold, "gold_stage_fail_reason": F.when(silver, why).otherwise(""), "analysis_stage_tier": F.when(gold, "gold").otherwise(c("analysis_stage_tier")),
        "stage_fail_reason": F.when(gold, "").when(silver, F.concat(F.lit("gold:"), why)).otherwise(c("stage_fail_reason")),
    })
    return out.drop("_deep", "_peaks", "_centre", "_sigma")


def allele_fractions(df: DataFrame) -> DataFrame:
    """Allele fractions from split reads and half of the pairs against reference reads
    (``{sample}_context_non_sv_reads``; null: unknown), with bounds, confidence and status."""
    known = {f"{s}_context_non_sv_reads" for s in SAMPLES} <= set(df.columns)
    for s in SAMPLES:
        ref = _c(s, "context_non_sv_reads").cast("double") if known else F.lit(None).cast("double")
        df = df.withColumns({f"asm_{s}_alt_soft_reads": _c(s, "split_mei_supported_reads") + 0.5 * _c(s, "discordant_mei_supported_reads"), f"asm_{s}_ref_support_reads": ref})
        vaf, low, high = rules.vaf_bounds(F.col(f"asm_{s}_alt_soft_reads"), F.col(f"asm_{s}_ref_support_reads"))
        df = df.withColumns({f"asm_{s}_vaf": vaf, f"asm_{s}_vaf_ci_low": low, f"asm_{s}_vaf_ci_high": high, f"asm_{s}_callable_reads": F.col(f"asm_{s}_alt_soft_reads") + F.col(f"asm_{s}_ref_support_reads")})
    width = sum(F.coalesce(F.col(f"asm_{s}_vaf_ci_high") - F.col(f"asm_{s}_vaf_ci_low"), F.lit(1.0)) for s in SAMPLES) / 2
    none = reduce(and_, [F.coalesce(F.col(f"asm_{s}_callable_reads"), F.lit(0.0)) <= 0 for s in SAMPLES])
    status = F.when(~F.col("silver_stage_pass"), "").when(none, "heuristic_no_callable_reads").otherwise("heuristic_estimated" if known else "heuristic_no_reference_support")
    return df.withColumns({"asm_vaf_delta": F.col("asm_disease_vaf") - F.col("asm_control_vaf"), "assembly_confidence_score": _unit(1 - width), "asm_status": status})


def artifact_flag() -> Column:
    """Deep, incoherent piles of A and T in simple sequence, unless the insertion is known."""
    c, tsd = F.col, F.upper("tsd_seq")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(tsd, F.lit("([AT]+)"), F.lit(1)), F.length)), F.lit(0))
    share = F.coalesce((F.length(tsd) - F.length(F.regexp_replace(tsd, "[AT]", ""))) / F.nullif(F.length(tsd), F.lit(0)), F.lit(0.0))
    rich = (F.length(tsd) >= 8) & (share >= 0.85) & (longest >= 6)
    piled = (F.greatest("disease_poly_at_max_run", "control_poly_at_max_run") >= 30) & (c("disease_poly_at_reads") + c("control_poly_at_reads") >= 8)
    reads = _larger(lambda s: _c(s, "split_mei_supported_reads")) + _larger(lambda s: _c(s, "discordant_mei_supported_reads"))
    return ~c("known_mei_polymorphism") & (c("coherence_score") < 0.45) & piled & (reads >= 35) & (c("tsd_poly_at_filter_applied") | rich | (c("complex_sv_signal_score") >= 0.8))


def prioritize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``priority_rank`` of each locus: stage, not an artifact, read support, and then the rest; ties by the key.

    Ranks run within the columns ``by``, or over all loci: these are then written
    in ranges of the order, ranked within a range, and moved by the sizes of the
    ranges before, so that no task sees all of them.
    """
    mapped = _larger(lambda s: rules.support_field(_c(s, "supporting_reads"), "MEI_MAPPED"))
    split, disc = (_larger(lambda s, k=k: _c(s, k, "mei_supported_reads")) for k in ("split", "discordant"))
    total = split + disc
    score = F.rint((0.50 * F.log1p(split) + 0.35 * F.log1p(disc) + 0.15 * _unit(mapped / F.greatest(total, F.lit(1)))) * 1e6) / 1e6
    df = df.withColumns({"low_complexity_noisy_artifact_flag": artifact_flag(), "read_support_heuristic_score": score})
    tail = reduce(or_, [_c(s, m) > 0 for s in SAMPLES for m in ("poly_at_reads", "poly_at_max_run")])
    order = [F.desc("gold_stage_pass"), F.desc("silver_stage_pass"), F.col("low_complexity_noisy_artifact_flag"), F.desc("read_support_heuristic_score")]
    order += [x.desc() for x in (mapped, split, disc, F.col("tsd_detected"), tail, F.col("insertion_breakpoint_pos") > 0, F.col("event_clip_overlap_consistency"), F.col("insertion_model_score"))]
    order += [F.col(k).asc() for k in KEY]
    if by:
        return df.withColumn("priority_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked-loci")
    # a row per range, as many as shuffle partitions
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    ranked = ranges.join(F.broadcast(before), "_range").withColumn("priority_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return ranked.drop("_range", "_before")
