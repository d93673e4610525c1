"""Candidate loci: windows built from evidence, with metrics per sample and track flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.operators import cluster, intervals
from mobilome_spark.sources.scratch import written

KEY = ["chrom", "window_start", "window_end"]
#: Evidence kinds and samples; a metric is named kind_sample_metric.
KINDS, SAMPLES = ("split", "discordant"), ("disease", "control")
REASONS = ("mate_unmapped", "interchrom", "large_insert", "same_strand", "improper_pair")
TRACKS = ("segdup", "low_mappability", "gap_region", "encode_blacklist")


def build_loci(split: DataFrame, discordant: DataFrame, split_gap: int = 30, discordant_gap: int = 400, max_span: int = 2000) -> DataFrame:
    """Distinct windows (``KEY``) around clusters of evidence positions.

    Split positions form seeds by ``split_gap``. A discordant position joins the
    nearest seed within ``discordant_gap`` (ties: the smaller start); the others
    form clusters of their own. Clusters are cut greedily at ``max_span`` and
    widened by the gap they were built with. Seeds do not grow as positions join.
    """
    own = written(cluster.gap_clusters(split.select("chrom", "pos").filter("pos IS NOT NULL").distinct(), "chrom", "pos", split_gap), "loci-split")
    seeds = own.groupBy("chrom", "cluster_id").agg(F.min("pos").alias("seed_start"), F.max("pos").alias("seed_end"))
    pairs = discordant.select("chrom", "pos").filter("pos IS NOT NULL").distinct()
    near = intervals.nearest_seed(pairs, seeds.drop("cluster_id"), "chrom", "pos", "seed_start", "seed_end", discordant_gap, ["chrom", "pos"])
    near = written(near, "loci-discordant")
    alone = cluster.gap_clusters(near.filter("distance IS NULL").select("chrom", "pos"), "chrom", "pos", discordant_gap)
    named = lambda seeded, at: F.struct("chrom", F.lit(seeded).alias("seeded"), F.col(at).cast("bigint").alias("at")).alias("_locus")
    members = own.join(seeds.select("chrom", "cluster_id", "seed_start"), ["chrom", "cluster_id"]).select(named(True, "seed_start"), "pos")
    members = members.unionByName(near.filter("distance IS NOT NULL").select(named(True, "seed_start"), "pos")).unionByName(alone.select(named(False, "cluster_id"), "pos"))
    cut = cluster.greedy_segments(members, "_locus", "pos", max(split_gap, min(discordant_gap, max_span)), max_span)
    flank = F.when(F.col("_locus.seeded"), split_gap).otherwise(discordant_gap)
    start, end = F.greatest(F.lit(1), F.col("start_pos") - flank), F.col("end_pos") + flank
    return cut.select("_locus.chrom", start.cast("bigint").alias("window_start"), end.cast("bigint").alias("window_end")).distinct()


def assign(evidence: DataFrame, loci: DataFrame) -> DataFrame:
    """Evidence rows with the key of the tightest locus that holds them; others go.

    Only distinct positions meet the loci; rows follow by an equi-join.
    """
    places = evidence.select("chrom", "pos").filter("pos IS NOT NULL").distinct()
    where = intervals.tightest_interval(places, loci, "chrom", "pos", "window_start", "window_end", ["chrom", "pos"])
    return evidence.join(where, ["chrom", "pos"])


def _measures(kind: str) -> dict[str, tuple[str, Column]]:
    """Metric of an evidence row: how it is folded, and its value."""
    shared = {
        "mapq_mean": ("mean", F.col("mapq")), "mapq_min": ("min", F.col("mapq")), "nm_mean": ("mean", F.col("nm")), "nm_max": ("max", F.col("nm")),
        "poly_tail_rescued_rows": ("sum", F.col("rescued").cast("int")), "poly_tail_at_fraction_mean": ("mean", F.col("poly_fraction")), "poly_tail_at_run_max": ("max", F.col("poly_run")),
    }
    if kind == "split":
        return shared | {"clip_len_mean": ("mean", F.col("clip_len")), "clip_len_max": ("max", F.col("clip_len")), "sa_fraction": ("mean", F.col("has_sa").cast("int"))}
    return shared | {"abs_tlen_mean": ("mean", F.abs("template_len"))} | {f"{r}_fraction": ("mean", F.contains("discordant_reasons", F.lit(r)).cast("int")) for r in REASONS}


def locus_metrics(assigned: dict[str, DataFrame]) -> DataFrame:
    """All metrics of ``split`` and ``discordant`` rows per key, 0 where a sample has none.

    Rows are folded per (key, sample, read) first, so that distinct reads are
    counted without expanding rows and a deep locus is combined before it moves.
    """
    folded = []
    for kind in KINDS:
        m = _measures(kind)
        how = {"mean": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        cells = [how[f](c).alias(f"{kind}_{n}") for n, (f, c) in m.items()]
        folded.append(assigned[kind].groupBy(*KEY, "sample", "read_name").agg(F.count(F.lit(1)).alias(f"{kind}_rows"), *cells))
    per_read = folded[0].unionByName(folded[1], allowMissingColumns=True)
    out = []
    for kind in KINDS:
        for sample in SAMPLES:
            of = lambda c: F.when(F.col("sample") == sample, F.col(f"{kind}_{c}"))  # noqa: E731, B023
            rows, read = F.sum(of("rows")), F.col("read_name")
            name = lambda c, n: F.coalesce(c, F.lit(0)).alias(f"{kind}_{sample}_{n}")  # noqa: E731, B023
            out += [name(rows, "rows"), F.count_if(of("rows").isNotNull() & read.isNotNull()).alias(f"{kind}_{sample}_unique_reads")]
            out.append(F.count_if((of("poly_tail_rescued_rows") > 0) & read.isNotNull()).alias(f"{kind}_{sample}_poly_tail_rescued_unique_reads"))
            for n, (f, _) in _measures(kind).items():
                value = F.sum(of(n)).cast("double") / rows if f == "mean" else {"sum": F.sum, "min": F.min, "max": F.max}[f](of(n))
                out.append(name(value, n))
    return per_read.groupBy(*KEY).agg(*out)


def enrichment(metrics: DataFrame, passing: dict[str, int], pseudo: float = 1.0) -> DataFrame:
    """Totals, counts per million of the passing reads, their ratio and difference."""
    for s in SAMPLES:
        metrics = metrics.withColumn(f"{s}_total_rows", F.col(f"split_{s}_rows") + F.col(f"discordant_{s}_rows"))
        cpm = F.col(f"{s}_total_rows") * 1e6 / passing[s] if passing.get(s, 0) > 0 else F.lit(0.0)
        metrics = metrics.withColumn(f"{s}_total_cpm", cpm)
    d, c = F.col("disease_total_cpm"), F.col("control_total_cpm")
    return metrics.withColumn("enrichment_ratio", (d + pseudo) / (c + pseudo)).withColumn("delta_cpm", d - c)


def track_flags(loci: DataFrame, discordant: DataFrame, tracks: dict[str, tuple[DataFrame, float]], trusted: DataFrame | None = None) -> DataFrame:
    """Flags of each locus: junk tracks that cover enough of it, or hold a mate of its reads.

    ``tracks`` maps a name of ``TRACKS`` to closed (chrom, start_pos, end_pos) and
    the least fraction of the locus that one feature must cover. A locus that
    does not touch ``trusted`` is outside it. All tracks meet the loci in one
    range join. A missing track flags nothing.
    """
    parts = [t.select("chrom", "start_pos", "end_pos", F.lit(n).alias("_track"), F.lit(float(f)).alias("_least")) for n, (t, f) in tracks.items()]
    if trusted is not None:
        parts.append(trusted.select("chrom", "start_pos", "end_pos", F.lit("trusted").alias("_track"), F.lit(0.0).alias("_least")))
    flags = {f"flag_{t}": t for t in TRACKS} | {"_trusted": "trusted"}
    mates = {"flag_mate_" + {"low_mappability": "low_mappability", "gap_region": "in_gap", "encode_blacklist": "in_blacklist", "segdup": "in_segdup"}[t]: t for t in TRACKS}
    if parts:
        features = parts[0]
        for p in parts[1:]:
            features = features.unionByName(p)
        mine = intervals.overlaps(loci.select(*KEY), features, "chrom", "window_start", "window_end", "start_pos", "end_pos")
        mine = mine.filter(F.col("overlap_bp") >= F.col("_least") * (F.col("window_end") - F.col("window_start") + 1))
        mine = mine.groupBy(*KEY).agg(*[F.max(F.col("_track") == t).alias(n) for n, t in flags.items()])
        ends = discordant.filter("mate_chrom <> '*' AND mate_pos > 0").select(F.col("chrom").alias("_chrom"), "window_start", "window_end", F.col("mate_chrom").alias("chrom"), "mate_pos").distinct()
        theirs = intervals.points_in_intervals(ends, features, "chrom", "mate_pos", "start_pos", "end_pos")
        theirs = theirs.groupBy(F.col("_chrom").alias("chrom"), "window_start", "window_end").agg(*[F.max(F.col("_track") == t).alias(n) for n, t in mates.items()])
        loci = loci.join(mine, KEY, "left").join(theirs, KEY, "left")
    else:
        loci = loci.withColumns({n: F.lit(False) for n in [*flags, *mates]})
    loci = loci.withColumns({n: F.coalesce(n, F.lit(False)) for n in [*flags, *mates]})
    loci = loci.withColumn("flag_outside_giab_highconf", ~F.col("_trusted") if trusted is not None else F.lit(False)).drop("_trusted")
    total = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0))
    own = [*[n for n in flags if n != "_trusted"], "flag_outside_giab_highconf"]
    return loci.withColumn("junk_flag_count", total(own)).withColumn("mate_junk_flag_count", total(mates))


def candidate_loci(split: DataFrame, discordant: DataFrame, passing: dict[str, int], split_gap: int = 30, discordant_gap: int = 400, max_span: int = 2000, tracks: dict | None = None, trusted: DataFrame | None = None, pseudo: float = 1.0) -> DataFrame:
    """The whole stage: loci with metrics of both samples, enrichment and flags.

    Loci that no row chooses disappear. ``split`` and ``discordant`` are the
    evidence tables of both samples.
    """
    split = split.withColumnsRenamed({"poly_tail_rescued": "rescued", "clip_poly_at_fraction": "poly_fraction", "clip_poly_at_run": "poly_run"})
    discordant = discordant.withColumnsRenamed({"poly_tail_anchor_rescued": "rescued", "anchor_poly_at_fraction": "poly_fraction", "anchor_poly_at_run": "poly_run"})
    loci = written(build_loci(split, discordant, split_gap, discordant_gap, max_span), "loci")
    assigned = {"split": assign(split, loci), "discordant": assign(discordant, loci)}
    if tracks or trusted is not None:
        assigned = {k: written(v, f"loci-{k}-rows") for k, v in assigned.items()}
    out = enrichment(locus_metrics(assigned), passing, pseudo)
    return track_flags(out, assigned["discordant"], tracks or {}, trusted)
