"""Breakpoints and target-site duplications of loci beyond the plain pair of split modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.operators import aggregates, support
from mobilome_spark.operators.loci import KEY, SAMPLES

#: A duplication below this length is not one, and may be rescued.
TSD_LEAST, TSD_MOST = 4, 40


def breakpoint_modes(split: DataFrame) -> DataFrame:
    """One row per locus: modes and supports of all split reads and of those with tails, per sample and side.

    ``split``: ``KEY``, sample, clip_side, read_name, pos, clip_poly_at_run,
    clip_poly_at_fraction and poly_tail_rescued.
    """
    tail = F.col("poly_tail_rescued") | (F.col("clip_poly_at_run") >= 8) | (F.col("clip_poly_at_fraction") >= 0.8)
    kinds = F.when(tail, F.array(F.lit("split"), F.lit("poly"))).otherwise(F.array(F.lit("split")))
    rows = split.select(*support.SIDE, "read_name", "pos", F.explode(kinds).alias("kind"))
    long = aggregates.breakpoint_mode(rows, [*support.SIDE, "kind"], "pos", "read_name")
    long = long.select(*support.SIDE, "kind", F.col("mode_pos").alias("breakpoint_mode"), F.col("mode_reads").alias("breakpoint_support"))
    return support.spread(long, ["sample", "clip_side", "kind"], "{sample}_{clip_side}_{kind}_{metric}", {"sample": list(SAMPLES), "clip_side": ["L", "R"], "kind": ["split", "poly"]})


def _best(found: list[tuple[Column, list[Column], Column, Column, str]]) -> Column:
    """(left, right, length, source) of the first candidate by its order, or null."""
    options = F.array(*[F.when(ok, F.struct(*[o.cast("bigint").alias(f"o{i}") for i, o in enumerate(order)], l.cast("bigint").alias("left"), r.cast("bigint").alias("right"), F.lit(source).alias("source"))) for ok, order, l, r, source in found])
    best = F.array_min(F.array_compact(options))
    return F.when(best.isNotNull(), F.struct(best["left"].alias("left"), best["right"].alias("right"), (best["right"] - best["left"] + 1).alias("length"), best["source"].alias("source")))


def gap_rescue() -> Column:
    """The pair of split modes of a sample, two reads a side and six in all, for loci with any element read.

    Disease first, then more reads, more of them with tails, and the longer one.
    """
    c, found = lambda *p: F.col("_".join(p)), []
    any_mei = F.greatest(*[c(s, m) for s in SAMPLES for m in ("mei_supported_reads", "full_mei_supported_reads")]) >= 1
    for turn, s in enumerate(SAMPLES):
        l, r = c(s, "L_split_breakpoint_mode"), c(s, "R_split_breakpoint_mode")
        nl, nr = c(s, "L_split_breakpoint_support"), c(s, "R_split_breakpoint_support")
        ok = any_mei & (l > 0) & (r > 0) & (F.least(nl, nr) >= 2) & (nl + nr >= 6) & (r - l + 1).between(TSD_LEAST, TSD_MOST)
        tails = c(s, "L_poly_breakpoint_support") + c(s, "R_poly_breakpoint_support")
        found.append((ok, [F.lit(turn), -(nl + nr), -tails, l - r], l, r, f"tsd_{s}_split_clip_gap_rescue"))
    return _best(found)


def tail_bridge() -> Column:
    """An element breakpoint on one side and a tail's on the other, where the other has at most one element read."""
    c, found = lambda *p: F.col("_".join(p)), []
    for turn, s in enumerate(SAMPLES):
        tails = (F.greatest(c(s, "L_poly_at_reads"), c(s, "R_poly_at_reads"), c("split", s, "poly_tail_rescued_unique_reads"), c("discordant", s, "poly_tail_rescued_unique_reads")) >= 1) | (c(s, "poly_at_max_run") >= 8)
        for k, o in (("L", "R"), ("R", "L")):
            mine, theirs = c(s, k, "mei_breakpoint_mode"), c(s, o, "poly_breakpoint_mode")
            l, r = (mine, theirs) if k == "L" else (theirs, mine)
            reads = c(s, k, "mei_supported_reads")
            ok = tails & (l > 0) & (r > 0) & (reads >= 1) & (c(s, o, "mei_supported_reads") <= 1) & (c(s, o, "poly_breakpoint_support") >= 1) & (r - l + 1).between(TSD_LEAST, TSD_MOST)
            found.append((ok, [F.lit(turn), -(reads + c(s, o, "poly_breakpoint_support")), l - r, l, r], l, r, f"tsd_{s}_{k}_poly_mode_bridge_rescue"))
    return _best(found)


def rescue_tsd(df: DataFrame, candidates: list[Column] | None = None) -> DataFrame:
    """``tsd_*`` columns with each candidate in turn (the gap rescue, then the tail bridge) where no duplication of four bases is known."""
    for candidate in candidates or (gap_rescue(), tail_bridge()):
        df = df.withColumn("_r", F.when(F.col("tsd_len_estimate") < TSD_LEAST, candidate))
        names = {"tsd_left_breakpoint": "left", "tsd_right_breakpoint": "right", "tsd_len_estimate": "length", "tsd_evidence_source": "source"}
        df = df.withColumns({n: F.coalesce(F.col(f"_r.{f}"), F.col(n)) for n, f in names.items()}).drop("_r")
    return df.withColumn("tsd_detected", F.col("tsd_len_estimate") >= TSD_LEAST)


def breakpoint_choice() -> Column:
    """(pos, source): the duplication's middle, else that of the disease's or control's modes, else one mode of the control."""
    c = F.col
    middle = lambda l, r: F.floor((l + r) / 2).cast("bigint")
    tsd = F.when(F.coalesce(F.trim(c("tsd_evidence_source")), F.lit("")) != "", F.trim(c("tsd_evidence_source"))).otherwise("tsd_unknown")
    steps, pick = [(c("tsd_left_breakpoint"), c("tsd_right_breakpoint"), tsd)], lambda p, s: F.struct(p.cast("bigint").alias("pos"), s.alias("source"))
    steps += [(c(f"{s}_L_mei_breakpoint_mode"), c(f"{s}_R_mei_breakpoint_mode"), F.lit(f"{s}_split")) for s in SAMPLES]
    l, r = steps[-1][:2]
    single = F.when(l > 0, l).otherwise(r)
    return F.coalesce(*[F.when((a > 0) & (b > 0), pick(middle(a, b), s)) for a, b, s in steps], F.when(single > 0, pick(single, F.lit("control_single"))), pick(F.lit(0), F.lit("")))


def tail_like_tsd(tsd_seq: Column, source: Column) -> Column:
    """A rescued duplication that is only A and T: all of four bases, or 90 % one base of eight with a run of six."""
    s = F.upper(F.coalesce(tsd_seq, F.lit("")))
    n = F.length(s)
    share = F.greatest(*[n - F.length(F.regexp_replace(s, b, "")) for b in "AT"]) / F.nullif(n, F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("([AT]+)"), F.lit(1)), F.length)), F.lit(0))
    return F.contains(source, F.lit("_rescue")) & (((n >= TSD_LEAST) & ~s.rlike("[^AT]")) | ((n >= 8) & (F.coalesce(share, F.lit(0.0)) >= 0.9) & (longest >= 6)))


def drop_tail_like(df: DataFrame) -> DataFrame:
    """Duplications that are only a tail are taken back; their source says so."""
    df = df.withColumn("tsd_poly_at_filter_applied", tail_like_tsd(F.col("tsd_seq"), F.col("tsd_evidence_source")))
    gone = F.col("tsd_poly_at_filter_applied")
    cleared = {c: F.when(gone, F.lit(v)).otherwise(F.col(c)) for c, v in (("tsd_left_breakpoint", 0), ("tsd_right_breakpoint", 0), ("tsd_len_estimate", 0), ("tsd_seq", ""))}
    return df.withColumns(cleared | {"tsd_detected": F.col("tsd_detected") & ~gone, "tsd_evidence_source": F.when(gone, F.concat("tsd_evidence_source", F.lit("_filtered_poly_at_only"))).otherwise(F.col("tsd_evidence_source"))})


def catalog_interval(split_pad: int = 200, pair_least: int = 200, pair_most: int = 200, factor: float = 0.0) -> list[Column]:
    """(query_start, query_end) in which a locus looks for a known insertion: narrow where
    split reads place it, by the insert size where pairs do, wide otherwise."""
    c = F.col
    middle = F.floor((c("window_start") + c("window_end")) / 2).cast("bigint")
    at = F.when(c("insertion_breakpoint_pos") > 0, c("insertion_breakpoint_pos")).otherwise(middle)
    placed = (c("disease_split_mei_supported_reads") >= 2) | ((c("disease_L_mei_supported_reads") >= 1) & (c("disease_R_mei_supported_reads") >= 1))
    paired = c("disease_discordant_mei_supported_reads") + c("control_discordant_mei_supported_reads") > 0
    size = F.greatest("discordant_disease_abs_tlen_mean", "discordant_control_abs_tlen_mean")
    pair_pad = F.greatest(F.lit(1), F.least(F.lit(pair_most), F.greatest(F.lit(pair_least), F.rint(size * factor).cast("bigint"))))
    pad = F.when(placed, max(1, split_pad)).when(paired, pair_pad).otherwise(max(1, 2 * split_pad))
    centre = F.when(placed | paired, at).otherwise(middle)
    start = F.greatest(F.lit(1), centre - pad)
    return [start.cast("bigint").alias("query_start"), F.greatest(start, centre + pad).cast("bigint").alias("query_end")]


#: Bases of the reference on each side of a place that ``near`` takes; blocks overlap by at least twice as much.
REACH = 100


def near(df: DataFrame, blocks: DataFrame, size: int = 10_000, at: str = "insertion_breakpoint_pos") -> DataFrame:
    """``df`` with the reference around a place: ``region`` and ``region_start0``, '' where unknown.

    ``blocks``: chrom, block_id, block_start0, seq with starts at multiples of
    ``size``. An equi-join on (chrom, block); no task holds a contig.
    """
    start = F.greatest(F.lit(0), F.col(at) - REACH).cast("bigint")
    df = df.withColumn("region_start0", F.when(F.col(at) > 0, start)).withColumn("block_id", F.floor(F.col("region_start0") / size).cast("int"))
    joined = df.join(blocks.select("chrom", F.col("block_id").cast("int"), "block_start0", F.col("seq").alias("_seq")), ["chrom", "block_id"], "left")
    text = F.substring("_seq", (F.col("region_start0") - F.col("block_start0") + 1).cast("int"), F.lit(2 * REACH))
    return joined.withColumn("region", F.upper(F.coalesce(text, F.lit("")))).drop("block_id", "block_start0", "_seq")


def bases(start0: Column, end0: Column) -> Column:
    """Reference bases [start0, end0) out of ``region``; '' unless all of them are there."""
    text = F.substring("region", (start0 - F.col("region_start0") + 1).cast("int"), (end0 - start0).cast("int"))
    whole = (start0 >= F.col("region_start0")) & (F.length(text) == end0 - start0)
    return F.when(F.coalesce(whole, F.lit(False)), text).otherwise("")


def reference_rescue(most: int = 12) -> Column:
    """The pair of element modes moved by up to ``most`` bases an end whose bases the reference knows.

    The least movement, then disease, the middle nearest to the first pair's, more
    reads, the longer and the smaller one.
    """
    c = F.col
    samples = F.array(*[F.struct(F.lit(turn).alias("turn"), c(f"{s}_L_mei_breakpoint_mode").cast("bigint").alias("l"), c(f"{s}_R_mei_breakpoint_mode").cast("bigint").alias("r"), (c(f"{s}_L_mei_supported_reads") + c(f"{s}_R_mei_supported_reads")).cast("bigint").alias("n"), F.lit(f"tsd_{s}_seq_rescue").alias("source")) for turn, s in enumerate(SAMPLES)])
    known = F.filter(samples, lambda s: (s["l"] > 0) & (s["r"] > 0))
    middle = lambda l, r: F.floor((l + r) / 2).cast("bigint")
    seed = F.get(F.transform(known, lambda s: middle(s["l"], s["r"])), F.lit(0))
    moves = F.sequence(F.lit(-most), F.lit(most))

    def moved(s, dl, dr):
        l, r = s["l"] + dl, s["r"] + dr
        return F.struct((F.abs(dl) + F.abs(dr)).alias("moved"), s["turn"].alias("turn"), F.abs(middle(l, r) - seed).alias("away"), (-s["n"]).alias("n"), (l - r).alias("span"), l.alias("left"), r.alias("right"), s["source"].alias("source"))

    tried = F.flatten(F.transform(known, lambda s: F.flatten(F.transform(moves, lambda dl: F.transform(moves, lambda dr: moved(s, dl, dr))))))
    fits = lambda x: (x["left"] > 0) & (x["right"] - x["left"] + 1).between(TSD_LEAST, TSD_MOST)
    read = lambda x: bases(x["left"] - 1, x["right"])
    best = F.array_min(F.filter(tried, lambda x: fits(x) & (read(x) != "") & ~F.contains(read(x), F.lit("N"))))
    return F.when(best.isNotNull(), F.struct(best["left"].alias("left"), best["right"].alias("right"), (best["right"] - best["left"] + 1).alias("length"), best["source"].alias("source")))


def sequence_metrics(df: DataFrame) -> DataFrame:
    """Duplicated bases, the 11 bases at the breakpoint as the insertion reads them, and how they match its enzyme's motifs.

    The shifted log-odds pays log2(3) for its three tries.
    """
    c = F.col
    df = df.withColumn("tsd_seq", F.when(c("tsd_len_estimate") > 0, bases(c("tsd_left_breakpoint") - 1, c("tsd_right_breakpoint"))).otherwise(""))
    plain = bases(c("insertion_breakpoint_pos") - 6, c("insertion_breakpoint_pos") + 5)
    df = df.withColumn("breakpoint_context", F.when(c("insertion_orientation") == "-", seq.revcomp(plain)).otherwise(plain))
    df = df.withColumns({"_m": seq.endonuclease_motif(c("breakpoint_context")), "_o": seq.shifted_logodds(c("breakpoint_context"))})
    adjusted = F.when(F.length("breakpoint_context") >= 8, c("_o.best") - F.log2(F.lit(3.0))).otherwise(0.0)
    return df.withColumns({"breakpoint_l1_en_motif_like": F.coalesce(c("_m.like"), F.lit(False)), "breakpoint_l1_en_motif": F.coalesce(c("_m.motif"), F.lit("")), "breakpoint_yyrrrr_logodds": c("_o.strict"), "breakpoint_yyrrrr_logodds_shift1_mt_adj": adjusted}).drop("_m", "_o")
