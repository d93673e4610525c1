"""Refinement of annotated loci: alignment contracts, clip-exact duplications, assembly overrides and report fields.

A locus is (chrom, window_start, window_end). Missing numbers count as 0 and
missing texts as '' unless said otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.functions.names import canonical_read_name
from mobilome_spark.operators.loci import KEY, SAMPLES

# Reasons of pairs whose reads are aligned to elements, and the least length of such reads.
ALIGNED_REASONS, ALIGNED_LENGTH = ("interchrom", "mate_unmapped", "large_insert"), 30
# Lengths of duplications sought with clips, mismatches allowed, clips that must agree.
MIN_TSD, MAX_TSD, MISMATCHES, AGREEING = 4, 30, 1, 2
#: Bases of windows that a task compares at once.
PLACES = 1 << 20
HIT = ("target", "target_len", "target_start", "target_end", "strand", "alnlen", "mapq", "pid", "qcov", "score")


# ------------------------------------------------------------------ alignment contract


def eligible_pairs(rows: DataFrame) -> DataFrame:
    """Discordant rows whose read is long enough and whose reasons point to an element elsewhere."""
    why = F.coalesce("discordant_reasons", F.lit(""))
    return rows.filter((F.length(F.coalesce("read_seq", F.lit(""))) >= ALIGNED_LENGTH) & reduce(or_, [why.contains(r) for r in ALIGNED_REASONS]))


def with_query_id(rows: DataFrame, sequence: str, prefix: str) -> DataFrame:
    """``rows`` with ``query_id``, the name under which their sequence goes to an aligner.

    It follows from the sequence, so equal sequences are aligned once and reruns agree."""
    return rows.withColumn("query_id", F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.coalesce(sequence, F.lit("")), 256), F.lit(24))))


def alignment_queries(rows: DataFrame, sequence: str, least: int = 1) -> DataFrame:
    """(name, seq) of the distinct sequences of ``rows`` (see ``with_query_id``) for an aligner."""
    return rows.filter(F.length(sequence) >= least).groupBy(F.col("query_id").alias("name")).agg(F.first(sequence).alias("seq"))


def attach_hits(rows: DataFrame, hits: DataFrame, suffix: str = "") -> DataFrame:
    """Every row of ``rows``, with the columns of the best hit of its ``query_id`` or nulls.

    ``hits``: at most one row per ``qname`` (see ``sources.text.best_hits``)."""
    own = [c for c in hits.columns if c != "qname"]
    found = hits.select(F.col("qname").alias("query_id"), *[F.col(c).alias(f"{c}{suffix}") for c in own])
    return rows.join(found, "query_id", "left")


# -------------------------------------------------------------------- clip-exact duplications


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters in a row, where each text begins, and its length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


def longest_fits(windows: list[str], centres: np.ndarray, clips: list[str], lefts: np.ndarray, caps: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, rank) of each row: the longest end of the clip, of ``least`` to ``cap``
    bases without N, that fits into the window with at most ``most`` mismatches; 0 if none does.

    The end is the clip's last bases where ``left``, else its first. ``rank`` holds the mismatches
    above 40 bits for the distance from ``centre`` of the place that fits best, nearest among equals.
    All places grow by a base at a time; those with too many mismatches go, as no longer end fits there."""
    turned = [(w[::-1], c[::-1]) if left else (w, c) for w, c, left in zip(windows, clips, lefts.tolist(), strict=True)]
    chars, at, sizes = _characters([w for w, _ in turned])
    bases, first, _ = _characters([c for _, c in turned])
    caps = np.minimum(caps, np.array([c.find("N") if "N" in c else len(c) for _, c in turned], np.int64))
    length, rank = np.zeros(len(turned), np.int64), np.zeros(len(turned), np.int64)
    row = np.repeat(np.arange(len(turned)), sizes)
    place, bad = np.arange(len(row)) - at[row], np.zeros(len(row), np.int64)
    for n in range(1, caps.max(initial=0) + 1):
        keep = (caps[row] >= n) & (place + n <= sizes[row])
        row, place, bad = row[keep], place[keep], bad[keep]
        bad += chars[at[row] + place + n - 1] != bases[first[row] + n - 1]
        keep = bad <= most
        row, place, bad = row[keep], place[keep], bad[keep]
        if not len(row):
            break
        if n >= least:
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            begin = np.where(lefts[row], sizes[row] - n - place, place)
            length[row[starts]] = n
            rank[row[starts]] = np.minimum.reduceat((bad << 40) + np.abs(begin - centres[row]), starts)
    return length, rank


def _distinct(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination, and the number of each row's combination."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        held = c.dictionary_encode("encode")
        code = np.unique(code * (len(held.dictionary) + 1) + held.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def _fitted(batch: pa.RecordBatch, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``longest_fits`` of the better of a row's two variants; equal rows are sought once."""
    window, centre, left, cap = (batch.column(c) for c in ("window_seq", "_centre", "_left", "_cap"))
    length, rank = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
    for variant in (batch.column("_given"), batch.column("_turned")):
        if variant.null_count == len(batch):
            continue
        columns = [window, centre, left, cap, variant]
        first, code = _distinct(columns)
        w, c, is_left, most_n, v = (x.take(pa.array(first)).to_pylist() for x in columns)
        sought = [i for i in range(len(first)) if w[i] is not None and v[i] is not None]
        n, r = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        while sought:  # windows of about a million bases at once
            few = 1 + int(np.searchsorted(np.cumsum([len(w[i]) for i in sought[1:]]), PLACES))
            part, sought = sought[:few], sought[few:]
            n[part], r[part] = longest_fits([w[i] for i in part], np.array([c[i] or 0 for i in part]), [v[i] for i in part], np.array([is_left[i] for i in part]), np.array([most_n[i] for i in part]), least, most)
        n, r = n[code], r[code]
        better = (n > length) | ((n == length) & (r < rank))
        length, rank = np.where(better, n, length), np.where(better, r, rank)
    return length, rank


def clip_exact_tsd(loci: DataFrame, clips: DataFrame, least: int = MIN_TSD, longest: int = MAX_TSD, most: int = MISMATCHES, agreeing: int = AGREEING) -> DataFrame:
    """(KEY, left, right, length, source): the duplication that the clips of a locus spell out.

    ``loci``, a row each: KEY, ``window_seq``, the reference around the breakpoint, and
    ``centre``, its place in it. ``clips``: KEY, ``sample``, ``clip_side``, ``bp``, ``orientation``
    and ``clip_seq``, the bases next to the breakpoint. Each clip votes for the longest
    of its ends (of both strands where the orientation is unknown) that the reference
    holds near by; at least ``agreeing`` clips must agree. The longest duplication
    wins, then votes, mismatches, distance, disease before control.
    """
    is_left, plus, minus = (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("clip_side", "L"), ("orientation", "+"), ("orientation", "-")))
    # a duplication begins at 1 at least, so those of a right side are no longer than its breakpoint
    rows = clips.filter("bp >= 1").select(
        *KEY, "sample", "clip_side", "bp", is_left.alias("_left"), F.when(is_left, F.lit(longest)).otherwise(F.least(F.lit(longest), F.col("bp"))).cast("bigint").alias("_cap"),
        F.when(minus, None).otherwise(F.col("clip_seq")).alias("_given"), F.when(plus, None).otherwise(seq.revcomp(F.col("clip_seq"))).alias("_turned"),
    )
    end = lambda c: F.when(F.col("_left"), F.right(c, F.lit(longest))).otherwise(F.left(c, F.lit(longest))).alias(c)
    rows = rows.filter("_cap > 0").withColumns({c: end(c) for c in ("_given", "_turned")})
    rows = rows.join(loci.select(*KEY, "window_seq", F.col("centre").cast("bigint").alias("_centre")).distinct(), KEY)
    kept = [*KEY, "sample", "clip_side", "bp"]
    numbers = ["_n", "mismatches", "distance"]

    def vote(batches):
        for batch in batches:
            length, rank = _fitted(batch, max(least, 1), most)
            found = pa.array(np.flatnonzero(length))
            ranks = pa.array(rank & ((1 << 40) - 1), mask=batch.column("_centre").is_null().to_numpy(zero_copy_only=False))
            out = pa.record_batch([*[batch.column(c) for c in kept], pa.array(length), pa.array(rank >> 40), ranks], [*kept, *numbers])
            yield out.take(found)

    votes = rows.mapInArrow(vote, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {c} bigint" for c in numbers))
    votes = votes.withColumn("_turn", F.when(F.col("sample") == "disease", 0).otherwise(1)).withColumn("_side", F.when(F.col("clip_side") == "L", 0).otherwise(1))
    left = F.when(F.col("clip_side") == "L", F.col("bp")).otherwise(F.col("bp") - F.col("_n") + 1).cast("bigint")
    right = F.when(F.col("clip_side") == "L", F.col("bp") + F.col("_n") - 1).otherwise(F.col("bp")).cast("bigint")
    source = F.concat(F.lit("tsd_"), "sample", F.lit("_"), "clip_side", F.when(F.col("mismatches") == 0, "_clip_exact_rescue").otherwise("_clip_near_exact_rescue"))
    votes = votes.select(*KEY, "_turn", "_side", *numbers, left.alias("left"), right.alias("right"), source.alias("source"))
    counted = votes.groupBy(*KEY, "left", "right", "source", "_n", "_turn", "_side").agg(F.count(F.lit(1)).alias("_votes"), F.min(F.struct("mismatches", "distance")).alias("_m"))
    rank = F.struct((-F.col("_n")).alias("n"), (-F.col("_votes")).alias("votes"), F.col("_m.mismatches").alias("mismatches"), F.col("_m.distance").alias("distance"), F.col("_turn").alias("turn"), F.col("_side").alias("side"), "left")
    best = counted.filter(F.col("_votes") >= agreeing).groupBy(*KEY).agg(F.min_by(F.struct("left", "right", F.col("_n").alias("length"), "source"), rank).alias("_b"))
    return best.select(*KEY, "_b.left", "_b.right", F.col("_b.length").cast("bigint").alias("length"), "_b.source")


# ------------------------------------------------------------------------ derived fields


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def broaden_tails(df: DataFrame) -> DataFrame:
    """Poly-A/T runs and reads of a sample taken over elements, rescued clips and rescued pairs."""
    for s in SAMPLES:
        run = F.greatest(_n(f"{s}_poly_at_max_run"), _n(f"split_{s}_poly_tail_at_run_max"), _n(f"discordant_{s}_poly_tail_at_run_max"))
        reads = F.greatest(_n(f"{s}_poly_at_reads"), _n(f"split_{s}_poly_tail_rescued_unique_reads")) + _n(f"discordant_{s}_poly_tail_rescued_unique_reads")
        df = df.withColumns({f"{s}_poly_at_max_run": run.cast("bigint"), f"{s}_poly_at_reads": reads.cast("bigint")})
    both = [F.col(f"{s}_poly_at_max_run") for s in SAMPLES]
    return df.withColumns({"poly_at_max_run": F.greatest(*both), "poly_at_reads": F.col("disease_poly_at_reads") + F.col("control_poly_at_reads")})


def local_support(df: DataFrame) -> DataFrame:
    """Element reads as shares of a sample's rows at the locus, their difference and smoothed ratio."""
    share = {s: _n(f"{s}_mei_supported_reads") / F.when(_n(f"{s}_total_rows") == 0, 1).otherwise(_n(f"{s}_total_rows")) for s in SAMPLES}
    out = {f"{s}_local_informative_rows": _n(f"{s}_total_rows").cast("bigint") for s in SAMPLES} | {f"{s}_mei_support_local_frac": share[s] for s in SAMPLES}
    out |= {f"{s}_mei_support_per_100_local_rows": share[s] * 100.0 for s in SAMPLES}
    d, c = share["disease"], share["control"]
    return df.withColumns(out | {"mei_local_support_frac_delta": d - c, "mei_local_support_frac_ratio": (d + 1e-4) / (c + 1e-4)})


def consistent_family() -> Column:
    """Whether the sides of both samples that name a family, at least one, name the same one."""
    named = F.array(*[F.trim(F.coalesce(F.col(f"{s}_{k}_mei_family"), F.lit(""))) for s in SAMPLES for k in "LR"])
    return F.size(F.array_distinct(F.filter(named, lambda x: x != ""))) == 1


def motif_report(df: DataFrame) -> DataFrame:
    """Observed motif, class of retrotransposition and sequence signature.

    Observed motifs always show; what is derived from them only where the adjusted
    log-odds of the motif are above zero, the others get ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    odds = F.col("breakpoint_yyrrrr_logodds_shift1_mt_adj")
    shown = F.coalesce(~F.isnan(odds) & (odds > 0), F.lit(False))
    df = df.withColumns({"breakpoint_l1_en_observed_motif": text("breakpoint_l1_en_hexamer_oriented"), "breakpoint_l1_en_observed_motif_pattern": text("breakpoint_l1_en_pattern_yy_rrrr")})
    df = df.withColumns({c: F.when(shown, F.col(c)).otherwise("") for c in ("breakpoint_l1_en_best_motif", "breakpoint_l1_en_motif_type")})
    other = F.coalesce(F.col("breakpoint_l1_en_motif_like"), F.lit(False)) & F.trim(text("breakpoint_l1_en_motif_type")).isin("l1_en_alternative", "nested_novel_like")
    retro = F.when(~shown, "").when(other, "non_classical").otherwise("classical")
    order = ("observed_motif_pattern", "observed_motif", "pattern_yy_rrrr", "best_match_pattern_yy_rrrr", "best_motif")
    signs = F.array(*[F.trim(text(f"breakpoint_l1_en_{c}")) for c in order])
    signature = F.when(retro == "", "").otherwise(F.coalesce(F.get(F.filter(signs, lambda x: x != ""), F.lit(0)), F.lit("")))
    return df.withColumns({"consensus_retrotransposition_class": retro, "consensus_sequence_signature": signature})


# ------------------------------------------------------------------------------ assembly


def assembly_overrides(loci: DataFrame, assembled: DataFrame) -> DataFrame:
    """``loci`` with the values of their assembly, where it found the element in a sample.

    ``assembled``: at most one row per KEY with the ``asm_`` columns. Duplications
    count from four bases; the longest poly-A/T run of both wins; coordinates on the
    element go to the sample that was assembled. A locus without a row keeps its own.
    """
    df, c = loci.join(assembled, KEY, "left"), F.col
    source = F.coalesce("asm_breakpoint_source", F.lit(""))
    found = source.isin(*SAMPLES)

    def taken(new: Column, old: str, when: Column = found) -> Column:
        return F.coalesce(F.when(when & new.isNotNull(), new), c(old), F.lit(0)).cast("bigint")

    tsd = found & F.coalesce(c("asm_tsd_len") >= 4, F.lit(False))
    sequence, length = F.coalesce("asm_tsd_seq", F.lit("")), taken(c("asm_tsd_len"), "tsd_len_estimate", tsd)
    run = F.greatest(F.coalesce(F.when(found, c("asm_polyA_max_run")), c("poly_at_max_run")), c("poly_at_max_run"))
    out = {
        "insertion_breakpoint_pos": taken(c("asm_consensus_breakpoint_pos"), "insertion_breakpoint_pos"), "breakpoint_evidence_source": F.when(found, source).otherwise(c("breakpoint_evidence_source")),
        "tsd_seq": F.when(tsd & (sequence != ""), sequence).otherwise(F.coalesce("tsd_seq", F.lit(""))), "tsd_len_estimate": length, "tsd_detected": length >= 4,
        "poly_at_max_run": F.coalesce(run, F.lit(0)).cast("bigint"), "insertion_mei_span": taken(c("asm_insertion_length"), "insertion_mei_span"),
        "insertion_orientation": F.when(found & c("asm_insertion_orientation").isin("+", "-"), c("asm_insertion_orientation")).otherwise(F.coalesce("insertion_orientation", F.lit(""))),
    }
    for s in SAMPLES:
        for end in ("start", "end"):
            new = c(f"asm_insertion_mei_{end}")
            out[f"{s}_insertion_mei_{end}"] = taken(new, f"{s}_insertion_mei_{end}", (source == s) & (new > 0))
    return df.withColumns(out)


def recruited_reads(assembled: DataFrame) -> DataFrame:
    """(KEY, sample, read_name): distinct reads that an assembly with a contig of the element drew on."""
    rows = None
    for s in SAMPLES:
        own = assembled.filter(F.length(F.coalesce(f"asm_{s}_primary_contig_id", F.lit(""))) > 0)
        own = own.select(*KEY, F.lit(s).alias("sample"), F.explode(F.split(F.coalesce(f"asm_{s}_recruited_evidence_read_names", F.lit("")), ",")).alias("read_name"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("read_name", F.trim("read_name")).filter("read_name <> ''").distinct()


def post_assembly_counts(loci: DataFrame, assembled: DataFrame, split: DataFrame) -> DataFrame:
    """(KEY, {sample}_sr_l_post_asm, {sample}_sr_r_post_asm): distinct clipped reads left and right
    of the breakpoint (the middle of the window where it is unknown) among those recruited.

    A clip without a side lies left if its position is not beyond the breakpoint."""
    at = F.when(F.coalesce("insertion_breakpoint_pos", F.lit(0)) > 0, F.col("insertion_breakpoint_pos")).otherwise(F.floor((F.col("window_start") + F.col("window_end")) / 2))
    places = loci.select(*KEY, at.cast("bigint").alias("_at"))
    rows = split.filter(F.coalesce("read_name", F.lit("")) != "").join(recruited_reads(assembled), [*KEY, "sample", "read_name"], "left_semi").join(places, KEY)
    side = F.substring(F.upper(F.coalesce("clip_side", F.lit(""))), 1, 1)
    side = F.when(side.isin("L", "R"), side).otherwise(F.when(F.coalesce("pos", "_at") <= F.col("_at"), "L").otherwise("R"))
    count = lambda s, k: F.count_distinct(F.when((F.col("sample") == s) & (F.col("_side") == k), F.col("read_name")))
    counts = rows.withColumn("_side", side).groupBy(*KEY).agg(*[count(s, k).alias(f"{s}_sr_{k.lower()}_post_asm") for s in SAMPLES for k in "LR"])
    names = [f"{s}_sr_{k}_post_asm" for s in SAMPLES for k in "lr"]
    return loci.select(*KEY).join(counts, KEY, "left").select(*KEY, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def locus_read_names(rows: DataFrame) -> DataFrame:
    """(KEY, read_names, n_reads): the set of read names, in order, of each locus; blank ones don't count."""
    named = rows.select(*KEY, F.trim(F.col("read_name").cast("string")).alias("_r")).filter("_r <> ''").distinct()
    return named.groupBy(*KEY).agg(F.sort_array(F.collect_list("_r")).alias("read_names"), F.count(F.lit(1)).alias("n_reads"))


def median_span(loci: DataFrame, least: int = 50, default: int = 200) -> DataFrame:
    """(span,): the truncated median of window lengths of at least ``least``; ``default`` without loci."""
    length = F.greatest(F.col("window_end") - F.col("window_start") + 1, F.lit(least))
    return loci.agg(F.coalesce(F.floor(F.median(length)), F.lit(default)).cast("bigint").alias("span"))


def settings_key(**settings) -> str:
    """24 hexadecimal digits that stand for a run's settings, whatever their order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:24]


# ----------------------------------------------------------------------------- scans


def in_regions(rows: DataFrame, regions: list[str], chrom: str = "chrom", start: str = "pos", end: str = "ref_end") -> DataFrame:
    """Rows that overlap one of the regions ``contig`` or ``contig:from-to`` (1-based, closed).

    One predicate over all regions, so it reaches the scan, and a row that overlaps
    several comes once. No or only blank regions raise ValueError."""
    wanted = [r.strip() for r in regions if r and r.strip()]
    if not wanted:
        raise ValueError("no regions are given")

    def inside(region: str) -> Column:
        name, _, span = region.rpartition(":") if ":" in region and region.rpartition(":")[2].replace(",", "").replace("-", "").isdigit() else (region, "", "")
        if not span:
            return F.col(chrom) == name
        first, _, last = span.replace(",", "").partition("-")
        found = (F.col(chrom) == name) & (F.col(end) >= int(first))
        return found & (F.col(start) <= int(last)) if last else found

    return rows.filter(reduce(or_, [inside(r) for r in wanted]))


def preferred_rows(rows: DataFrame, preferred: DataFrame, name: str = "read_name") -> DataFrame:
    """Rows whose canonical read name is one of ``preferred`` (read_name), by a semi join."""
    names = preferred.select(canonical_read_name(F.col("read_name")).alias("_c")).filter("_c <> ''").distinct()
    return rows.join(names, canonical_read_name(F.col(name)) == F.col("_c"), "left_semi")


def long_read_catalog(variants: DataFrame) -> DataFrame:
    """(chrom, start0, end0, id, event_type, subfamily, family, ins_len, tsd_len, polya_len, conformation, not_canonical)
    of the insertions of known families in a long-read call set (see ``sources.text.vcf``).

    The id must name an insertion. Lengths are absolute, so a missing one (-1) becomes 1."""
    from mobilome_spark.operators.rules import mei_family

    get = lambda k: F.trim(F.split_part(F.coalesce(F.try_element_at("info", F.lit(k)), F.lit("")), F.lit(","), F.lit(1)))
    family, name, size = mei_family(get("FAM_N"), ("ALU", "SVA", "LINE1", "ERV"), ""), F.upper(F.coalesce("id", F.lit(""))), lambda k: F.abs(F.coalesce(get(k).try_cast("bigint"), F.lit(-1)))
    kept = variants.filter((F.coalesce("chrom", F.lit("")) != "") & family.isin("ALU", "SVA", "LINE1") & (name.contains("-INS") | name.contains(":INS") | name.endswith("INS")))
    last = F.greatest(F.col("pos"), F.coalesce(get("END").try_cast("bigint"), F.col("pos") + F.greatest(F.lit(1), F.length(F.coalesce("ref", F.lit("")))) - 1))
    start = F.greatest(F.lit(0), F.col("pos") - 1)
    return kept.select(
        "chrom", start.cast("bigint").alias("start0"), F.greatest(start + 1, last).cast("bigint").alias("end0"), F.when(F.col("id").isin("", "."), F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit("SVAN_MEI"))).otherwise(F.col("id")).alias("id"),
        F.when(get("ITYPE_N") == "", "INS").otherwise(get("ITYPE_N")).alias("event_type"), get("FAM_N").alias("subfamily"), family.alias("family"), size("INS_LEN").alias("ins_len"), size("TSD_LEN").alias("tsd_len"), size("POLYA_LEN").alias("polya_len"),
        get("CONFORMATION").alias("conformation"), F.try_element_at("info", F.lit("NOT_CANONICAL")).isNotNull().cast("int").alias("not_canonical"),
    )
