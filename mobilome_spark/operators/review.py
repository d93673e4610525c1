"""The table that people read: consensus fields of each locus, ranked, and text for a genome browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome_spark.operators.loci import KEY, SAMPLES

#: Spans on the element below this are not told; unknown coordinates are -1.
LEAST_SPAN = 20
SIDES = {"L": "left", "R": "right"}


def element_coordinates() -> Column:
    """(three, five): the higher and lower end of the insertion on the element, -1 where unknown.

    In turn: the pair of the assembly, the disease, the control; where a breakpoint is
    resolved the medians of pairs, then a split side with the opposite pairs; an end
    completed by the length of the element; the outermost mapped positions; with a
    tail, the lowest mapped position and the element's end, or the highest alone.
    """
    c = lambda *p: F.coalesce(F.col("_".join(p)), F.lit(0)).cast("bigint")
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("three"), F.least(a, b).alias("five"))
    both = lambda a, b: F.when((a > 0) & (b > 0), pair(a, b))
    known = [both(c(s, "insertion_mei_start"), c(s, "insertion_mei_end")) for s in ("asm", *SAMPLES)]
    resolved = F.col("insertion_breakpoint_pos") > 0
    medians = {s: [c(s, "discordant_mei", k, "target_pos_median") for k in SIDES.values()] for s in SAMPLES}
    ok = {s: F.col(f"{s}_discordant_mei_geometry_consistent") & (m[0] > 0) & (m[1] > 0) for s, m in medians.items()}
    control = ok["control"] & (~ok["disease"] | (c("control_discordant_mei_supported_reads") > c("disease_discordant_mei_supported_reads")))
    pairs = [F.when(resolved & control, pair(*medians["control"])), *[F.when(resolved & ok[s], pair(*medians[s])) for s in SAMPLES]]
    mixed = []
    for s in SAMPLES:
        firm = resolved & (F.col(f"{s}_discordant_mei_family_purity") >= 0.6) & F.col(f"{s}_discordant_mei_geometry_consistent") & F.col(f"{s}_discordant_mei_self_consistent")
        for k, o in (("L", 1), ("R", 0)):
            start, end, other = c(s, k, "mei_start"), c(s, k, "mei_end"), medians[s][o]
            mixed.append(F.when(firm & (start > 0) & (end > 0) & (other > 0), pair(F.greatest(end, other), F.least(start, other))))
    hint = F.greatest(*[c(s, k, "mei_target_len") for s in SAMPLES for k in SIDES])
    reach = F.greatest(c("insertion_mei_span"), hint)
    high = F.greatest(*[c(s, "insertion_mei_start") for s in ("asm", *SAMPLES)])
    low = F.greatest(*[c(s, "insertion_mei_end") for s in ("asm", *SAMPLES)])
    # one end: the other lies as far away as the element is long
    half = F.when((high > 0) & (low <= 0) & (reach > 0), pair(high, F.greatest(F.lit(1).cast("bigint"), high - reach + 1))).when((low > 0) & (high <= 0) & (reach > 0), pair(low + reach - 1, low))
    mapped = F.filter(F.array(*[c(s, k, m) for s in SAMPLES for k in SIDES for m in ("mei_start", "mei_end")]), lambda x: x > 0)
    tail = sum(c(s, "poly_at_reads") for s in SAMPLES) > 0
    first, last = F.array_min(mapped), F.array_max(mapped)
    outer = F.when(F.size(F.array_distinct(mapped)) >= 2, pair(first, last))
    projected = F.when(tail & (F.size(mapped) > 0) & (hint > 0), F.struct(F.greatest(hint, first).alias("three"), first.alias("five")))
    alone = F.when(tail & (F.size(mapped) > 0), F.struct(last.alias("three"), F.lit(-1).cast("bigint").alias("five")))
    none = F.struct(F.lit(-1).cast("bigint").alias("three"), F.lit(-1).cast("bigint").alias("five"))
    return F.coalesce(*known, *pairs, *mixed, half, outer, projected, alone, none)


def review_table(df: DataFrame) -> DataFrame:
    """Consensus columns of ranked loci; short spans are dropped, unknown coordinates are -1."""
    present = set(df.columns)
    need = {"asm_insertion_mei_start": F.lit(0), "asm_insertion_mei_end": F.lit(0), "tsd_seq": F.lit(""), "known_mei_polymorphism_id": F.lit(""), "known_mei_polymorphism_source": F.lit(""), "known_mei_polymorphism_family": F.lit(""), "nested_in_same_MEI": F.lit("")}
    df = df.withColumns({n: v for n, v in need.items() if n not in present}).withColumn("_e", element_coordinates())
    span = F.when((F.col("_e.three") > 0) & (F.col("_e.five") > 0), F.col("_e.three") - F.col("_e.five") + 1).otherwise(0)
    short = (span > 0) & (span < LEAST_SPAN)
    unknown = F.lit(-1).cast("bigint")
    return df.select(
        "priority_rank", "chrom", F.col("insertion_breakpoint_pos").alias("consensus_insertion_breakpoint_pos"), "window_start", "window_end", "control_supporting_reads", "disease_supporting_reads", "sample_status_label",
        F.col("tsd_seq").alias("consensus_tsd_seq"), F.greatest(*[f"{s}_poly_at_max_run" for s in SAMPLES]).alias("consensus_poly_at_max_run"), F.col("event_family").alias("consensus_mei_family"), F.col("event_subfamily").alias("consensus_mei_subfamily"),
        "known_mei_polymorphism_id", "known_mei_polymorphism_source", "known_mei_polymorphism_family", F.col("insertion_orientation").alias("consensus_insertion_orientation"), "nested_in_same_MEI",
        F.when(short, 0).otherwise(span).alias("consensus_insertion_mei_span_full"), F.when(short, unknown).otherwise(F.col("_e.five")).alias("consensus_insertion_mei_5p_coord_full"), F.when(short, unknown).otherwise(F.col("_e.three")).alias("consensus_insertion_mei_3p_coord_full"),
        "analysis_stage_tier", "stage_fail_reason", "insertion_call_tier", "complex_mei_event", "insertion_model_score", "read_support_heuristic_score",
    )


def export_texts(df: DataFrame) -> DataFrame:
    """All columns as a stable text table takes them: null texts empty, flags 0 or 1."""
    as_text = {c: F.coalesce(F.col(c), F.lit("")) for c, t in df.dtypes if t == "string"} | {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c, t in df.dtypes if t == "boolean"}
    return df.withColumns(as_text)


def snapshot_commands(ranked: DataFrame, folder: str, pad: int = 200, tier: str | None = "gold", top: int = 0) -> DataFrame:
    """(priority_rank, name, commands): a browser's batch commands per locus, of one stage and the first ``top`` ranks if asked."""
    rows = ranked if tier is None else ranked.filter(F.col("analysis_stage_tier") == tier)
    if top > 0:
        rows = rows.orderBy("priority_rank").limit(top)
    place = F.format_string("%s:%d-%d", F.col("chrom"), F.greatest(F.lit(1), F.col("window_start") - pad), F.col("window_end") + pad)
    name = F.regexp_replace(F.concat_ws("_", *[F.col(k).cast("string") for k in KEY]), "[^A-Za-z0-9._-]", "_")
    commands = F.concat_ws("\n", F.concat(F.lit("goto "), place), F.lit(f"snapshotDirectory {folder}"), F.concat(F.lit("snapshot "), name, F.lit(".png")))
    return rows.select("priority_rank", name.alias("name"), commands.alias("commands"))
