"""Row rules: derived columns of a locus, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons that suffice alone; the others are weak.
STRONG = ("interchrom", "large_insert", "mate_unmapped", "poly_tail_anchor_rescue")


def discordant_reasons(mate_unmapped: Column, other_chrom: Column, tlen: Column, threshold: Column | int, same_strand: Column, proper: Column, poly: Column) -> Column:
    """Sorted, comma-joined reasons why a pair is discordant ('' if none)."""
    size = ~mate_unmapped & ~other_chrom & (F.abs(tlen) >= threshold)
    reasons = (
        (mate_unmapped, "mate_unmapped"), (~mate_unmapped & other_chrom, "interchrom"), (size, "large_insert"),
        (same_strand, "same_strand"), (~proper, "improper_pair"), (poly, "poly_tail_anchor_rescue"),
    )
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in reasons]))), ",")


def has_strong_reason(reasons: Column) -> Column:
    return F.arrays_overlap(F.split(reasons, ","), F.array(*[F.lit(r) for r in STRONG]))


def breakpoint_interval(candidates: list[Column], pos: Column, start: Column, end: Column) -> list[Column]:
    """(left, right, width, tier, pos) from the positive candidates, within the window.

    Without a candidate the position itself, or the window's middle, is taken;
    the new position is the middle, rounded half to even.
    """
    known = F.filter(F.array(*candidates), lambda x: x > 0)
    single = F.when(pos > 0, pos).otherwise(F.floor((start + end) / 2).cast("bigint"))
    left = F.greatest(start, F.least(end, F.coalesce(F.array_min(known), single)))
    right = F.greatest(start, F.least(end, F.coalesce(F.array_max(known), single)))
    width = right - left + 1
    tier = F.when(width <= 3, "high").when(width <= 15, "medium").otherwise("low")
    return [left.alias("bp_left"), right.alias("bp_right"), width.alias("bp_width"), tier.alias("bp_tier"), F.rint((left + right) / 2).cast("bigint").alias("bp_pos")]


def vaf_bounds(alt: Column, ref: Column) -> list[Column]:
    """Allele fraction with normal bounds, null without any read."""
    n = F.nullif(alt + ref, F.lit(0.0))
    p = alt / n
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return [p.alias("vaf"), F.greatest(F.lit(0.0), p - half).alias("vaf_low"), F.least(F.lit(1.0), p + half).alias("vaf_high")]


def support_string(parts: dict[str, Column]) -> Column:
    """``SR_L=..,SR_R=..`` text of the named counts."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])


def support_field(text: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract(text, f"(?:^|,){name}=([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def agreement(a: Column, b: Column) -> Column:
    """0 if both are empty, 1 if one is, else whether they are equal."""
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 1).otherwise((a == b).cast("int"))


def mei_family(text: Column, order: tuple[str, ...] = ("SVA", "ALU", "LINE1", "ERV"), other: str = "OTHER") -> Column:
    """Family named in a text; ``order`` settles texts that name several."""
    upper, out = F.upper(text), None
    marks = {"SVA": "SVA", "ALU": "ALU", "LINE1": "LINE|L1", "ERV": "ERV|LTR"}
    for family in order:
        out = (F.when if out is None else out.when)(upper.rlike(marks[family]), family)
    return out.otherwise(other)


def cigar_events(cigar: Column, pos: Column) -> Column:
    """Insertions and deletions of a CIGAR text: array of (kind, len, ref_pos).

    M, = and X move along the reference, as do D and N; an insertion stands at
    the present position, a deletion in its middle.
    """
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    seed = F.struct(pos.cast("bigint").alias("at"), F.array().cast("array<struct<kind:string,len:bigint,ref_pos:bigint>>").alias("out"))

    def step(state, op):
        n, kind = F.left(op, F.length(op) - 1).cast("bigint"), F.right(op, F.lit(1))
        place = state["at"] + F.when(kind == "D", F.floor(n / 2).cast("bigint")).otherwise(F.lit(0))
        event = F.array(F.struct(kind.alias("kind"), n.alias("len"), place.alias("ref_pos")))
        return F.struct(
            (state["at"] + F.when(kind.isin("M", "=", "X", "D", "N"), n).otherwise(F.lit(0))).alias("at"),
            F.when(kind.isin("I", "D"), F.concat(state["out"], event)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(ops, seed, step, lambda s: s["out"])


def tsd_pair(left: dict[str, Column], right: dict[str, Column], support: dict[str, Column]) -> Column:
    """(left, right, length, source) of the target-site duplication between the breakpoints of a sample.

    Duplications of 2 to 30 bases count: the best supported, then the longest, then
    disease. Without one, ends may move by up to two bases: the least movement,
    then support, disease, and the smaller ends. Nothing found: zeros and ''.
    """
    names = ("disease", "control")
    samples = F.array(*[F.struct(left[s].cast("bigint").alias("l"), right[s].cast("bigint").alias("r"), support[s].cast("bigint").alias("n"), F.lit(k).alias("turn"), F.lit(f"tsd_{s}").alias("source")) for k, s in enumerate(names)])
    shifts = F.array(*[F.struct(F.lit(dl).alias("l"), F.lit(dr).alias("r")) for dl in range(-2, 3) for dr in range(-2, 3)])

    def at(s, d):
        moved = F.abs(d["l"]) + F.abs(d["r"])
        l, r = s["l"] + d["l"], s["r"] + d["r"]
        # unmoved pairs come first; only among them does the longer one win
        return F.struct(moved.alias("moved"), (-s["n"]).alias("n"), F.when(moved == 0, l - r).otherwise(0).alias("span"), s["turn"].alias("turn"), l.alias("l"), r.alias("r"), s["source"].alias("source"))

    known = F.filter(samples, lambda s: (s["l"] > 0) & (s["r"] > 0))
    tried = F.flatten(F.transform(known, lambda s: F.transform(shifts, lambda d: at(s, d))))
    found = F.array_min(F.filter(tried, lambda x: (x["l"] > 0) & (x["r"] > 0) & (x["r"] - x["l"] + 1).between(2, 30)))
    zero = F.lit(0).cast("bigint")
    render = lambda x: F.struct(F.coalesce(x["l"], zero).alias("left"), F.coalesce(x["r"], zero).alias("right"), F.coalesce(x["r"] - x["l"] + 1, zero).alias("length"), F.coalesce(x["source"], F.lit("")).alias("source"))
    return F.get(F.transform(F.array(found), render), F.lit(0))


def known_insertion(short_id: Column, short_sub: Column, long_id: Column, long_sub: Column) -> list[Column]:
    """(known, source, family, subfamily, id) from a short-read and a long-read catalog hit ('' without one)."""
    a, b = F.trim(short_id) != "", F.trim(long_id) != ""
    order = ("ALU", "SVA", "LINE1", "ERV")

    def merged(x: Column, y: Column, differ: str) -> Column:
        return F.when(a & b, F.when((x == y) & (x != ""), x).otherwise(differ)).when(a, x).when(b, y).otherwise("")

    source = F.concat_ws(",", F.when(a, "melt_1kg"), F.when(b, "long_read_1kg_ont_vienna"))
    ids = F.when(a & b, F.concat(F.lit("g1k:"), F.trim(short_id), F.lit("|lr:"), F.trim(long_id))).when(a, F.trim(short_id)).when(b, F.trim(long_id)).otherwise("")
    families = merged(mei_family(short_sub, order, ""), mei_family(long_sub, order, ""), "MIXED")
    return [(a | b).alias("known"), source.alias("source"), families.alias("family"), merged(F.trim(short_sub), F.trim(long_sub), "MULTI_SOURCE").alias("subfamily"), ids.alias("id")]
