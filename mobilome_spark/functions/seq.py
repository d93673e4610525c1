"""Sequence expressions: Column builders without Python code per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poly_runs(seq: Column) -> Column:
    """All maximal runs of A and runs of T."""
    return F.regexp_extract_all(F.coalesce(seq, F.lit("")), F.lit("(A+|T+)"), F.lit(1))


def _longest(seq: Column) -> Column:
    """(length, -place, base) of the longest run, the first of equal ones."""
    return F.array_max(F.transform(poly_runs(seq), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), F.left(r, F.lit(1)).alias("base"))))


def poly_at_run(seq: Column) -> Column:
    """Length of the longest run of one of A and T; null and empty: 0."""
    return F.coalesce(_longest(seq)["n"], F.lit(0))


def poly_at_base(seq: Column) -> Column:
    """Base of the first run that is as long as the longest; '' without one."""
    return F.coalesce(_longest(seq)["base"], F.lit(""))


def base_count(seq: Column, bases: str) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(seq, f"[{bases}]", ""))


def poly_at_fraction(seq: Column) -> Column:
    return F.coalesce(base_count(seq, "AT") / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))


def poly_at_end(seq: Column, window: int) -> Column:
    """(run, fraction, base, side) of the end, of ``window`` bases, with the longer run,
    then the larger fraction; L for equal ones. Null and empty: 0, 0, '' and ''."""
    upper = F.upper(F.coalesce(seq, F.lit("")))
    ends = [(F.left(upper, F.lit(window)), 1, "L"), (F.right(upper, F.lit(window)), 0, "R")]
    found = [F.struct(poly_at_run(e).alias("run"), poly_at_fraction(e).alias("fraction"), F.lit(first).alias("first"), poly_at_base(e).alias("base"), F.when(upper == "", "").otherwise(side).alias("side")) for e, first, side in ends]
    return F.array_max(F.array(*found))


def normalized_clip(seq: Column, most: int = 80) -> Column:
    """Upper case, A, C, G and T only, the first ``most`` of them."""
    return F.left(F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), "[^ACGT]", ""), F.lit(most))


def entropy(clip: Column) -> Column:
    """Base-2 entropy of the four bases; empty: 0."""
    n = F.nullif(F.length(clip), F.lit(0))
    shares = [base_count(clip, b) / n for b in "ACGT"]
    return F.coalesce(sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0)), F.lit(0.0))


def informative_clip(clip: Column) -> Column:
    """At least 20 bases, 15 % of them C or G, entropy of at least 1.2."""
    return (F.length(clip) >= 20) & (base_count(clip, "CG") / F.greatest(F.length(clip), F.lit(1)) >= 0.15) & (entropy(clip) >= 1.2)


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; for unequal lengths the longer length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    differ = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).when(F.length(a) == 0, 0).otherwise(differ)


def motif_logodds(six: Column) -> Column:
    """Log-odds of two pyrimidines followed by four purines; 0 unless six bases."""
    terms = [F.log2(F.when(F.substring(six, k, 1).isin(*("CT" if k <= 2 else "AG")), 0.45).otherwise(0.05) / 0.25) for k in range(1, 7)]
    return F.when(F.length(six) == 6, sum(terms[1:], terms[0])).otherwise(F.lit(0.0))


def significant(value: Column, digits: int) -> Column:
    """Round half to even at ``digits`` significant digits; 0 and null stay."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.rint(value * power) / power)


#: Insertion-site motifs of the L1 endonuclease, their class and the mismatches allowed.
MOTIFS = (
    ("TTAAAA", "l1_en_canonical", 1),
    ("TTTAAA", "l1_en_canonical", 1),
    ("TTTTAA", "l1_en_canonical", 1),
    ("AAACTT", "l1_en_alternative", 1),
    ("CTGGG", "l1_en_alternative", 2),
    ("CCATT", "nested_novel_like", 2),
)


def endonuclease_motif(context: Column) -> Column:
    """(like, motif, kind, mismatches, allowed, seq, offset) of the motif nearest to the
    six bases at the breakpoint (second to seventh of 11); five-base motifs slide by
    one. Ties go to the earlier motif, then the earlier slice; under 8 bases: null."""
    six = F.substring(F.upper(context), 2, 6)
    tried, n = [], 0
    for motif, kind, allowed in MOTIFS:
        for offset in range(7 - len(motif)):
            window = F.substring(six, offset + 1, len(motif))
            tried.append(F.struct(hamming(window, F.lit(motif)).alias("mismatches"), F.lit(n).alias("turn"), F.lit(motif).alias("motif"), F.lit(kind).alias("kind"), F.lit(allowed).alias("allowed"), window.alias("seq"), F.lit(offset).alias("offset")))
            n += 1
    best = F.array_min(F.array(*tried))
    fields = [best[f].alias(f) for f in ("motif", "kind", "mismatches", "allowed", "seq", "offset")]
    return F.when(F.length(context) >= 8, F.struct((best["mismatches"] <= best["allowed"]).alias("like"), *fields))


def shifted_logodds(context: Column) -> Column:
    """(strict, best, shift) of ``motif_logodds`` at shifts -1, 0 and 1 of an 11-base
    context; the first of equal ones counts. Under 8 bases all are 0."""
    scores = F.array(*[F.struct(motif_logodds(F.substring(context, k + 1, 6)).alias("s"), F.lit(-k).alias("turn")) for k in range(3)])
    best = F.array_max(scores)
    long = F.length(context) >= 8
    return F.struct(F.when(long, scores[1]["s"]).otherwise(0.0).alias("strict"), F.when(long, best["s"]).otherwise(0.0).alias("best"), F.when(long, -best["turn"] - 1).otherwise(0).alias("shift"))


def clip_identity(a: Column, b: Column) -> Column:
    """Share of equal bases over the common length of two clips' beginnings; empty: 0."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int"))
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / F.nullif(n, F.lit(0)), F.lit(0.0))


def without_tail(clip: Column, side: Column, run: int = 8, least: int = 12) -> Column:
    """The clip without its longest run of A or T, if that has ``run`` bases: the part behind
    it for a left clip, before it for a right one, else the longer; a part below ``least``
    bases gives way to the other, then to both joined, then to the whole clip."""
    s = F.upper(F.coalesce(clip, F.lit("")))
    n, base = poly_at_run(s), poly_at_base(s)
    # the first place where so many stand in a row is the first longest run
    at = F.instr(s, F.repeat(base, n))
    before, behind = F.left(s, at - 1), F.substring(s, at + n, F.length(s))
    behind_first = (F.upper(side) == "L") | (~F.coalesce(F.upper(side) == "R", F.lit(False)) & (F.length(behind) >= F.length(before)))
    first, second = F.when(behind_first, behind).otherwise(before), F.when(behind_first, before).otherwise(behind)
    cut = F.when(F.length(first) >= least, first).when(F.length(second) >= least, second).when(F.length(before) + F.length(behind) >= least, F.concat(before, behind)).otherwise(s)
    return F.when(n < run, s).otherwise(cut)
