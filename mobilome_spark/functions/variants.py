"""Expressions on variant records: ends, order and style of contigs, names of panel elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vcf_end(pos: Column, ref: Column, info: Column) -> Column:
    """Last base of a record: the first ``END`` of INFO if it is a whole number, else by the length of REF; never before ``pos``."""
    told = F.regexp_extract(F.concat(F.lit(";"), F.coalesce(info, F.lit(""))), ";END=([^;]*)", 1).try_cast("bigint")
    by_ref = pos + F.greatest(F.length(F.coalesce(ref, F.lit(""))), F.lit(1)) - 1
    return F.greatest(F.coalesce(told, by_ref), pos).cast("bigint")


def with_vcf_end(info: Column, end: Column) -> Column:
    """INFO with its first ``END`` set, added at the end where there is none; null, '' and '.' hold nothing else."""
    entry = F.concat(F.lit("END="), end.cast("bigint").cast("string"))
    first = r"(?s)^(|.*?;)END=[^;]*(.*)$"
    changed = F.when(info.rlike(first), F.regexp_replace(info, F.lit(first), F.concat(F.lit("$1"), entry, F.lit("$2"))))
    return F.when(F.coalesce(info, F.lit("")).isin("", "."), entry).otherwise(F.coalesce(changed, F.concat(info, F.lit(";"), entry)))


def vcf_order(chrom: Column) -> Column:
    """Sort key of a contig: 1 to 22, X, Y, M or MT, then all others, each by name."""
    name = F.trim(F.coalesce(chrom, F.lit("")))
    core = F.regexp_replace(name, "^chr", "")
    number = F.when(core.rlike("^[0-9]+$"), core.try_cast("int"))
    rank = F.when(number.between(1, 22), number).when(core == "X", 23).when(core == "Y", 24).when(core.isin("M", "MT"), 25).otherwise(1000)
    return F.struct(rank.alias("rank"), name.alias("name"))


def lifted_style(chrom: Column, prefixed: Column) -> Column:
    """A contig's name in the style of the assembly lifted to; the mitochondrion is chrM or MT there."""
    name = F.trim(F.coalesce(chrom, F.lit("")))
    core = F.substring(name, 4, 1 << 20)
    to_chr = F.when(name.startswith("chr"), name).when(name.isin("M", "MT", "m", "mt"), "chrM").otherwise(F.concat(F.lit("chr"), name))
    bare = F.when(~name.startswith("chr"), name).when(core.isin("M", "m"), "MT").otherwise(core)
    return F.when(name == "", "").when(prefixed, to_chr).otherwise(bare)


def panel_element(header: Column) -> Column:
    """The full element that a repeat record stands for: its name before ``#`` without the mark of a fragment."""
    name = F.regexp_replace(F.coalesce(header, F.lit("")), "(?s)#.*$", "")
    return F.regexp_replace(F.regexp_replace(name, "(?i)_(3end|5end|orf2)$", ""), "(?i)_short_?$", "")
