"""Expressions on the names of reads and contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_read_name(name: Column) -> Column:
    """A read's name without a leading ``@``, a comment, ``/1`` or ``/2`` and then ``:0`` to ``:2``; null gives ''."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""), "^@", "")
    first = F.regexp_extract(plain, r"(\S+)", 1)
    return F.regexp_replace(F.regexp_replace(first, "/[12]$", ""), ":[012]$", "")


def preferred_names(names: Column) -> Column:
    """The array of names that a set of preferred reads stands for: each as given and in its canonical form."""
    given = F.filter(F.transform(names, F.trim), lambda x: x != "")
    return F.array_distinct(F.filter(F.concat(given, F.transform(given, canonical_read_name)), lambda x: x != ""))


def read_candidates(name: Column, is_read1: Column, is_read2: Column) -> Column:
    """The names under which an alignment may stand in a set of preferred reads."""
    numbered = F.concat(name, F.lit(":"), F.when(is_read1, "1").when(is_read2, "2").otherwise("0"))
    return F.array(name, numbered, F.concat(name, F.lit("/1")), F.concat(name, F.lit("/2")), canonical_read_name(name), canonical_read_name(numbered))


def contig_aliases(chrom: Column) -> Column:
    """The names that a contig may have in a reference, the given one first; none for null or blank."""
    name = F.trim(F.coalesce(chrom, F.lit("")))
    low = F.lower(name)
    bare, mito = F.substring(name, 4, 1 << 20), [F.lit(x) for x in ("MT", "mt", "M", "m")]
    styled = F.when(low == "chrm", F.array(name, bare, *mito)).when(low.startswith("chr"), F.array(name, bare))
    chr_ = [F.lit("chrM"), F.lit("chrm")]
    plain = F.when(low == "mt", F.array(name, F.concat(F.lit("chr"), name), *chr_, *mito)).when(low == "m", F.array(name, F.concat(F.lit("chr"), name), *chr_, *mito[:3]))
    found = F.coalesce(styled, plain, F.array(name, F.concat(F.lit("chr"), name)))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda x: x != "")))


def chrom_style(chrom: Column, prefixed: Column) -> Column:
    """The contig's name with or without ``chr`` in front."""
    bare = F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 20)).otherwise(chrom)
    return F.when(prefixed, F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))).otherwise(bare)


def in_style_of(track: DataFrame, query: DataFrame, chrom: str = "chrom") -> DataFrame:
    """``track`` with its contigs named as in ``query``: with ``chr`` where any of its rows has it."""
    style = query.agg(F.coalesce(F.bool_or(F.col(chrom).startswith("chr")), F.lit(False)).alias("_prefixed"))  # one row
    return track.join(F.broadcast(style)).withColumn(chrom, chrom_style(F.col(chrom), F.col("_prefixed"))).drop("_prefixed")
