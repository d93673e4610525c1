"""Writers of tables and of the domain's text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.functions.variants import vcf_order


def text_frame(df: DataFrame) -> DataFrame:
    """For text tables: null strings become '' and booleans 0 or 1."""
    plain = {"string": lambda c: F.coalesce(c, F.lit("")), "boolean": lambda c: c.cast("int")}
    return df.select(*[plain.get(kind, lambda c: c)(F.col(f"`{name}`")).alias(name) for name, kind in df.dtypes])


#: Orders of written tables; the columns after the first named ones settle ties.
LOCI_ORDER = ("chrom", "window_start", "window_end")
EVIDENCE_ORDER = ("chrom", "pos", "sample", "read_name")


def enriched_first(df: DataFrame) -> DataFrame:
    """Loci by enrichment and rows of the disease, both falling, ties by place."""
    return df.orderBy(F.desc("enrichment"), F.desc("disease_rows"), *LOCI_ORDER)


def in_vcf_order(variants: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Variants by contig as in a VCF, then by place."""
    return variants.orderBy(vcf_order(F.col(chrom)), pos)


def manifest_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object with sorted keys, nulls included."""
    cells = [F.col(f"`{name}`") for name in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, order_by: tuple[str, ...] = ()) -> None:
    """``path.parquet`` and ``path.tsv`` (folders of part files, with header lines), in the order of ``order_by`` if given."""
    df = df.orderBy(*order_by) if order_by else df
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{path}.parquet")
    text_frame(df).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(f"{path}.tsv")


def bed_lines(df: DataFrame, chrom: str = "chrom", start: str = "window_start", end: str = "window_end", name: str | None = None) -> DataFrame:
    """One column ``value`` of BED lines, half-open, from closed intervals."""
    cells = [F.col(chrom), (F.col(start) - 1).cast("string"), F.col(end).cast("string"), *([F.col(name).cast("string")] if name else [])]
    return df.select(F.concat_ws("\t", *cells).alias("value"))
