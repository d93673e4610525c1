"""Deterministic projections of the driver's tables into evidence shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows from ``events``: contig, position, read, sample, kind, side."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("chrom"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("bigint").alias("pos"),
        F.col("user_id").alias("read_name"),
        F.when(F.col("user_id") % 2 == 0, "disease").otherwise("control").alias("sample"),
        F.when(F.col("event_id") % 3 == 0, "discordant").otherwise("split").alias("kind"),
        F.when(F.col("event_id") % 4 < 2, "L").otherwise("R").alias("clip_side"),
        (F.col("event_id") % 61).cast("bigint").alias("mapq"),
        "value",
    )


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Intervals from ``orders`` and a track of features from ``lineitem``."""
    o, line = F.col("o_orderkey"), F.col("l_orderkey") * 3 + F.col("l_linenumber") * 7
    iv = table(spark, sf_dir, "orders").select(
        o.cast("bigint").alias("iv_id"), (F.col("o_custkey") % 10).cast("string").alias("chrom"), (o * 3).cast("bigint").alias("start_pos"), (o * 3 + 20 + o % 97).cast("bigint").alias("end_pos")
    )
    tr = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("tr_id"), (F.col("l_suppkey") % 10).cast("string").alias("chrom"), line.cast("bigint").alias("tr_start"), (line + 5 + F.col("l_partkey") % 40).cast("bigint").alias("tr_end")
    )
    return iv, tr


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits from ``lineitem``: locus, read, target, score, side, positions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("locus"), F.col("l_orderkey").cast("bigint").alias("read_name"), F.concat("l_returnflag", "l_linestatus").alias("target"), F.col("l_quantity").alias("score"),
        F.when(F.col("l_linenumber") % 2 == 0, "L").otherwise("R").alias("side"), (F.col("l_partkey") % 50).cast("bigint").alias("pos"), F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") % 1000).cast("bigint").alias("anchor"), (F.col("l_partkey") % 700).cast("bigint").alias("target_mid"), F.col("l_extendedprice").alias("price"),
    )
