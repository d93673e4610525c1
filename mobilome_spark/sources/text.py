"""Readers of the domain's text formats. Each takes a path (gzip by suffix is
transparent) and returns typed rows; lines that do not parse are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilome_spark.operators.rules import mei_family


def _fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", sep).alias("f"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _int(k: int) -> Column:
    return F.trim(_at(k)).try_cast("bigint")


def track(spark: SparkSession, path: str, below: float | None = None) -> DataFrame:
    """(chrom, start0, end0, score) of a BED, bedGraph or UCSC table, half-open.

    The contig is in the first column or, in tables with a bin column, in the
    second; empty intervals go. With ``below`` only rows with a smaller score stay.
    """
    shift = [F.when(_at(0).startswith("chr"), a).when(_at(1).startswith("chr"), b) for a, b in ((_at(0), _at(1)), (_int(1), _int(2)), (_int(2), _int(3)), (F.trim(_at(3)).try_cast("double"), F.trim(_at(4)).try_cast("double")))]
    rows = _fields(spark, path).select(*[c.alias(n) for c, n in zip(shift, ("chrom", "start0", "end0", "score"), strict=True)])
    rows = rows.filter(F.col("chrom").isNotNull() & (F.col("end0") > F.col("start0")))
    return rows if below is None else rows.filter(F.col("score") < below)


def closed(intervals: DataFrame) -> DataFrame:
    """1-based closed (chrom, start_pos, end_pos) of half-open intervals."""
    return intervals.select("chrom", (F.col("start0") + 1).alias("start_pos"), F.col("end0").alias("end_pos"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, info) with INFO as a map; flags map to ''."""
    pairs = F.transform(F.split(_at(7), ";"), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(x, "^[^=]*=?", "").alias("value")))
    # the first of repeated keys counts
    info = F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["key"]), x["key"]) == i + 1))
    return _fields(spark, path).filter(F.size("f") >= 8).select(_at(0).alias("chrom"), _int(1).alias("pos"), _at(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), info.alias("info"))


def insertion_catalog(variants: DataFrame) -> DataFrame:
    """(chrom, start_pos, end_pos, id, family, subfamily, sv_len, tsd) of mobile-element insertions.

    A missing length is -1 and, as lengths are absolute, becomes 1.
    """
    get = lambda k: F.coalesce(F.try_element_at("info", F.lit(k)), F.lit(""))
    whole = F.upper(F.concat_ws(" ", "alt", get("MEINFO"), get("SVTYPE"), "id"))
    kept = variants.filter(((get("SVTYPE") == "INS") | F.contains("alt", F.lit("INS:ME"))) & whole.rlike("ALU|LINE|L1|SVA|INS:ME"))
    stated = F.coalesce(get("END").try_cast("bigint"), F.col("pos") + F.greatest(F.lit(1), F.length("ref")) - 1)
    family = F.when(whole.rlike("ALU"), "ALU").when(whole.rlike("SVA"), "SVA").when(whole.rlike("LINE|L1"), "LINE1").otherwise("")
    named = F.when(F.col("id").isin(".", ""), F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit("INS"))).otherwise(F.col("id"))
    return kept.select(
        "chrom", F.col("pos").alias("start_pos"), F.greatest("pos", stated).alias("end_pos"), named.alias("id"), family.alias("family"),
        F.split_part(get("MEINFO"), F.lit(","), F.lit(1)).alias("subfamily"), F.abs(F.coalesce(get("SVLEN").try_cast("bigint"), F.lit(-1))).alias("sv_len"), get("TSD").alias("tsd"),
    )


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignment hits of a PAF file; lines with fewer than twelve columns go."""
    names = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alnlen", "mapq")
    return _fields(spark, path).filter(F.size("f") >= 12).select(*[(_at(k) if n in ("qname", "strand", "tname") else _int(k)).alias(n) for k, n in enumerate(names)])


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit per query by score, aligned length, mapping quality and identity;
    then the smaller target and start. Score: .45 identity + .35 coverage + .2 quality."""
    pid, cov = F.try_divide("nmatch", "alnlen"), F.try_divide(F.col("qend") - F.col("qstart"), F.col("qlen"))
    scored = hits.withColumn("pid", F.coalesce(pid, F.lit(0.0))).withColumn("qcov", F.coalesce(cov, F.lit(0.0)))
    raw = 0.45 * F.col("pid") + 0.35 * F.col("qcov") + 0.2 * F.col("mapq") / 60
    scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    order = Window.partitionBy("qname").orderBy(F.desc("score"), F.desc("alnlen"), F.desc("mapq"), F.desc("pid"), F.desc("qcov"), "tname", "tstart")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a FASTA file, upper case; a record is read whole by one task,
    so this suits panels and contigs; see ``reference_blocks`` for long contigs."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    body = F.regexp_replace(F.regexp_replace("v", "^[^\n]*\n?", ""), r"\s+", "")
    return records.select(F.regexp_extract("v", r"^(\S*)", 1).alias("name"), F.upper(body).alias("seq"))


def reference_blocks(records: DataFrame, size: int = 10_000, overlap: int = 200) -> DataFrame:
    """(chrom, block_id, block_start0, seq): overlapping blocks to join by position.

    A contig is cut in one pass; an empty one gives one empty block.
    """
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = records.select(F.col("name").alias("chrom"), F.when(F.length("seq") == 0, F.array(F.lit(""))).otherwise(cut).alias("cut"))
    after = lambda k: F.concat(*[F.coalesce(F.get("cut", k + d), F.lit("")) for d in range(1, -(-overlap // size) + 1)], F.lit(""))
    whole = F.transform("cut", lambda piece, k: F.concat(piece, F.left(after(k), F.lit(overlap))))
    blocks = pieces.select("chrom", F.posexplode(whole).alias("block_id", "seq"))
    return blocks.select("chrom", "block_id", (F.col("block_id").cast("bigint") * size).alias("block_start0"), "seq")


def sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Alignments of a SAM text: flags as columns, ``ref_end`` from the CIGAR, NM and SA tags."""
    f = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 11)
    flag = {"is_paired": 1, "is_proper_pair": 2, "is_unmapped": 4, "mate_is_unmapped": 8, "is_reverse": 16, "mate_is_reverse": 32, "is_read1": 64, "is_secondary": 256, "is_qcfail": 512, "is_duplicate": 1024, "is_supplementary": 2048}
    moved = F.regexp_extract_all(_at(5), F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    span = F.aggregate(moved, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    tag = lambda name: F.get(F.filter("f", lambda x: x.startswith(name)), F.lit(0))
    none = lambda c: F.when(c != "*", c)
    return f.select(
        F.lit(sample).alias("sample"), _at(0).alias("read_name"), none(_at(2)).alias("chrom"), _int(3).alias("pos"), (_int(3) + span - 1).alias("ref_end"), _int(4).alias("mapq"),
        *[(_int(1).bitwiseAND(bit) != 0).alias(n) for n, bit in flag.items()], _at(5).alias("cigar"),
        F.when(_at(6) == "=", _at(2)).otherwise(none(_at(6))).alias("mate_chrom"), _int(7).alias("mate_pos"), _int(8).alias("template_len"), _at(9).alias("seq"),
        F.substring(tag("NM:i:"), 6, 12).try_cast("int").alias("nm"), F.regexp_replace(tag("SA:Z:"), "^SA:Z:", "").alias("sa"),
    )


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end0, rep_strand, rep_name, rep_class, rep_type, rep_family) of a repeat table.

    Contigs stand in the sixth column of the full table or the first of a BED-like
    one. ``rep_family`` is the mobile-element family named in it, or ''.
    """
    full, short = (F.size("f") >= 13) & _at(5).startswith("chr"), (F.size("f") >= 8) & _at(0).startswith("chr")
    names = ("chrom", "start0", "end0", "rep_strand", "rep_name", "rep_class", "rep_type")
    columns = [F.when(full, get(i)).when(short, get(k)).alias(n) for n, i, k, get in zip(names, (5, 6, 7, 9, 10, 11, 12), (0, 1, 2, 5, 6, 7, 8), (_at, _int, _int, _at, _at, _at, _at), strict=True)]
    rows = _fields(spark, path).select(*columns).filter("chrom IS NOT NULL AND end0 > start0").withColumn("rep_type", F.coalesce("rep_type", F.lit("")))
    return rows.withColumn("rep_family", mei_family(F.concat_ws(" ", "rep_name", "rep_class", "rep_type"), ("ALU", "SVA", "LINE1"), ""))


def fastq_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct read names of FASTQ files: first words of headers without the last ``:suffix``.

    A file is read whole; the files are per-locus extracts with a cap on reads.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line"))
    word = F.regexp_extract(F.trim("line"), r"^@(\S+)", 1)
    return lines.filter(F.col("k") % 4 == 0).select(F.regexp_replace(word, ":[^:]*$", "").alias("read_name")).filter("read_name <> ''").distinct()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, manifest): each file's JSON object as a map of its values' texts; null for a file that holds no valid object."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.from_json("value", "map<string,string>").alias("manifest"))
