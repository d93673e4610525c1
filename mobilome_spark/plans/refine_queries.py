"""Queries of the refinement operators, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome_spark.functions import names, register, variants
from mobilome_spark.operators import refine
from mobilome_spark.operators.loci import KEY
from mobilome_spark.plans.projections import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str):
    """Register a query under its function's name, with its DuckDB text."""

    def add(build):
        _QUERIES[build.__name__], _ORACLES[build.__name__] = build, sql
        return build

    return add


def _columns(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str]) -> DataFrame:
    """Expressions that both engines read, over a table."""
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _sql(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source})"


_NAMES = {
    "c_custkey": "c_custkey",
    "raw": "concat(CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END, ':', CAST(c_custkey % 977 AS STRING), "
    "CASE c_custkey % 5 WHEN 0 THEN '/1' WHEN 1 THEN '/2' WHEN 2 THEN ':1' WHEN 3 THEN ':2/1' ELSE '/3' END, CASE WHEN c_custkey % 4 = 0 THEN ' a comment' ELSE '' END)",
}
_CANON = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim({}), '^@', ''), '(\S+)', 1), '/[12]$', ''), ':[012]$', '')"


@_query(f"WITH {_sql('n', 'customer', _NAMES).replace('STRING', 'VARCHAR')} SELECT c_custkey, raw, {_CANON.format('raw')} AS read_name FROM n")
def q_read_names(spark, sf_dir):
    return _columns(spark, sf_dir, "customer", _NAMES).withColumn("read_name", names.canonical_read_name(F.col("raw")))


@_query(f"""
WITH {_sql('n', 'customer', _NAMES).replace('STRING', 'VARCHAR')}, s AS (SELECT DISTINCT {_CANON.format("'@' || CAST(s_name AS VARCHAR) || '/1'")} AS c FROM supplier)
SELECT c_custkey, raw FROM n WHERE {_CANON.format('raw')} <> '' AND ({_CANON.format('raw')} IN (SELECT {_CANON.format('raw')} FROM n WHERE c_custkey % 7 = 0) OR {_CANON.format('raw')} IN (SELECT c FROM s))""")
def q_preferred_reads(spark, sf_dir):
    rows = _columns(spark, sf_dir, "customer", _NAMES)
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("@"), "s_name", F.lit("/1")).alias("read_name"))
    return refine.preferred_rows(rows, rows.filter("c_custkey % 7 = 0").select(F.col("raw").alias("read_name")).unionByName(suppliers), "raw")


@_query("""
WITH n AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 8 WHEN 0 THEN 'chr' || c_nationkey WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'chrM' WHEN 3 THEN 'MT' WHEN 4 THEN 'm' WHEN 5 THEN '' WHEN 6 THEN ' chrX ' ELSE 'Chr' || c_nationkey END AS chrom FROM customer)
SELECT c_custkey, array_to_string(CASE c_custkey % 8 WHEN 0 THEN [chrom, CAST(c_nationkey AS VARCHAR)] WHEN 1 THEN [chrom, 'chr' || chrom] WHEN 2 THEN ['chrM', 'M', 'MT', 'mt', 'm']
  WHEN 3 THEN ['MT', 'chrMT', 'chrM', 'chrm', 'mt', 'M', 'm'] WHEN 4 THEN ['m', 'chrm', 'chrM', 'MT', 'mt', 'M'] WHEN 5 THEN [] WHEN 6 THEN ['chrX', 'X'] ELSE [chrom, CAST(c_nationkey AS VARCHAR)] END, ',') AS aliases FROM n""")
def q_contig_aliases(spark, sf_dir):
    k, n = F.col("c_custkey") % 8, F.col("c_nationkey").cast("string")
    chrom = F.when(k == 0, F.concat(F.lit("chr"), n)).when(k == 1, n).when(k == 2, "chrM").when(k == 3, "MT").when(k == 4, "m").when(k == 5, "").when(k == 6, " chrX ").otherwise(F.concat(F.lit("Chr"), n))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names.contig_aliases(chrom), ",").alias("aliases"))


@_query("""
SELECT s_suppkey, CASE WHEN (SELECT bool_or(c_custkey % 1000 = 7) FROM customer) THEN CASE WHEN s_suppkey % 2 = 0 THEN 'chr' || s_nationkey ELSE 'chr' || s_nationkey END
  ELSE CAST(s_nationkey AS VARCHAR) END AS chrom FROM supplier""")
def q_chrom_style(spark, sf_dir):
    named = lambda c, n: F.concat(F.when(c, "chr").otherwise(""), F.col(n).cast("string")).alias("chrom")
    asked = table(spark, sf_dir, "customer").select(named(F.col("c_custkey") % 1000 == 7, "c_nationkey"))
    return names.in_style_of(table(spark, sf_dir, "supplier").select("s_suppkey", named(F.col("s_suppkey") % 2 == 0, "s_nationkey")), asked)


_PAIRS = {
    "id": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)", "read_seq": "repeat(CASE l_partkey % 4 WHEN 0 THEN 'ACGTG' WHEN 1 THEN 'TTAGC' WHEN 2 THEN 'GGATC' ELSE 'CCTGA' END, CAST(4 + l_suppkey % 5 AS INT))",
    "discordant_reasons": "CASE l_partkey % 5 WHEN 0 THEN 'interchrom' WHEN 1 THEN 'improper_pair,large_insert' WHEN 2 THEN 'mate_unmapped' WHEN 3 THEN 'same_strand' END",
}


@_query(f"""
WITH {_sql('r', 'lineitem', _PAIRS)}, e AS (SELECT *, 'disease_disc_' || left(sha256(read_seq), 24) AS query_id FROM r
  WHERE length(read_seq) >= 30 AND (discordant_reasons LIKE '%interchrom%' OR discordant_reasons LIKE '%mate_unmapped%' OR discordant_reasons LIKE '%large_insert%'))
SELECT id, query_id, CASE WHEN left(read_seq, 1) IN ('A', 'T') THEN left(read_seq, 5) END AS target, CASE WHEN left(read_seq, 1) IN ('A', 'T') THEN CAST(length(read_seq) AS BIGINT) END AS alnlen FROM e""")
def q_attach_hits(spark, sf_dir):
    """The alignment contract: eligible reads, distinct queries, a stand-in aligner's hits, attached again."""
    rows = refine.with_query_id(refine.eligible_pairs(_columns(spark, sf_dir, "lineitem", _PAIRS)), "read_seq", "disease_disc")
    asked = refine.alignment_queries(rows, "read_seq")
    hits = asked.filter(F.left("seq", F.lit(1)).isin("A", "T")).select(F.col("name").alias("qname"), F.left("seq", F.lit(5)).alias("target"), F.length("seq").cast("bigint").alias("alnlen"))
    return refine.attach_hits(rows, hits).select("id", "query_id", "target", "alnlen")


_FIELDS = {
    "o_orderkey": "o_orderkey", "disease_poly_at_max_run": "CAST(o_custkey % 14 AS BIGINT)", "split_disease_poly_tail_at_run_max": "CASE WHEN o_custkey % 5 > 0 THEN CAST(o_orderkey % 17 AS BIGINT) END",
    "discordant_disease_poly_tail_at_run_max": "CAST(o_orderkey % 11 AS BIGINT)", "control_poly_at_max_run": "CAST(o_orderkey % 9 AS BIGINT)", "split_control_poly_tail_at_run_max": "CAST(o_custkey % 12 AS BIGINT)",
    "discordant_control_poly_tail_at_run_max": "CAST(o_custkey % 7 AS BIGINT)", "disease_poly_at_reads": "CAST(o_orderkey % 4 AS BIGINT)", "split_disease_poly_tail_rescued_unique_reads": "CAST(o_custkey % 6 AS BIGINT)",
    "discordant_disease_poly_tail_rescued_unique_reads": "CAST(o_custkey % 3 AS BIGINT)", "control_poly_at_reads": "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 5 AS BIGINT) END",
    "split_control_poly_tail_rescued_unique_reads": "CAST(o_orderkey % 2 AS BIGINT)", "discordant_control_poly_tail_rescued_unique_reads": "CAST(o_orderkey % 5 AS BIGINT)",
    "disease_total_rows": "CAST(o_orderkey % 13 AS BIGINT)", "control_total_rows": "CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 10 AS BIGINT) END", "disease_mei_supported_reads": "CAST(o_custkey % 8 AS BIGINT)", "control_mei_supported_reads": "CAST(o_orderkey % 6 AS BIGINT)",
    "disease_L_mei_family": "CASE o_orderkey % 4 WHEN 0 THEN 'ALU' WHEN 1 THEN '' WHEN 2 THEN ' SVA ' END", "disease_R_mei_family": "CASE o_custkey % 3 WHEN 0 THEN 'ALU' WHEN 1 THEN '' ELSE 'SVA' END",
    "control_L_mei_family": "CASE WHEN o_custkey % 2 = 0 THEN 'ALU' ELSE '' END", "control_R_mei_family": "CASE WHEN o_orderkey % 7 = 0 THEN 'LINE1' ELSE '' END",
    "breakpoint_yyrrrr_logodds_shift1_mt_adj": "CASE WHEN o_custkey % 9 > 0 THEN CAST(o_orderkey % 7 - 3 AS DOUBLE) END", "breakpoint_l1_en_motif_like": "o_orderkey % 2 = 0",
    "breakpoint_l1_en_motif_type": "CASE o_custkey % 4 WHEN 0 THEN 'l1_en_canonical' WHEN 1 THEN 'l1_en_alternative' WHEN 2 THEN 'nested_novel_like' ELSE '' END", "breakpoint_l1_en_hexamer_oriented": "CASE WHEN o_orderkey % 5 > 1 THEN 'TTAAAA' END",
    "breakpoint_l1_en_pattern_yy_rrrr": "CASE WHEN o_orderkey % 5 > 2 THEN 'YY|RRRR' ELSE '' END", "breakpoint_l1_en_best_match_pattern_yy_rrrr": "CASE WHEN o_custkey % 2 = 0 THEN 'YY|RRRY' END", "breakpoint_l1_en_best_motif": "'TTTAAA'",
}
_FIELDS_SQL = _sql("f", "orders", _FIELDS)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir, "orders", _FIELDS)


@_query(f"""
WITH {_FIELDS_SQL}, g AS (SELECT o_orderkey,
  greatest(coalesce(disease_poly_at_max_run, 0), coalesce(split_disease_poly_tail_at_run_max, 0), coalesce(discordant_disease_poly_tail_at_run_max, 0)) AS disease_poly_at_max_run,
  greatest(coalesce(control_poly_at_max_run, 0), coalesce(split_control_poly_tail_at_run_max, 0), coalesce(discordant_control_poly_tail_at_run_max, 0)) AS control_poly_at_max_run,
  greatest(coalesce(disease_poly_at_reads, 0), split_disease_poly_tail_rescued_unique_reads) + discordant_disease_poly_tail_rescued_unique_reads AS disease_poly_at_reads,
  greatest(coalesce(control_poly_at_reads, 0), split_control_poly_tail_rescued_unique_reads) + discordant_control_poly_tail_rescued_unique_reads AS control_poly_at_reads FROM f)
SELECT *, greatest(disease_poly_at_max_run, control_poly_at_max_run) AS poly_at_max_run, disease_poly_at_reads + control_poly_at_reads AS poly_at_reads FROM g""")
def q_broaden_tails(spark, sf_dir):
    return refine.broaden_tails(_fields(spark, sf_dir)).select("o_orderkey", *[f"{s}_poly_at_{m}" for s in ("disease", "control") for m in ("max_run", "reads")], "poly_at_max_run", "poly_at_reads")


@_query(f"""
WITH {_FIELDS_SQL}, g AS (SELECT o_orderkey, coalesce(disease_total_rows, 0) AS dt, coalesce(control_total_rows, 0) AS ct,
  disease_mei_supported_reads / CASE WHEN coalesce(disease_total_rows, 0) = 0 THEN 1 ELSE disease_total_rows END AS d, control_mei_supported_reads / CASE WHEN coalesce(control_total_rows, 0) = 0 THEN 1 ELSE control_total_rows END AS c FROM f)
SELECT o_orderkey, dt AS disease_local_informative_rows, ct AS control_local_informative_rows, round(d, 9) AS disease_mei_support_local_frac, round(c, 9) AS control_mei_support_local_frac,
  round(d * 100, 6) AS disease_mei_support_per_100_local_rows, round(d - c, 9) AS mei_local_support_frac_delta, round((d + 1e-4) / (c + 1e-4), 4) AS mei_local_support_frac_ratio FROM g""")
def q_local_support(spark, sf_dir):
    shown = {"disease_mei_support_local_frac": 9, "control_mei_support_local_frac": 9, "disease_mei_support_per_100_local_rows": 6, "mei_local_support_frac_delta": 9, "mei_local_support_frac_ratio": 4}
    return refine.local_support(_fields(spark, sf_dir)).select("o_orderkey", "disease_local_informative_rows", "control_local_informative_rows", *[F.round(c, n).alias(c) for c, n in shown.items()])


@_query(f"""
WITH {_FIELDS_SQL}, g AS (SELECT o_orderkey, list_distinct(list_filter([trim(coalesce(disease_L_mei_family, '')), trim(disease_R_mei_family), trim(control_L_mei_family), trim(control_R_mei_family)], lambda x: x <> '')) AS l FROM f)
SELECT o_orderkey, len(l) = 1 AS consistent FROM g""")
def q_consistent_family(spark, sf_dir):
    return _fields(spark, sf_dir).select("o_orderkey", refine.consistent_family().alias("consistent"))


@_query(f"""
WITH {_FIELDS_SQL}, g AS (SELECT *, coalesce(breakpoint_yyrrrr_logodds_shift1_mt_adj > 0, false) AS shown, coalesce(breakpoint_l1_en_hexamer_oriented, '') AS hex FROM f),
k AS (SELECT *, CASE WHEN NOT shown THEN '' WHEN breakpoint_l1_en_motif_like AND breakpoint_l1_en_motif_type IN ('l1_en_alternative', 'nested_novel_like') THEN 'non_classical' ELSE 'classical' END AS retro FROM g)
SELECT o_orderkey, hex AS breakpoint_l1_en_observed_motif, CASE WHEN shown THEN breakpoint_l1_en_best_motif ELSE '' END AS breakpoint_l1_en_best_motif, CASE WHEN shown THEN breakpoint_l1_en_motif_type ELSE '' END AS breakpoint_l1_en_motif_type,
  retro AS consensus_retrotransposition_class, CASE WHEN retro = '' THEN '' ELSE coalesce(nullif(breakpoint_l1_en_pattern_yy_rrrr, ''), nullif(hex, ''), breakpoint_l1_en_best_match_pattern_yy_rrrr, breakpoint_l1_en_best_motif) END AS consensus_sequence_signature FROM k""")
def q_motif_report(spark, sf_dir):
    shown = [f"breakpoint_l1_en_{c}" for c in ("observed_motif", "best_motif", "motif_type")]
    return refine.motif_report(_fields(spark, sf_dir)).select("o_orderkey", *shown, "consensus_retrotransposition_class", "consensus_sequence_signature")


_LOCUS = {
    "chrom": "CAST(s_nationkey AS STRING)", "window_start": "CAST(s_suppkey AS BIGINT)", "window_end": "CAST(s_suppkey + 99 AS BIGINT)", "insertion_breakpoint_pos": "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey + 40 END AS BIGINT)",
    "breakpoint_evidence_source": "'split'", "tsd_seq": "CASE WHEN s_suppkey % 2 = 0 THEN 'ACGT' END", "tsd_len_estimate": "CAST(CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 0 END AS BIGINT)", "poly_at_max_run": "CAST(s_suppkey % 20 AS BIGINT)",
    "insertion_orientation": "'+'", "insertion_mei_span": "CAST(s_suppkey % 300 AS BIGINT)", "disease_insertion_mei_start": "CAST(s_suppkey % 50 AS BIGINT)", "disease_insertion_mei_end": "CAST(s_suppkey % 90 AS BIGINT)",
    "control_insertion_mei_start": "CAST(s_suppkey % 40 AS BIGINT)", "control_insertion_mei_end": "CAST(s_suppkey % 70 AS BIGINT)",
}
_ASM = {
    "chrom": "CAST(s_nationkey AS STRING)", "window_start": "CAST(s_suppkey AS BIGINT)", "window_end": "CAST(s_suppkey + 99 AS BIGINT)", "asm_breakpoint_source": "CASE s_suppkey % 5 WHEN 0 THEN 'disease' WHEN 1 THEN 'control' WHEN 2 THEN 'none' END",
    "asm_consensus_breakpoint_pos": "CAST(CASE WHEN s_suppkey % 7 > 1 THEN s_suppkey + 33 END AS BIGINT)", "asm_tsd_seq": "CASE WHEN s_suppkey % 4 > 0 THEN 'TTGCA' END", "asm_tsd_len": "CAST(s_suppkey % 9 AS BIGINT)", "asm_polyA_max_run": "CAST(CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 25 END AS BIGINT)",
    "asm_insertion_orientation": "CASE s_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '?' END", "asm_insertion_length": "CAST(CASE WHEN s_suppkey % 8 > 0 THEN 6000 - s_suppkey % 100 END AS BIGINT)", "asm_insertion_mei_start": "CAST(s_suppkey % 3 AS BIGINT)", "asm_insertion_mei_end": "CAST(s_suppkey % 500 AS BIGINT)",
    "asm_disease_primary_contig_id": "CASE WHEN s_suppkey % 2 = 0 THEN 'c1' END", "asm_control_primary_contig_id": "CASE WHEN s_suppkey % 3 = 0 THEN 'c2' ELSE '' END",
    "asm_disease_recruited_evidence_read_names": "concat(CAST(s_suppkey % 11 AS STRING), ', ', CAST(s_suppkey % 5 AS STRING), ',,3,3')", "asm_control_recruited_evidence_read_names": "concat('1,2,', CAST(s_suppkey % 9 AS STRING))",
}
_READS = {
    "chrom": "CAST(s_nationkey AS STRING)", "window_start": "CAST(s_suppkey AS BIGINT)", "window_end": "CAST(s_suppkey + 99 AS BIGINT)", "sample": "CASE WHEN l_linenumber % 2 = 0 THEN 'disease' ELSE 'control' END",
    "read_name": "CASE WHEN l_partkey % 13 = 12 THEN '  ' ELSE CAST(l_partkey % 13 AS STRING) END", "clip_side": "CASE l_orderkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'R' ELSE '' END", "pos": "CAST(CASE WHEN l_orderkey % 7 > 0 THEN s_suppkey + l_orderkey % 90 END AS BIGINT)",
}
_JOINED = "lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.selectExpr(*[f"{e} AS {n}" for n, e in _READS.items()])


def _varchar(text: str) -> str:
    return text.replace("STRING", "VARCHAR")


_K = "chrom, window_start, window_end"


@_query(_varchar(f"""
WITH {_sql('p', 'supplier', _LOCUS)}, {_sql('a', '(SELECT * FROM supplier WHERE s_suppkey % 10 < 8)', _ASM)},
j AS (SELECT p.*, a.* EXCLUDE ({_K}), coalesce(asm_breakpoint_source IN ('disease', 'control'), false) AS found, coalesce(asm_breakpoint_source IN ('disease', 'control') AND asm_tsd_len >= 4, false) AS tsd FROM p LEFT JOIN a USING ({_K}))
SELECT {_K}, CASE WHEN found AND asm_consensus_breakpoint_pos IS NOT NULL THEN asm_consensus_breakpoint_pos ELSE insertion_breakpoint_pos END AS insertion_breakpoint_pos, CASE WHEN found THEN asm_breakpoint_source ELSE breakpoint_evidence_source END AS breakpoint_evidence_source,
  CASE WHEN tsd AND coalesce(asm_tsd_seq, '') <> '' THEN asm_tsd_seq ELSE coalesce(tsd_seq, '') END AS tsd_seq, CASE WHEN tsd THEN asm_tsd_len ELSE tsd_len_estimate END AS tsd_len_estimate, CASE WHEN tsd THEN asm_tsd_len ELSE tsd_len_estimate END >= 4 AS tsd_detected,
  greatest(CASE WHEN found AND asm_polyA_max_run IS NOT NULL THEN asm_polyA_max_run ELSE poly_at_max_run END, poly_at_max_run) AS poly_at_max_run, CASE WHEN found AND asm_insertion_length IS NOT NULL THEN asm_insertion_length ELSE insertion_mei_span END AS insertion_mei_span,
  CASE WHEN found AND asm_insertion_orientation IN ('+', '-') THEN asm_insertion_orientation ELSE insertion_orientation END AS insertion_orientation,
  CASE WHEN asm_breakpoint_source = 'disease' AND asm_insertion_mei_start > 0 THEN asm_insertion_mei_start ELSE disease_insertion_mei_start END AS disease_insertion_mei_start,
  CASE WHEN asm_breakpoint_source = 'control' AND asm_insertion_mei_end > 0 THEN asm_insertion_mei_end ELSE control_insertion_mei_end END AS control_insertion_mei_end FROM j"""))
def q_assembly_overrides(spark, sf_dir):
    assembled = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 < 8").selectExpr(*[f"{e} AS {n}" for n, e in _ASM.items()])
    shown = ("insertion_breakpoint_pos", "breakpoint_evidence_source", "tsd_seq", "tsd_len_estimate", "tsd_detected", "poly_at_max_run", "insertion_mei_span", "insertion_orientation", "disease_insertion_mei_start", "control_insertion_mei_end")
    return refine.assembly_overrides(_columns(spark, sf_dir, "supplier", _LOCUS), assembled).select(*KEY, *shown)


@_query(_varchar(f"""
WITH {_sql('p', 'supplier', _LOCUS)}, {_sql('a', 'supplier', _ASM)}, {_sql('r', _JOINED, _READS)},
n AS (SELECT DISTINCT {_K}, sample, trim(x) AS read_name FROM (SELECT {_K}, 'disease' AS sample, unnest(string_split(asm_disease_recruited_evidence_read_names, ',')) AS x FROM a WHERE coalesce(asm_disease_primary_contig_id, '') <> ''
  UNION ALL SELECT {_K}, 'control', unnest(string_split(asm_control_recruited_evidence_read_names, ',')) FROM a WHERE coalesce(asm_control_primary_contig_id, '') <> '') WHERE trim(x) <> ''),
b AS (SELECT {_K}, CASE WHEN insertion_breakpoint_pos > 0 THEN insertion_breakpoint_pos ELSE (window_start + window_end) // 2 END AS bp FROM p),
s AS (SELECT r.*, CASE WHEN upper(left(clip_side, 1)) IN ('L', 'R') THEN upper(left(clip_side, 1)) WHEN coalesce(pos, bp) <= bp THEN 'L' ELSE 'R' END AS k FROM r JOIN n USING ({_K}, sample, read_name) JOIN b USING ({_K})),
c AS (SELECT {_K}, {', '.join(f"count(DISTINCT read_name) FILTER (sample = '{s}' AND k = '{k}') AS {s}_{k}" for s in ('disease', 'control') for k in 'LR')} FROM s GROUP BY ALL)
SELECT {_K}, {', '.join(f"coalesce({s}_{k}, 0) AS {s}_sr_{k.lower()}_post_asm" for s in ('disease', 'control') for k in 'LR')} FROM p LEFT JOIN c USING ({_K})"""))
def q_post_assembly_counts(spark, sf_dir):
    return refine.post_assembly_counts(_columns(spark, sf_dir, "supplier", _LOCUS), _columns(spark, sf_dir, "supplier", _ASM), _reads(spark, sf_dir))


@_query(_varchar(f"""
WITH {_sql('r', _JOINED, _READS)}
SELECT {_K}, string_agg(DISTINCT trim(read_name), ',' ORDER BY trim(read_name)) AS read_names, count(DISTINCT trim(read_name)) AS n_reads FROM r WHERE trim(read_name) <> '' GROUP BY ALL"""))
def q_locus_read_names(spark, sf_dir):
    return refine.locus_read_names(_reads(spark, sf_dir)).withColumn("read_names", F.array_join("read_names", ","))


@_query("SELECT CAST(floor(median(greatest(50, o_orderkey % 400))) AS BIGINT) AS span FROM orders")
def q_median_span(spark, sf_dir):
    o = F.col("o_orderkey")
    return refine.median_span(table(spark, sf_dir, "orders").select(o.alias("window_start"), (o + o % 400 - 1).alias("window_end")))


@_query("SELECT o_orderkey FROM orders WHERE (o_custkey % 10 = 3 AND o_orderkey * 3 + 50 >= 1000 AND o_orderkey * 3 <= 20000) OR (o_custkey % 10 = 3 AND o_orderkey * 3 + 50 >= 15000 AND o_orderkey * 3 <= 30000) OR o_custkey % 10 = 5")
def q_region_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("chrom"), (F.col("o_orderkey") * 3).alias("pos"), (F.col("o_orderkey") * 3 + 50).alias("ref_end"))
    return refine.in_regions(rows, ["3:1,000-20,000", " 3:15000-30000 ", "5"]).select("o_orderkey")


@_query("""
WITH v AS (SELECT p_partkey, p_partkey % 25 AS c, p_partkey * 7 AS pos, CASE p_partkey % 6 WHEN 0 THEN '.' WHEN 1 THEN 'x-INS-' || p_partkey WHEN 2 THEN 'y:ins' || p_partkey WHEN 3 THEN 'del' || p_partkey WHEN 4 THEN 'a_INS' ELSE '' END AS id,
  CASE p_partkey % 5 WHEN 0 THEN 'Alu' WHEN 1 THEN 'L1HS' WHEN 2 THEN 'SVA_D' WHEN 3 THEN 'HERVK' END AS fam, p_size FROM part)
SELECT 'chr' || c AS chrom, pos - 1 AS start0, greatest(pos, CASE WHEN p_size % 3 = 0 THEN pos + p_size ELSE pos + 1 END) AS end0, id, CASE WHEN p_size % 2 = 0 THEN 'solo' ELSE 'INS' END AS event_type, fam AS subfamily,
  CASE WHEN fam = 'Alu' THEN 'ALU' WHEN fam = 'SVA_D' THEN 'SVA' ELSE 'LINE1' END AS family, CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size END AS ins_len, 1 AS tsd_len, p_size % 2 AS not_canonical
FROM v WHERE fam IN ('Alu', 'L1HS', 'SVA_D') AND p_partkey % 6 IN (1, 2, 4)""")
def q_long_read_catalog(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 6 == 0, ".").when(k % 6 == 1, F.concat(F.lit("x-INS-"), k)).when(k % 6 == 2, F.concat(F.lit("y:ins"), k)).when(k % 6 == 3, F.concat(F.lit("del"), k)).when(k % 6 == 4, "a_INS").otherwise("")
    fam = F.when(k % 5 == 0, "Alu").when(k % 5 == 1, "L1HS").when(k % 5 == 2, "SVA_D").when(k % 5 == 3, "HERVK")
    pairs = {"FAM_N": fam, "END": F.when(n % 3 == 0, (k * 7 + n).cast("string")), "ITYPE_N": F.when(n % 2 == 0, "solo"), "INS_LEN": F.when(n % 4 != 0, (-n).cast("string")), "NOT_CANONICAL": F.when(n % 2 == 1, "")}
    info = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in pairs.items()]), lambda x: x["value"].isNotNull()))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), k % 25).alias("chrom"), (k * 7).alias("pos"), name.alias("id"), F.lit("AC").alias("ref"), info.alias("info"))
    return refine.long_read_catalog(rows).drop("polya_len", "conformation")


_W = "'GGCATTACGTTAGCCATGACCTGATTGCAACGGT'"
_CLIP = {"locus": "CAST(l_suppkey AS BIGINT)", "sample": "CASE WHEN l_linenumber % 2 = 0 THEN 'disease' ELSE 'control' END", "clip_side": "CASE WHEN l_orderkey % 2 = 0 THEN 'L' ELSE 'R' END", "bp": "CAST(100 + l_suppkey % 3 AS BIGINT)",
         "clip_seq": f"concat(CASE l_partkey % 3 WHEN 0 THEN 'TT' WHEN 1 THEN 'AC' ELSE 'GN' END, substr({_W}, CAST(1 + l_partkey % 20 AS INT), CAST(5 + l_suppkey % 6 AS INT)), CASE l_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'CA' ELSE '' END)"}


@_query(f"""
WITH {_sql('c', 'lineitem', _CLIP)}, d AS (SELECT *, row_number() OVER () AS id FROM c),
t AS (SELECT d.*, n, CASE WHEN clip_side = 'L' THEN right(clip_seq, n) ELSE left(clip_seq, n) END AS motif FROM d, range(4, 31) r(n) WHERE n <= length(clip_seq)),
u AS (SELECT DISTINCT motif, n FROM t WHERE NOT contains(motif, 'N')),
m AS (SELECT motif, min({{'mm': mm, 'dist': abs(i - 15)}}) AS b FROM (SELECT motif, i, hamming(substr({_W}, CAST(i + 1 AS INT), CAST(n AS INT)), motif) AS mm FROM u, range(0, 34) x(i) WHERE i <= 34 - n) WHERE mm <= 1 GROUP BY motif),
v AS (SELECT locus, sample, clip_side, bp, n, b, id, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM t JOIN m USING (motif)),
w AS (SELECT locus, CASE WHEN clip_side = 'L' THEN bp ELSE bp - n + 1 END AS left_, CASE WHEN clip_side = 'L' THEN bp + n - 1 ELSE bp END AS right_, n, sample, clip_side,
  'tsd_' || sample || '_' || clip_side || CASE WHEN b.mm = 0 THEN '_clip_exact_rescue' ELSE '_clip_near_exact_rescue' END AS source, count(*) AS votes, min(b) AS b FROM v WHERE k = 1 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY n DESC, votes DESC, b, sample DESC, clip_side) AS k FROM w WHERE votes >= 2)
SELECT locus, CAST(left_ AS BIGINT) AS "left", CAST(right_ AS BIGINT) AS "right", CAST(n AS BIGINT) AS length, source FROM z WHERE k = 1""")
def q_clip_exact_tsd(spark, sf_dir):
    clips = _columns(spark, sf_dir, "lineitem", _CLIP).select(F.lit("1").alias("chrom"), F.col("locus").alias("window_start"), F.col("locus").alias("window_end"), "sample", "clip_side", "bp", F.lit("+").alias("orientation"), "clip_seq")
    loci = clips.select(*KEY).distinct().select(*KEY, F.expr(_W).alias("window_seq"), F.lit(15).alias("centre"))
    return refine.clip_exact_tsd(loci, clips).select(F.col("window_start").alias("locus"), "left", "right", "length", "source")


_VARIANT = {
    "p_partkey": "p_partkey", "chrom": "concat(CASE WHEN p_partkey % 2 = 0 THEN 'chr' ELSE '' END, CASE p_size % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'MT' WHEN 2 THEN 'X' WHEN 3 THEN 'Un_7' WHEN 4 THEN '23' ELSE CAST(p_size AS STRING) END)",
    "pos": "CAST(p_partkey * 3 AS BIGINT)", "ref": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE substr('ACGTACGT', 1, CAST(p_size % 8 AS INT)) END",
    "info": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '.' WHEN 2 THEN concat('END=', CAST(p_size * 40 AS STRING), ';A=1;END=7') WHEN 3 THEN 'A=1;XEND=5' WHEN 4 THEN concat('A=1;END=', CAST(p_partkey * 3 + 9 AS STRING)) ELSE 'END=x;B' END",
    "header": "concat(CASE WHEN p_size % 2 = 0 THEN 'L1HS' ELSE 'L1PA2' END, CASE p_partkey % 5 WHEN 0 THEN '_3end' WHEN 1 THEN '_ORF2' WHEN 2 THEN '_short_' WHEN 3 THEN '_5end_short' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '#LINE/L1_3end' ELSE '' END)",
}
_VARIANT_SQL = _sql("v", "part", _VARIANT).replace("AS STRING)", "AS VARCHAR)")
_END_SQL = "CAST(greatest(coalesce(TRY_CAST(regexp_extract(concat(';', coalesce(info, '')), ';END=([^;]*)', 1) AS BIGINT), pos + greatest(length(coalesce(ref, '')), 1) - 1), pos) AS BIGINT)"


@_query(f"""
WITH {_VARIANT_SQL}, e AS (SELECT *, {_END_SQL} AS end_pos, replace(chrom, 'chr', '') AS core FROM v)
SELECT p_partkey, end_pos, CASE WHEN coalesce(info, '') IN ('', '.') THEN 'END=' || (end_pos + 5) WHEN regexp_matches(info, '(^|;)END=') THEN regexp_replace(info, '(^|;)END=[^;]*', '\\1END=' || (end_pos + 5)) ELSE info || ';END=' || (end_pos + 5) END AS info_lifted,
  CASE WHEN TRY_CAST(core AS INT) BETWEEN 1 AND 22 THEN CAST(core AS INT) WHEN core = 'X' THEN 23 WHEN core = 'Y' THEN 24 WHEN core IN ('M', 'MT') THEN 25 ELSE 1000 END AS contig_rank,
  CASE WHEN chrom LIKE 'chr%' THEN chrom WHEN chrom IN ('M', 'MT') THEN 'chrM' ELSE 'chr' || chrom END AS chrom_prefixed, CASE WHEN chrom = 'chrM' THEN 'MT' ELSE core END AS chrom_bare,
  regexp_replace(regexp_replace(split_part(header, '#', 1), '_(3end|5end|orf2)$', '', 'i'), '_short_?$', '', 'i') AS element
FROM e""")
def q_variant_fields(spark, sf_dir):
    c, end = F.col, variants.vcf_end(F.col("pos"), F.col("ref"), F.col("info"))
    styled = {f"chrom_{k}": variants.lifted_style(c("chrom"), F.lit(k == "prefixed")) for k in ("prefixed", "bare")}
    found = {"end_pos": end, "info_lifted": variants.with_vcf_end(c("info"), end + 5), "contig_rank": variants.vcf_order(c("chrom"))["rank"], "element": variants.panel_element(c("header"))}
    return _columns(spark, sf_dir, "part", _VARIANT).select("p_partkey", *[e.alias(n) for n, e in (found | styled).items()])


@_query(f"""
WITH {_VARIANT_SQL}, {_sql('n', 'customer', _NAMES).replace('STRING', 'VARCHAR')}
SELECT 'variant' AS kind, p_partkey AS id, regexp_replace(regexp_replace(split_part(header, '#', 1), '_(3end|5end|orf2)$', '', 'i'), '_short_?$', '', 'i') AS text, {_END_SQL} AS number, 0.0 AS share FROM v
UNION ALL SELECT 'read', c_custkey, {_CANON.format('raw')}, CAST(coalesce(list_max(list_transform(regexp_extract_all(upper(raw), 'A+|T+'), lambda x: length(x))), 0) AS BIGINT), length(regexp_replace(upper(raw), '[^AT]', '', 'g')) / length(raw) FROM n""")
def q_sql_functions(spark, sf_dir):
    """The registered functions, called from SQL text."""
    register.register(spark)
    _columns(spark, sf_dir, "part", _VARIANT).createOrReplaceTempView("mobilome_variants")
    _columns(spark, sf_dir, "customer", _NAMES).createOrReplaceTempView("mobilome_names")
    return spark.sql("""SELECT 'variant' AS kind, p_partkey AS id, panel_element(header) AS text, vcf_end(pos, ref, info) AS number, 0D AS share FROM mobilome_variants
        UNION ALL SELECT 'read', c_custkey, canonical_read_name(raw), CAST(poly_at_run(upper(raw)) AS BIGINT), poly_at_fraction(upper(raw)) FROM mobilome_names""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
