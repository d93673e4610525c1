"""Queries of the annotation stage, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome_spark.operators import annotate, breakpoints, calls, context, contigs, review, support
from mobilome_spark.operators.loci import KEY
from mobilome_spark.plans.projections import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(build):
        _QUERIES[build.__name__] = build
        if sql is not None:
            _ORACLES[build.__name__] = sql
        return build

    return add


#: Aligned clips and mates from ``lineitem``; both engines read these expressions.
_HIT = {
    "chrom": "l_returnflag", "window_start": "CAST(l_suppkey * 1000 AS BIGINT)", "window_end": "CAST(l_suppkey * 1000 + 99 AS BIGINT)", "sample": "CASE WHEN l_orderkey % 2 = 0 THEN 'disease' ELSE 'control' END",
    "clip_side": "CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END", "read_name": "CAST(l_orderkey % 97 AS BIGINT)", "pos": "CAST(l_suppkey * 1000 + l_partkey % 100 AS BIGINT)", "score": "l_quantity",
    "family": "CASE l_partkey % 3 WHEN 0 THEN 'ALU' WHEN 1 THEN 'LINE1' ELSE 'SVA' END", "target": "concat(CASE l_partkey % 3 WHEN 0 THEN 'ALU' WHEN 1 THEN 'LINE1' ELSE 'SVA' END, CASE WHEN l_orderkey % 5 < 2 THEN '_a' ELSE '_b' END)",
    "strand": "CASE WHEN l_partkey % 4 = 0 THEN '-' ELSE '+' END", "alnlen": "CAST(12 + l_partkey % 50 AS BIGINT)", "target_len": "CAST(280 + l_suppkey % 50 AS BIGINT)", "target_start": "CAST(1 + l_partkey % 211 AS BIGINT)",
    "target_end": "CAST(13 + l_partkey % 211 + l_partkey % 50 AS BIGINT)", "mapq": "CAST(l_partkey % 61 AS BIGINT)", "qcov": "CAST(30 + l_orderkey % 71 AS DOUBLE) / 100", "pid": "CAST(70 + l_partkey % 31 AS DOUBLE) / 100",
    "clip_seq": "CASE WHEN l_orderkey % 6 = 0 THEN 'CGAAAAAAAAAACG' ELSE 'ACGTTGCA' END", "template_len": "CAST(l_partkey % 900 - 300 AS BIGINT)", "kind": "CASE WHEN l_linenumber = 1 THEN 'indel' WHEN l_linenumber < 4 THEN 'split' ELSE 'discordant' END",
    "discordant_reasons": "CASE l_partkey % 5 WHEN 0 THEN 'interchrom' WHEN 1 THEN 'improper_pair,large_insert' WHEN 2 THEN 'mate_unmapped' ELSE 'same_strand' END",
}
_HIT_SQL = "h AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _HIT.items()) + " FROM lineitem)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _HIT.items()])


_K = "chrom, window_start, window_end"


def _top_sql(column: str, keys: str, source: str = "h") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, {column}) AS n, s / sum(s) OVER (PARTITION BY {keys}) AS p FROM (SELECT {keys}, {column}, sum(score) AS s FROM {source} GROUP BY ALL)) WHERE n = 1)"


@_query(f"""
WITH {_HIT_SQL},
b AS (SELECT {_K}, sample, clip_side, count(DISTINCT read_name) AS mei_supported_reads, sum(score) AS mei_score_sum, max(alnlen) AS mei_anchor_bp_max, count(DISTINCT CASE WHEN clip_seq LIKE '%AAAAAAAA%' THEN read_name END) AS poly_at_reads,
      round(avg(CASE WHEN clip_seq LIKE '%AAAAAAAA%' THEN 1.0 ELSE 0.0 END), 6) AS poly_at_fraction, CAST(max(CASE WHEN clip_seq LIKE '%AAAAAAAA%' THEN 10 ELSE 2 END) AS BIGINT) AS poly_at_max_run FROM h GROUP BY ALL),
f AS {_top_sql("family", f"{_K}, sample, clip_side")}, t AS {_top_sql("target", f"{_K}, sample, clip_side")},
p AS (SELECT {_K}, sample, clip_side, pos, count(DISTINCT read_name) AS c FROM h GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY {_K}, sample, clip_side ORDER BY c DESC, pos) AS n, count(*) OVER (PARTITION BY {_K}, sample, clip_side) AS u FROM p),
r AS (SELECT *, qcov >= 0.9 AND pid >= 0.9 AND alnlen >= 40 AS rep FROM h WHERE clip_seq NOT LIKE '%AAAAAAAA%'),
g AS (SELECT *, (mapq >= 20 OR rep) AND qcov >= 0.6 AND pid >= 0.85 AND alnlen >= 25 AS st FROM r WHERE (mapq >= 10 OR rep) AND qcov >= 0.35 AND pid >= 0.75 AND alnlen >= 15),
w AS (SELECT * FROM (SELECT *, bool_or(st) OVER (PARTITION BY sample, clip_side) AS a FROM g) WHERE st OR NOT a),
e AS (SELECT {_K}, w.sample, w.clip_side, min(target_start) AS s, max(target_end) AS e FROM w JOIN t USING ({_K}, sample, clip_side) WHERE w.target = t.target GROUP BY ALL)
SELECT {_K}, sample, clip_side, mei_supported_reads, mei_score_sum, f.family AS mei_family, t.target AS mei_subfamily, coalesce(e.s, 0) AS mei_start, coalesce(e.e, 0) AS mei_end, mei_anchor_bp_max, round(t.p, 6) AS mei_subfamily_purity,
  m.pos AS mei_breakpoint_mode, round(m.c / mei_supported_reads, 6) AS mei_breakpoint_mode_fraction, m.u AS mei_breakpoint_unique_positions, poly_at_reads, poly_at_fraction, poly_at_max_run
FROM b JOIN f USING ({_K}, sample, clip_side) JOIN t USING ({_K}, sample, clip_side) JOIN m USING ({_K}, sample, clip_side) LEFT JOIN e USING ({_K}, sample, clip_side) WHERE m.n = 1""")
def q_side_metrics(spark, sf_dir):
    out = support.side_metrics(_hits(spark, sf_dir))
    shown = ("mei_supported_reads", "mei_score_sum", "mei_family", "mei_subfamily", "mei_start", "mei_end", "mei_anchor_bp_max", "mei_breakpoint_mode", "mei_breakpoint_unique_positions", "poly_at_reads")
    return out.select(*support.SIDE, *shown, F.col("poly_at_max_run").cast("bigint"), *[F.round(c, 6).alias(c) for c in ("mei_subfamily_purity", "mei_breakpoint_mode_fraction", "poly_at_fraction")])


_SIDED_SQL = "s AS (SELECT *, CASE WHEN pos <= (window_start + window_end) // 2 THEN 'L' ELSE 'R' END AS side, (target_start + target_end) // 2 AS mid FROM h)"


@_query(f"""
WITH {_HIT_SQL}, {_SIDED_SQL},
f AS (SELECT *, [contains(discordant_reasons, x) FOR x IN ['mate_unmapped', 'interchrom', 'large_insert', 'same_strand', 'improper_pair']] AS r FROM s)
SELECT {_K}, sample, side, count(DISTINCT read_name) AS unique_reads, round(avg(mapq), 6) AS mapq_mean,
  round(greatest(avg(r[1]::INT), avg(r[2]::INT), avg(r[3]::INT), avg(r[4]::INT), avg(r[5]::INT), avg((r[1] OR r[2] OR r[3])::INT)), 6) AS complex_reason_max_fraction FROM f GROUP BY ALL""")
def q_anchor_sides(spark, sf_dir):
    return support.anchor_sides(_hits(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mapq_mean", "complex_reason_max_fraction")})


def _rank_sql(c: str) -> str:
    return f"rank() OVER (PARTITION BY {_K}, sample, side ORDER BY {c}) + (count(*) OVER (PARTITION BY {_K}, sample, side, {c}) - 1) / 2.0::DOUBLE"


@_query(f"""
WITH {_HIT_SQL}, {_SIDED_SQL},
sd AS (SELECT sample, greatest(50.0, stddev_pop(abs(template_len))) AS sd FROM s GROUP BY sample),
a AS (SELECT {_K}, sample, side, count(DISTINCT read_name) AS reads, quantile_cont(mid, 0.5) AS med FROM s GROUP BY ALL),
bx AS (SELECT {_K}, sample, side, max(c) / sum(c) AS b FROM (SELECT {_K}, sample, side, pos // 10 AS k, count(DISTINCT read_name) AS c FROM s GROUP BY ALL) GROUP BY ALL),
bt AS (SELECT {_K}, sample, side, max(c) / sum(c) AS b FROM (SELECT {_K}, sample, side, mid // 25 AS k, count(DISTINCT read_name) AS c FROM s GROUP BY ALL) GROUP BY ALL),
rk AS (SELECT {_K}, sample, side, {_rank_sql("pos")} AS x, {_rank_sql("mid")} AS y FROM s),
sp AS (SELECT {_K}, sample, side, CASE WHEN count(*) < 3 THEN 1.0 WHEN var_pop(x) * var_pop(y) <= 1e-9 THEN 0.0 ELSE abs(corr(x, y)) END AS r FROM rk GROUP BY ALL),
dd AS (SELECT DISTINCT {_K}, sample, side, pos, mid FROM s),
sw AS (SELECT {_K}, sample, side, least(abs((mid - lag(mid) OVER w) - (pos - lag(pos) OVER w)), abs((mid - lag(mid) OVER w) + (pos - lag(pos) OVER w))) AS v FROM dd WINDOW w AS (PARTITION BY {_K}, sample, side ORDER BY pos, mid)),
jv AS (SELECT {_K}, sw.sample, side, coalesce(bool_or(v > 3 * sd), false) AS j FROM sw JOIN sd USING (sample) GROUP BY ALL),
u AS (SELECT {_K}, sample, side, a.reads, a.med, bx.b AS bx, bt.b AS bt, r, j FROM a JOIN bx USING ({_K}, sample, side) JOIN bt USING ({_K}, sample, side) JOIN sp USING ({_K}, sample, side) JOIN jv USING ({_K}, sample, side)),
o AS (SELECT {_K}, sample, coalesce(max(reads) FILTER (side = 'L'), 0) AS lr, coalesce(max(reads) FILTER (side = 'R'), 0) AS rr, coalesce(max(med) FILTER (side = 'L'), 0.0) AS lm, coalesce(max(med) FILTER (side = 'R'), 0.0) AS rm,
      CASE WHEN count(*) = 2 THEN min(least(bx, bt)) ELSE 0.0 END AS co, CASE WHEN count(*) = 2 THEN min(r) ELSE 0.0 END AS sr, bool_or(j) AS j FROM u GROUP BY ALL),
f AS {_top_sql("family", f"{_K}, sample")}, d AS {_top_sql("strand", f"{_K}, sample")},
n AS (SELECT {_K}, sample, count(DISTINCT read_name) AS supported_reads FROM s GROUP BY ALL)
SELECT {_K}, sample, supported_reads, lr AS left_supported_reads, rr AS right_supported_reads, f.family, round(f.p, 6) AS family_purity, d.strand, round(lm, 6) AS left_target_pos_median, round(rm, 6) AS right_target_pos_median,
  round(co, 6) AS side_coherence_min, round(sr, 6) AS anchor_target_spearman_abs_min, j AS any_local_jump_violation,
  lr >= 1 AND rr >= 1 AND ((d.strand = '+' AND rm >= lm) OR (d.strand = '-' AND lm >= rm)) AND abs(rm - lm) + 1 BETWEEN 30 AND 8000 AS geometry_consistent,
  NOT j AND (least(lr, rr) < 3 OR co >= 0.5 OR sr >= 0.6) AS self_consistent
FROM o JOIN f USING ({_K}, sample) JOIN d USING ({_K}, sample) JOIN n USING ({_K}, sample)""")
def q_discordant_support(spark, sf_dir):
    out = support.discordant_support(_hits(spark, sf_dir))
    plain = ("supported_reads", "left_supported_reads", "right_supported_reads", "family", "strand", "any_local_jump_violation", "geometry_consistent", "self_consistent")
    return out.select(*KEY, "sample", *plain, *[F.round(c, 6).alias(c) for c in ("family_purity", "left_target_pos_median", "right_target_pos_median", "side_coherence_min", "anchor_target_spearman_abs_min")])


_COUNTS_SQL = ", ".join(
    f"count(DISTINCT CASE WHEN sample = '{s}' AND {m} THEN read_name END) AS {s[0]}_{n}"
    for s in ("disease", "control")
    for n, m in {
        **{f"{t}_{k}_{c}": f"{w} AND side = '{c}' AND {u}" for t, u in (("raw", "true"), ("strict", "tell")) for k, w in (("sr", "kind <> 'discordant'"), ("dpe", "kind = 'discordant'")) for c in "LR"},
        "mei": "mei", "ms": "mei AND kind = 'split'", "md": "mei AND kind = 'discordant'", "ts": "tail AND kind <> 'discordant'", "sr": "kind <> 'discordant'", "dpe": "kind = 'discordant'",
    }.items()
)


def _support_sql(s: str, o: str) -> str:
    strict = f"({o}_mei > 0 AND ({s}_mei = 0 OR ({s}_ms = 0 AND {s}_ts = 0 AND {s}_md <= 2) OR ({s}_sr = 0 AND {s}_dpe <= 2 AND {s}_ts = 0)))"
    parts = " || ',' || ".join(f"'{k.upper()}_{c}=' || CASE WHEN {s}_mei + {o}_mei = 0 THEN 0 WHEN {strict} THEN {s}_strict_{k}_{c} ELSE {s}_raw_{k}_{c} END" for k in ("sr", "dpe") for c in "LR")
    return f"{parts} || ',MEI_MAPPED=' || {s}_mei"


@_query(f"""
WITH {_HIT_SQL}, s0 AS (SELECT h.*, CASE WHEN pos <= (window_start + window_end) // 2 THEN 'L' ELSE 'R' END AS side, score > 44 AND (sample = 'disease' OR window_start % 3 = 0) AS mei, clip_seq LIKE '%AAAAAAAA%' AND mapq > 50 AS tail FROM h),
s AS (SELECT *, bool_or(mei OR tail OR kind = 'indel') OVER (PARTITION BY {_K}, sample, read_name) AS tell FROM s0),
c AS (SELECT {_K}, {_COUNTS_SQL} FROM s GROUP BY ALL)
SELECT {_K}, {_support_sql("d", "c")} AS disease_supporting_reads, {_support_sql("c", "d")} AS control_supporting_reads FROM c""")
def q_support_counts(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumn("side", support.anchor_side(F.col("pos")))
    mei = (F.col("score") > 44) & ((F.col("sample") == "disease") | (F.col("window_start") % 3 == 0))
    rows = rows.withColumns({"mei": mei, "tail": F.contains("clip_seq", F.lit("AAAAAAAA")) & (F.col("mapq") > 50)})
    return support.support_counts(rows).select(*KEY, "disease_supporting_reads", "control_supporting_reads")


#: Loci from ``orders``: the metrics that the score and the stages read, spread over all their cases.
_LOCUS = {
    "chrom": "o_orderpriority", "window_start": "CAST(o_orderkey * 10 AS BIGINT)", "window_end": "CAST(o_orderkey * 10 + 99 AS BIGINT)", "disease_L_mei_supported_reads": "o_orderkey % 4", "disease_R_mei_supported_reads": "o_custkey % 4",
    "control_L_mei_supported_reads": "o_orderkey % 3", "control_R_mei_supported_reads": "CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END", "disease_L_mei_family": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ALU' ELSE 'SVA' END",
    "disease_R_mei_family": "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ALU' ELSE 'SVA' END", "control_L_mei_family": "CASE WHEN o_custkey % 2 = 0 THEN 'ALU' ELSE '' END", "disease_L_mei_strand": "CASE o_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '+' END",
    "disease_R_mei_strand": "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '+' END", "disease_L_mei_subfamily_purity": "CAST(50 + o_orderkey % 51 AS DOUBLE) / 100", "disease_R_mei_subfamily_purity": "CAST(50 + o_custkey % 51 AS DOUBLE) / 100",
    "disease_L_mei_breakpoint_mode_fraction": "CAST(40 + o_custkey % 61 AS DOUBLE) / 100", "disease_R_mei_breakpoint_mode_fraction": "CAST(40 + o_orderkey % 61 AS DOUBLE) / 100", "disease_discordant_mei_supported_reads": "o_orderkey % 6",
    "disease_discordant_mei_left_supported_reads": "o_orderkey % 3", "disease_discordant_mei_right_supported_reads": "o_orderkey % 2", "disease_discordant_mei_family_purity": "CAST(50 + o_custkey % 50 AS DOUBLE) / 100",
    "disease_discordant_mei_strand_purity": "CASE WHEN o_custkey % 3 = 0 THEN 0.5D0 ELSE 1.0D0 END", "disease_discordant_mei_geometry_consistent": "o_custkey % 4 > 0", "disease_discordant_mei_self_consistent": "o_orderkey % 7 > 0",
    "disease_discordant_anchor_left_unique_reads": "o_custkey % 6", "disease_discordant_anchor_left_complex_reason_max_fraction": "CAST(o_orderkey % 11 AS DOUBLE) / 10", "discordant_disease_large_insert_fraction": "CAST(o_custkey % 11 AS DOUBLE) / 10",
    "discordant_disease_mate_unmapped_fraction": "CAST(o_orderkey % 13 AS DOUBLE) / 13", "discordant_disease_same_strand_fraction": "CAST(o_custkey % 9 AS DOUBLE) / 9", "disease_total_rows": "o_custkey % 40", "disease_L_mei_score_sum": "CAST(o_custkey % 17 AS DOUBLE) / 4",
    "split_disease_mapq_mean": "CAST(o_orderkey % 61 AS DOUBLE)", "tsd_detected": "o_custkey % 3 = 1", "breakpoint_l1_en_motif_like": "o_orderkey % 4 = 1", "breakpoint_yyrrrr_logodds_shift1_mt_adj": "CAST(o_custkey % 13 - 6 AS DOUBLE)",
    "disease_R_poly_at_reads": "o_orderkey % 5", "disease_R_poly_at_fraction": "CAST(o_custkey % 6 AS DOUBLE) / 10", "disease_R_poly_at_max_run": "o_orderkey % 35", "disease_L_clip_overlap_informative_reads": "o_custkey % 5",
    "disease_L_clip_overlap_jaccard_median": "CAST(o_orderkey % 10 AS DOUBLE) / 10", "junk_flag_count": "CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END", "disease_L_mei_breakpoint_mode": "CASE WHEN o_orderkey % 10 = 1 THEN 5 ELSE 0 END",
    "disease_local_bam_peak_depth": "CAST(CASE WHEN o_orderkey % 97 = 0 THEN 900 ELSE 20 + o_custkey % 30 END AS DOUBLE)", "known_mei_polymorphism": "o_custkey % 8 = 0", "disease_L_mei_start": "o_custkey % 90", "disease_L_mei_end": "40 + o_orderkey % 120",
    "disease_R_mei_start": "100 + o_orderkey % 60 - 40 * (o_custkey % 4)", "disease_R_mei_end": "180 + o_custkey % 70", "disease_L_mei_anchor_bp_max": "8 + o_orderkey % 30", "disease_R_mei_anchor_bp_max": "8 + o_custkey % 30", "disease_R_mei_target_len": "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 290 END",
    "disease_supporting_reads": "concat('SR_L=', CAST(o_orderkey % 4 AS STRING), ',SR_R=0,DPE_L=', CAST(o_custkey % 2 AS STRING), ',DPE_R=0,MEI_MAPPED=', CAST(o_orderkey % 9 AS STRING))", "control_supporting_reads": "concat('SR_L=0,SR_R=', CAST(o_custkey % 2 AS STRING), ',DPE_L=0,DPE_R=0,MEI_MAPPED=1')",
    "disease_discordant_mei_two_sided_support": "o_orderkey % 3 >= 1 AND o_orderkey % 2 >= 1", "disease_discordant_mei_left_target_pos_median": "CAST(o_custkey % 300 AS DOUBLE) + 0.5D0", "disease_discordant_mei_right_target_pos_median": "CAST(o_orderkey % 400 AS DOUBLE)", "disease_discordant_mei_strand": "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END",
}
#: The same in the other dialect's literals and types.
_LOCUS_SQL = "l AS (SELECT " + ", ".join(f"{e.replace('D0', '::DOUBLE').replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in _LOCUS.items()) + " FROM orders)"


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*[f"{e.replace('D0', 'D')} AS {n}" for n, e in _LOCUS.items()])
    return calls.insertion_spans(calls.totals(calls.conform(rows, calls.locus_defaults())))


#: Totals, the span of the disease sample (the control has none) and the model's parts, step by step.
_MODEL_SQL = f"""{_LOCUS_SQL},
t AS (SELECT *, disease_L_mei_supported_reads + disease_R_mei_supported_reads AS ds, disease_L_mei_supported_reads + disease_R_mei_supported_reads + disease_discordant_mei_supported_reads AS dm,
  control_L_mei_supported_reads + control_R_mei_supported_reads AS cm, disease_R_poly_at_fraction * disease_R_mei_supported_reads AS pw, least(1.0::DOUBLE, split_disease_mapq_mean / 60) AS mq FROM l),
u AS (SELECT *, (disease_L_mei_breakpoint_mode_fraction * disease_L_mei_supported_reads + disease_R_mei_breakpoint_mode_fraction * disease_R_mei_supported_reads) / greatest(dm, 1) AS mw,
  (disease_L_mei_subfamily_purity * disease_L_mei_supported_reads + disease_R_mei_subfamily_purity * disease_R_mei_supported_reads) / greatest(dm, 1) AS sw, pw / greatest(dm, 1) AS tw, (disease_L_mei_score_sum + 0.1::DOUBLE) / 0.1::DOUBLE AS en,
  CASE WHEN disease_L_mei_family = '' AND disease_R_mei_family = '' THEN 0 WHEN disease_L_mei_family = '' OR disease_R_mei_family = '' THEN 1 ELSE (disease_L_mei_family = disease_R_mei_family)::INT END AS fd, (control_L_mei_family <> '')::INT AS fc,
  CASE WHEN disease_L_mei_strand = '' AND disease_R_mei_strand = '' THEN 0 WHEN disease_L_mei_strand = '' OR disease_R_mei_strand = '' THEN 1 ELSE (disease_L_mei_strand = disease_R_mei_strand)::INT END AS sd FROM t),
v AS (SELECT *, greatest(fd, fc) AS fa, 0.4::DOUBLE * mw + 0.4::DOUBLE * sw + 0.2::DOUBLE * mq AS coherence, CASE WHEN disease_L_clip_overlap_informative_reads >= 2 THEN disease_L_clip_overlap_jaccard_median ELSE 0.0 END AS ov,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, breakpoint_yyrrrr_logodds_shift1_mt_adj / 6)) AS lo, greatest(disease_discordant_mei_left_supported_reads, 0) >= 1 AND disease_discordant_mei_right_supported_reads >= 1 AS two_d,
  disease_L_mei_supported_reads >= 1 AND disease_R_mei_supported_reads >= 1 AS two_s, control_L_mei_supported_reads >= 1 AND control_R_mei_supported_reads >= 1 AS two_c FROM u),
w AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.20 * sw + 0.16 * mw + 0.15 * en / (en + 1) + 0.10 * greatest(least(1.0::DOUBLE, dm / greatest(disease_total_rows, 1)), least(1.0::DOUBLE, cm / 1)) + 0.12 * fa + 0.06 * sd + 0.07 * tsd_detected::INT + 0.05 * tw
    + 0.03 * breakpoint_l1_en_motif_like::INT + 0.02 * lo + 0.08 * ov + 0.05 * mq)) AS score,
  two_d AND disease_discordant_mei_family_purity >= 0.6 AND disease_discordant_mei_strand_purity >= 0.6 AND disease_discordant_mei_geometry_consistent AND disease_discordant_mei_self_consistent AS firm,
  disease_R_mei_supported_reads >= 2 AND disease_R_mei_subfamily_purity >= 0.7 AND disease_R_mei_breakpoint_mode_fraction >= 0.5 AND lc AS pair,
  (disease_L_clip_overlap_informative_reads >= 3 AND ov >= 0.55) OR (disease_L_clip_overlap_informative_reads >= 2 AND ov >= 0.7) AS oa FROM (SELECT *, disease_discordant_anchor_left_unique_reads >= 2 AND disease_discordant_anchor_left_complex_reason_max_fraction >= 0.6 AND disease_discordant_mei_left_supported_reads <= 1 AS lc FROM v)),
x AS (SELECT *, (least(disease_L_mei_supported_reads, disease_R_mei_supported_reads) >= 2) OR (greatest(disease_L_mei_supported_reads, disease_R_mei_supported_reads) >= 2 AND least(disease_L_mei_supported_reads, disease_R_mei_supported_reads) < 2 AND disease_discordant_mei_supported_reads >= 3) OR two_c OR firm AS tl,
  tw >= 0.2 AS simple, oa AND (tsd_detected OR firm) AS resc, junk_flag_count = 0 AND mq >= 0.3 AS clean, greatest(discordant_disease_large_insert_fraction, discordant_disease_mate_unmapped_fraction) >= 0.6 AND dm >= 2 AS sig FROM w),
y AS (SELECT *, score >= 0.60 AND coherence >= 0.55 AND tl AND fa = 1 AND sd = 1 AND least(disease_L_mei_breakpoint_mode_fraction, disease_R_mei_breakpoint_mode_fraction) >= 0.55 AND clean AND (tsd_detected OR tw >= 0.2 OR breakpoint_l1_en_motif_like OR lo >= 0.25) AND (NOT simple OR ov >= 0.2 OR resc) AS high FROM x),
z AS (SELECT *, NOT high AND score >= 0.55 AND coherence >= 0.50 AND (tl OR dm >= 1 OR cm >= 1) AND fa = 1 AND (NOT simple OR ov >= 0.12 OR resc) AS prov FROM y)"""


@_query(f"""
WITH {_MODEL_SQL}
SELECT {_K}, round(score, 9) AS insertion_model_score, round(coherence, 9) AS coherence_score, CASE WHEN high THEN 'high_conf_two_sided' WHEN pair THEN 'mei_with_complex' WHEN prov THEN 'provisional_one_sided' ELSE 'none' END AS insertion_call_tier,
  NOT high AND NOT prov AND pair AND fa = 1 AND sd = 1 AND clean AND score >= 0.5 AND coherence >= 0.45 AS passes_insertion_model_complex, pair OR sig AS complex_mei_event,
  CASE WHEN discordant_disease_large_insert_fraction >= 0.6 OR discordant_disease_mate_unmapped_fraction >= 0.6 THEN concat_ws('+', CASE WHEN discordant_disease_large_insert_fraction >= 0.6 THEN 'large_insert' END, CASE WHEN discordant_disease_mate_unmapped_fraction >= 0.6 THEN 'mate_unmapped' END)
    WHEN discordant_disease_same_strand_fraction >= 0.5 THEN 'same_strand' ELSE 'none' END AS complex_sv_signature_label,
  CASE WHEN disease_supporting_reads NOT LIKE 'SR_L=0,SR_R=0,DPE_L=0,%' AND control_supporting_reads LIKE '%SR_R=1%' THEN 'shared' WHEN disease_supporting_reads NOT LIKE 'SR_L=0,SR_R=0,DPE_L=0,%' THEN 'disease_only' WHEN control_supporting_reads LIKE '%SR_R=1%' THEN 'control_only' ELSE 'low_support' END AS sample_status_label
FROM z""")
def q_model_scores(spark, sf_dir):
    out = calls.model_scores(_loci(spark, sf_dir))
    names = ("insertion_call_tier", "passes_insertion_model_complex", "complex_mei_event", "complex_sv_signature_label", "sample_status_label")
    return out.select(*KEY, *[F.round(c, 9).alias(c) for c in ("insertion_model_score", "coherence_score")], *names)


_SPAN_SQL = """e AS (SELECT *, disease_L_mei_supported_reads >= 1 AND disease_L_mei_start > 0 AND disease_L_mei_end >= disease_L_mei_start AS lo, disease_R_mei_supported_reads >= 1 AND disease_R_mei_start > 0 AND disease_R_mei_end >= disease_R_mei_start AS ro FROM l),
g AS (SELECT *, CASE WHEN lo AND ro AND disease_L_mei_anchor_bp_max >= 15 AND disease_R_mei_anchor_bp_max >= 15 THEN 1 WHEN lo AND disease_L_mei_anchor_bp_max >= 15 AND disease_R_poly_at_reads >= 1 AND disease_R_poly_at_max_run >= 12 AND disease_R_mei_target_len > 0 THEN 2
  WHEN disease_discordant_mei_two_sided_support AND disease_discordant_mei_geometry_consistent AND disease_discordant_mei_right_target_pos_median > 0 AND floor(disease_discordant_mei_left_target_pos_median) > 0 THEN 3 ELSE 0 END AS way FROM e),
sp AS (SELECT *, CAST(CASE way WHEN 1 THEN least(disease_L_mei_start, disease_R_mei_start) WHEN 2 THEN disease_L_mei_start WHEN 3 THEN floor(least(disease_discordant_mei_left_target_pos_median, disease_discordant_mei_right_target_pos_median)) ELSE 0 END AS BIGINT) AS low,
  CAST(CASE way WHEN 1 THEN greatest(disease_L_mei_end, disease_R_mei_end) WHEN 2 THEN greatest(disease_L_mei_end, 290) WHEN 3 THEN floor(greatest(disease_discordant_mei_left_target_pos_median, disease_discordant_mei_right_target_pos_median)) ELSE 0 END AS BIGINT) AS high,
  CASE WHEN disease_L_mei_strand = '' THEN disease_R_mei_strand WHEN disease_R_mei_strand IN ('', disease_L_mei_strand) THEN disease_L_mei_strand ELSE 'mixed' END AS so FROM g)"""


@_query(f"""
WITH {_LOCUS_SQL}, {_SPAN_SQL}
SELECT {_K}, CASE WHEN so IN ('+', '-') THEN so ELSE disease_discordant_mei_strand END AS disease_insertion_orientation, high AS disease_insertion_mei_start, low AS disease_insertion_mei_end, CASE WHEN way = 0 THEN 0 ELSE high - low + 1 END AS disease_insertion_mei_span FROM sp""")
def q_insertion_spans(spark, sf_dir):
    return _loci(spark, sf_dir).select(*KEY, *[f"disease_insertion_{c}" for c in ("orientation", "mei_start", "mei_end", "mei_span")])


_STAGE_SQL = f"""{_MODEL_SQL}, {_SPAN_SQL},
k AS (SELECT z.*, sp.way, CASE WHEN so IN ('+', '-') THEN so ELSE sp.disease_discordant_mei_strand END AS ori FROM z JOIN sp USING ({_K})),
s1 AS (SELECT *, disease_L_mei_supported_reads >= 1 OR disease_discordant_mei_left_supported_reads >= 1 AS dl, disease_R_mei_supported_reads >= 1 OR disease_discordant_mei_right_supported_reads >= 1 AS dr, disease_R_poly_at_reads >= 1 AS pr FROM k),
s2 AS (SELECT *, (dl AND dr) OR two_c AS bi, dl AND pr AND ori = '+' AS side, (dl OR lc) AND (dr OR pr) AND ((dl AND pr) OR (dr AND lc)) AND (pair OR sig) AS cx,
  (((dl AND (dr OR (ori = '+' AND pr))) OR (dr AND dl) OR ((dr AND dl))) AND (fd = 1 OR disease_discordant_mei_family_purity >= 0.95) AND disease_discordant_mei_self_consistent)
    OR (two_c AND fc = 1) AS asym,
  (disease_L_mei_supported_reads >= 1 AND disease_L_mei_breakpoint_mode > 0) OR way > 0 AS res, dm >= 1 OR cm >= 1 AS anym FROM s1),
s3 AS (SELECT *, (two_s AND fd = 1 AND sd = 1) OR (two_d AND disease_discordant_mei_family_purity >= 0.95 AND disease_discordant_mei_strand_purity >= 0.95 AND disease_discordant_mei_geometry_consistent AND disease_discordant_mei_self_consistent)
  OR (fa = 1 AND (sd = 1 OR side)) OR cx OR asym AS cons, bi OR side OR cx OR res OR asym AS sup FROM s2),
s4 AS (SELECT *, junk_flag_count = 0 AND anym AND sup AND (cons OR res) AS silver FROM s3),
m AS (SELECT avg(disease_local_bam_peak_depth) FILTER (silver) AS a, stddev_pop(disease_local_bam_peak_depth) FILTER (silver) AS sg FROM s4),
s5 AS (SELECT s4.*, silver AND NOT known_mei_polymorphism AND disease_local_bam_peak_depth - a >= 3 * sg AND sg > 1e-6 AS deep FROM s4, m)"""


@_query(f"""
WITH {_STAGE_SQL}
SELECT {_K}, CASE WHEN deep THEN 'silver' WHEN silver THEN 'gold' ELSE 'bronze' END AS analysis_stage_tier,
  CASE WHEN deep THEN 'gold:depth_pileup_artifact' WHEN silver THEN '' ELSE concat_ws(';', CASE WHEN junk_flag_count > 0 THEN 'junk_region_flagged' END, CASE WHEN NOT anym THEN 'no_mei_signal' END, CASE WHEN NOT sup THEN 'no_bilateral_or_breakpoint_span_support' END, CASE WHEN NOT (cons OR res) THEN 'no_consistency_signal' END) END AS stage_fail_reason
FROM s5""")
def q_gold_stage(spark, sf_dir):
    return calls.gold_stage(calls.silver_stage(calls.model_scores(_loci(spark, sf_dir)))).select(*KEY, "analysis_stage_tier", "stage_fail_reason")


@_query(f"""
WITH {_STAGE_SQL},
fl AS (SELECT *, NOT known_mei_polymorphism AND coherence < 0.45 AND disease_R_poly_at_max_run >= 30 AND disease_R_poly_at_reads >= 8 AS art, greatest(ds, cm) AS sr, disease_discordant_mei_supported_reads AS dp, greatest(o_mapped, 1) AS mm
  FROM (SELECT *, CAST(regexp_extract(disease_supporting_reads, 'MEI_MAPPED=([0-9]+)', 1) AS BIGINT) AS o_mapped FROM s5)),
rk AS (SELECT *, round_even((0.50::DOUBLE * ln(1 + sr) + 0.35::DOUBLE * ln(1 + dp) + 0.15::DOUBLE * least(1.0::DOUBLE, mm / greatest(sr + dp, 1))) * 1e6, 0) / 1e6 AS pri FROM fl)
SELECT {_K}, round(pri, 6) AS read_support_heuristic_score, row_number() OVER (ORDER BY (silver AND NOT deep) DESC, silver DESC, art, pri DESC, mm DESC, sr DESC, dp DESC, tsd_detected DESC, (disease_R_poly_at_reads > 0 OR disease_R_poly_at_max_run > 0) DESC, ov DESC, round(score, 9) DESC, {_K}) AS priority_rank FROM rk""")
def q_prioritize(spark, sf_dir):
    rows = calls.gold_stage(calls.silver_stage(calls.model_scores(_loci(spark, sf_dir))))
    # sums of doubles may differ in their last digit between engines
    out = calls.prioritize(rows.withColumn("insertion_model_score", F.round("insertion_model_score", 9)))
    return out.select(*KEY, F.round("read_support_heuristic_score", 6).alias("read_support_heuristic_score"), "priority_rank")


_BP = {
    "id": "o_orderkey", "window_start": "CAST(o_orderkey * 10 AS BIGINT)", "window_end": "CAST(o_orderkey * 10 + 99 AS BIGINT)", "tsd_len_estimate": "CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 0 END", "tsd_left_breakpoint": "CASE WHEN o_orderkey % 5 = 0 THEN 700 ELSE 0 END", "tsd_right_breakpoint": "CASE WHEN o_orderkey % 5 = 0 THEN 711 ELSE 0 END",
    "tsd_evidence_source": "CASE WHEN o_orderkey % 5 = 0 THEN 'tsd_disease' ELSE '' END",
    **{f"{s}_{k}_split_breakpoint_mode": f"CASE WHEN {c} % 4 = 0 THEN 0 ELSE {500 if k == 'L' else 510} + {c} % {7 if k == 'L' else 40} END" for s, c in (("disease", "o_orderkey"), ("control", "o_custkey")) for k in "LR"},
    **{f"{s}_{k}_split_breakpoint_support": f"({c} + {1 if k == 'L' else 3}) % 7" for s, c in (("disease", "o_orderkey"), ("control", "o_custkey")) for k in "LR"},
    **{f"{s}_{k}_poly_breakpoint_mode": f"CASE WHEN {c} % 3 = 0 THEN 0 ELSE {495 if k == 'L' else 505} + {c} % 30 END" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey")) for k in "LR"},
    **{f"{s}_{k}_poly_breakpoint_support": f"({c} + {2 if k == 'L' else 0}) % 3" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey")) for k in "LR"},
    **{f"{s}_{k}_mei_breakpoint_mode": f"CASE WHEN {c} % 3 = {1 if k == 'L' else 2} THEN 0 ELSE {500 if k == 'L' else 512} + {c} % 11 END" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey")) for k in "LR"},
    **{f"{s}_{k}_mei_supported_reads": f"{c} % {3 if k == 'L' else 2}" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey")) for k in "LR"},
    **{f"{s}_mei_supported_reads": f"{c} % 2" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey"))}, **{f"{s}_full_mei_supported_reads": "0" for s in ("disease", "control")},
    **{f"{s}_{k}_poly_at_reads": f"CASE WHEN {c} % 6 = {0 if k == 'L' else 1} THEN 2 ELSE 0 END" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey")) for k in "LR"},
    **{f"{k}_{s}_poly_tail_rescued_unique_reads": "0" for s in ("disease", "control") for k in ("split", "discordant")}, **{f"{s}_poly_at_max_run": f"{c} % 12" for s, c in (("disease", "o_custkey"), ("control", "o_orderkey"))},
    "insertion_breakpoint_pos": "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey * 10 + 40 END", "disease_split_mei_supported_reads": "o_custkey % 3", "disease_discordant_mei_supported_reads": "o_orderkey % 2", "control_discordant_mei_supported_reads": "0",
    "discordant_disease_abs_tlen_mean": "CAST(o_orderkey % 1200 AS DOUBLE)", "discordant_control_abs_tlen_mean": "CAST(o_custkey % 900 AS DOUBLE)",
}
_BP_SQL = "b AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BP.items()) + " FROM orders)"


def _gap_sql(s: str, turn: int) -> str:
    p = f"{s}_"
    return f"""SELECT id, {turn} AS t, 0 AS way, -({p}L_split_breakpoint_support + {p}R_split_breakpoint_support) AS a, -({p}L_poly_breakpoint_support + {p}R_poly_breakpoint_support) AS p, {p}L_split_breakpoint_mode AS l, {p}R_split_breakpoint_mode AS r, 'tsd_{s}_split_clip_gap_rescue' AS src
  FROM b WHERE {p}L_split_breakpoint_mode > 0 AND {p}R_split_breakpoint_mode > 0 AND least({p}L_split_breakpoint_support, {p}R_split_breakpoint_support) >= 2 AND {p}L_split_breakpoint_support + {p}R_split_breakpoint_support >= 6 AND greatest(disease_mei_supported_reads, control_mei_supported_reads) >= 1"""


def _bridge_sql(s: str, turn: int, k: str, o: str) -> str:
    p, mine, theirs = f"{s}_", f"{s}_{k}_mei_breakpoint_mode", f"{s}_{o}_poly_breakpoint_mode"
    l, r = (mine, theirs) if k == "L" else (theirs, mine)
    return f"""SELECT id, {turn}, 1, -({p}{k}_mei_supported_reads + {p}{o}_poly_breakpoint_support), 0, {l}, {r}, 'tsd_{s}_{k}_poly_mode_bridge_rescue' FROM b
  WHERE (greatest({p}L_poly_at_reads, {p}R_poly_at_reads) >= 1 OR {p}poly_at_max_run >= 8) AND {l} > 0 AND {r} > 0 AND {p}{k}_mei_supported_reads >= 1 AND {p}{o}_mei_supported_reads <= 1 AND {p}{o}_poly_breakpoint_support >= 1"""


_RESCUES_SQL = " UNION ALL ".join([_gap_sql(s, t) for t, s in enumerate(("disease", "control"))] + [_bridge_sql(s, t, k, o) for t, s in enumerate(("disease", "control")) for k, o in (("L", "R"), ("R", "L"))])


@_query(f"""
WITH {_BP_SQL}, c AS ({_RESCUES_SQL}), d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, t, a, p, l - r, l, r) AS n FROM c WHERE r - l + 1 BETWEEN 4 AND 40),
e AS (SELECT b.*, CASE WHEN tsd_len_estimate >= 4 THEN tsd_left_breakpoint ELSE coalesce(d.l, 0) END AS nl, CASE WHEN tsd_len_estimate >= 4 THEN tsd_right_breakpoint ELSE coalesce(d.r, 0) END AS nr, CASE WHEN tsd_len_estimate >= 4 THEN tsd_evidence_source ELSE coalesce(d.src, '') END AS ns FROM b LEFT JOIN d ON b.id = d.id AND d.n = 1)
SELECT id, CAST(nl AS BIGINT) AS tsd_left_breakpoint, CAST(nr AS BIGINT) AS tsd_right_breakpoint, ns AS tsd_evidence_source,
  CAST(CASE WHEN nl > 0 AND nr > 0 THEN (nl + nr) // 2 WHEN disease_L_mei_breakpoint_mode > 0 AND disease_R_mei_breakpoint_mode > 0 THEN (disease_L_mei_breakpoint_mode + disease_R_mei_breakpoint_mode) // 2
    WHEN control_L_mei_breakpoint_mode > 0 AND control_R_mei_breakpoint_mode > 0 THEN (control_L_mei_breakpoint_mode + control_R_mei_breakpoint_mode) // 2 WHEN control_L_mei_breakpoint_mode > 0 THEN control_L_mei_breakpoint_mode ELSE control_R_mei_breakpoint_mode END AS BIGINT) AS pos,
  CASE WHEN nl > 0 AND nr > 0 THEN ns WHEN disease_L_mei_breakpoint_mode > 0 AND disease_R_mei_breakpoint_mode > 0 THEN 'disease_split' WHEN control_L_mei_breakpoint_mode > 0 AND control_R_mei_breakpoint_mode > 0 THEN 'control_split' WHEN greatest(control_L_mei_breakpoint_mode, control_R_mei_breakpoint_mode) > 0 THEN 'control_single' ELSE '' END AS source FROM e""")
def q_tsd_rescue(spark, sf_dir):
    rows = breakpoints.rescue_tsd(table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _BP.items()])).withColumn("_b", breakpoints.breakpoint_choice())
    return rows.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("tsd_left_breakpoint", "tsd_right_breakpoint")], "tsd_evidence_source", "_b.pos", "_b.source")


@_query(f"""
WITH {_BP_SQL}, m AS (SELECT *, (window_start + window_end) // 2 AS mid, disease_split_mei_supported_reads >= 2 OR (disease_L_mei_supported_reads >= 1 AND disease_R_mei_supported_reads >= 1) AS placed, disease_discordant_mei_supported_reads > 0 AS paired FROM b),
p AS (SELECT *, CASE WHEN (placed OR paired) AND insertion_breakpoint_pos > 0 THEN insertion_breakpoint_pos ELSE mid END AS c, CAST(CASE WHEN placed THEN 200 WHEN paired THEN greatest(1, least(500, greatest(100, round_even(greatest(discordant_disease_abs_tlen_mean, discordant_control_abs_tlen_mean) * 0.5::DOUBLE, 0)))) ELSE 400 END AS BIGINT) AS pad FROM m)
SELECT id, CAST(greatest(1, c - pad) AS BIGINT) AS query_start, CAST(greatest(1, c - pad, c + pad) AS BIGINT) AS query_end FROM p""")
def q_catalog_interval(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _BP.items()]).select("id", *breakpoints.catalog_interval(200, 100, 500, 0.5))


_READ = "CAST(l_suppkey % 10 AS VARCHAR) AS chrom, CAST(l_orderkey * 3 AS BIGINT) AS pos, CAST(l_orderkey * 3 + 80 + l_partkey % 40 AS BIGINT) AS ref_end, CAST(l_partkey % 61 AS BIGINT) AS mapq, CAST(l_linenumber % 4 AS BIGINT) AS nm, CAST(81 + l_partkey % 40 AS BIGINT) AS aligned_len"
_WINDOW = "CAST(o_custkey % 10 AS VARCHAR) AS chrom, CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey * 3 AS BIGINT) AS ws, CAST(o_orderkey * 3 + 50 AS BIGINT) AS we"


@_query(f"""
WITH r AS (SELECT {_READ} FROM lineitem), w AS (SELECT {_WINDOW} FROM orders)
SELECT id, count(*) AS context_non_sv_reads, round(avg(mapq), 6) AS context_mapq_mean, round(avg((mapq < 20)::INT), 6) AS context_mapq_lt20_fraction, round(avg(100.0::DOUBLE * nm / aligned_len), 6) AS context_nm_per_100bp_mean, round(quantile_cont(100.0::DOUBLE * nm / aligned_len, 0.9), 6) AS context_nm_per_100bp_p90
FROM w JOIN r ON r.chrom = w.chrom AND pos <= we AND ref_end >= ws GROUP BY id""")
def q_context_metrics(spark, sf_dir):
    text = lambda s: [x.strip().replace("AS VARCHAR", "AS STRING") for x in s.split(", ")]
    reads, windows = table(spark, sf_dir, "lineitem").selectExpr(*text(_READ)), table(spark, sf_dir, "orders").selectExpr(*text(_WINDOW))
    out = context.context_metrics(reads, windows, ["id"], "ws", "we")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("id", "context_non_sv_reads")})


@_query(f"""
WITH r AS (SELECT {_READ} FROM lineitem), w AS (SELECT {_WINDOW} FROM orders),
e AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, pos AS p, 1 AS d FROM r UNION ALL SELECT chrom, ref_end + 1, -1 FROM r) GROUP BY ALL),
s AS (SELECT chrom, p AS a, lead(p) OVER v - 1 AS b, sum(d) OVER v AS depth FROM e WINDOW v AS (PARTITION BY chrom ORDER BY p)),
j AS (SELECT id, sum(depth * (least(b, we) - greatest(a, ws) + 1)) AS t, max(depth) AS k FROM w JOIN s ON s.chrom = w.chrom AND a <= we AND b >= ws WHERE depth > 0 GROUP BY id)
SELECT w.id, round(coalesce(t / 51, 0.0), 6) AS mean_depth, CAST(coalesce(k, 0) AS BIGINT) AS peak_depth FROM w LEFT JOIN j ON w.id = j.id""")
def q_depth_stats(spark, sf_dir):
    text = lambda s: [x.strip().replace("AS VARCHAR", "AS STRING") for x in s.split(", ")]
    blocks = table(spark, sf_dir, "lineitem").selectExpr(*text(_READ)).select("chrom", F.col("pos").alias("start_pos"), F.col("ref_end").alias("end_pos"))
    out = context.depth_stats(blocks, table(spark, sf_dir, "orders").selectExpr(*text(_WINDOW)), ["id"], "ws", "we")
    return out.withColumn("mean_depth", F.round("mean_depth", 6))


_CONTIG = {
    "chrom": "l_returnflag", "window_start": "CAST(l_suppkey AS BIGINT)", "window_end": "CAST(l_suppkey + 9 AS BIGINT)", "sample": "CASE WHEN l_orderkey % 2 = 0 THEN 'disease' ELSE 'control' END", "contig_id": "CAST(l_orderkey % 23 AS BIGINT)", "target_set": "CASE WHEN l_linenumber % 3 = 1 THEN 'mei' ELSE 'ref' END",
    "qstart": "CAST(l_partkey % 300 AS BIGINT)", "qend": "CAST(l_partkey % 300 + 30 + l_orderkey % 170 AS BIGINT)", "strand": "CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE '+' END", "tname": "CASE WHEN l_orderkey % 7 = 0 THEN 'chr2' ELSE 'chr1' END", "tstart": "CAST(l_partkey % 1700 AS BIGINT)", "tend": "CAST(l_partkey % 1700 + 30 + l_orderkey % 170 AS BIGINT)",
    "nmatch": "CAST(20 + l_orderkey % 150 AS BIGINT)", "alnlen": "CAST(30 + l_orderkey % 170 AS BIGINT)", "mapq": "CAST(l_partkey % 61 AS BIGINT)",
}
_CONTIG_SQL = "h AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CONTIG.items()) + " FROM lineitem)"
_CK = f"{_K}, sample, contig_id"


_BREAK_SQL = f"""
WITH {_CONTIG_SQL},
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY alnlen DESC, mapq DESC, nmatch DESC, qstart, tname DESC) AS n FROM h WHERE target_set = 'mei') WHERE n = 1),
k AS (SELECT DISTINCT {_CK} FROM h),
j AS (SELECT h.*, h.qend <= m.qstart + 20 AS isl, h.qstart >= m.qend - 20 AS isr FROM h JOIN m USING ({_CK}) WHERE h.target_set = 'ref'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY qend DESC, alnlen DESC, mapq DESC, nmatch DESC, tname DESC, tend DESC) AS n FROM j WHERE isl) WHERE n = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY qstart, alnlen DESC, mapq DESC, nmatch DESC, tname, tstart) AS n FROM j WHERE isr) WHERE n = 1),
b AS (SELECT {_CK}, max(alnlen) AS ref_aln_len, count(*) FILTER (alnlen >= 80 AND mapq >= 20) AS blocks, count(DISTINCT CASE WHEN alnlen >= 80 AND mapq >= 20 THEN tname END) > 1 OR count(DISTINCT CASE WHEN alnlen >= 80 AND mapq >= 20 THEN strand END) > 1 AS mixed FROM h WHERE target_set = 'ref' GROUP BY ALL),
a AS (SELECT {_CK}, coalesce(m.alnlen, 0) AS mei_aln_len, m.alnlen IS NOT NULL AS has, coalesce(blocks, 0) AS ref_blocks, coalesce(ref_aln_len, 0) AS ref_aln_len, coalesce(mixed, false) AS mixed, l.tname AS lt, l.strand AS ls, l.tend AS lp, r.tname AS rt, r.strand AS rs, r.tstart + 1 AS rp FROM k LEFT JOIN m USING ({_CK}) LEFT JOIN b USING ({_CK}) LEFT JOIN l USING ({_CK}) LEFT JOIN r USING ({_CK})),
p AS (SELECT *, CASE WHEN lp IS NOT NULL AND rp IS NOT NULL THEN 'both' WHEN lp IS NOT NULL THEN 'left_only' WHEN rp IS NOT NULL THEN 'right_only' ELSE 'none' END AS side_status,
  CASE WHEN lp IS NULL AND rp IS NULL THEN '' WHEN lp IS NULL OR rp IS NULL THEN 'single_flank_ref_only' WHEN lt <> rt THEN 'interchrom_breakend' WHEN ls <> rs THEN 'inversion_breakend' WHEN abs(rp - lp) > 1000 THEN 'large_gap_breakend' ELSE '' END AS partner_type FROM a)"""
_CLASS_SQL = "CASE WHEN NOT has THEN CASE WHEN ref_blocks >= 3 OR mixed THEN 'multi_junction' ELSE 'unknown' END WHEN ref_blocks >= 3 THEN 'multi_junction' WHEN partner_type <> '' OR mixed THEN 'mei_plus_sv' ELSE 'simple_mei' END"


@_query(f"""
{_BREAK_SQL}
SELECT {_CK}, mei_aln_len, ref_blocks, side_status, partner_type, CAST(CASE WHEN partner_type = '' THEN -1 WHEN rp IS NULL THEN lp ELSE rp END AS BIGINT) AS partner_pos,
  CAST(CASE WHEN lt = rt THEN (lp + rp) // 2 ELSE coalesce(lp, rp, 0) END AS BIGINT) AS breakpoint_pos, CAST(CASE WHEN lt = rt AND rp >= lp THEN rp - lp + 1 ELSE 0 END AS BIGINT) AS tsd_len,
  {_CLASS_SQL} AS complex_class FROM p""")
def q_contig_breakpoints(spark, sf_dir):
    out = contigs.contig_breakpoints(table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _CONTIG.items()]))
    return out.select(*contigs.CONTIG, "mei_aln_len", "ref_blocks", "side_status", "partner_type", "partner_pos", "breakpoint_pos", F.col("tsd_len").cast("bigint"), "complex_class")


_WHOLE = {
    "poly_tail_rescued": "l_orderkey % 50 = 0", "clip_poly_at_run": "CASE WHEN l_orderkey % 6 = 0 THEN 10 ELSE 2 END", "clip_poly_at_fraction": "CASE WHEN l_orderkey % 6 = 0 THEN 0.71D ELSE 0.5D END",
    "poly_tail_anchor_rescued": "false", "anchor_poly_at_run": "CASE WHEN l_orderkey % 6 = 0 THEN 10 ELSE 2 END",
}


def _annotated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in (_HIT | _WHOLE).items()])
    # a third of the rows are aligned to no element
    rows = rows.withColumn("target", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("target")))
    loci = rows.groupBy(*KEY).agg(*[F.count_if(F.col("sample") == s).alias(f"{s}_total_rows") for s in ("disease", "control")])
    return annotate.annotate(loci, rows.filter("kind <> 'discordant'"), rows.filter("kind = 'discordant'"))


@_query(None)
def q_annotate(spark, sf_dir):
    """The whole stage; its parts have texts of their own, and a test compares the whole on planted loci."""
    names = ("analysis_stage_tier", "stage_fail_reason", "insertion_call_tier", "sample_status_label", "event_family", "event_subfamily", "insertion_orientation", "insertion_mei_span", "insertion_breakpoint_pos", "tsd_evidence_source", "insertion_model_score", "priority_rank")
    return _annotated(spark, sf_dir).select(*KEY, *names)


@_query(None)
def q_review_table(spark, sf_dir):
    return review.review_table(_annotated(spark, sf_dir))


@_query(f"""
WITH {_HIT_SQL}, c AS (SELECT chrom, max(window_end) + 5000 AS length FROM h GROUP BY ALL), v AS (SELECT DISTINCT chrom, window_start AS s, window_end AS e FROM h),
d AS (SELECT chrom, draw, CAST('0x' || left(md5(chrom || ':13:' || draw), 15) AS BIGINT) % (length - 119) + 1 AS place FROM c, range(0, 2500) r(draw)),
k AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY draw) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.chrom = d.chrom AND v.s <= d.place + 119 AND v.e >= d.place))
SELECT chrom, CAST(place AS BIGINT) AS window_start, CAST(place + 119 AS BIGINT) AS window_end FROM k WHERE n <= 50""")
def q_random_windows(spark, sf_dir):
    """Hash-drawn windows clear of the loci."""
    rows = _hits(spark, sf_dir)
    lengths = rows.groupBy("chrom").agg((F.max("window_end") + 5000).alias("length"))
    avoid = rows.select("chrom", F.col("window_start").alias("start_pos"), F.col("window_end").alias("end_pos")).distinct()
    return context.random_windows(lengths, 50, 120, avoid=avoid)


@_query(f"""
{_BREAK_SQL},
w AS (SELECT {_CK}, max(qend) AS contig_len FROM h GROUP BY ALL),
c AS (SELECT p.*, {_CLASS_SQL} AS complex_class, CASE WHEN partner_type = '' THEN '' WHEN rp IS NULL THEN lt ELSE rt END AS partner_chrom, CAST(CASE WHEN partner_type = '' THEN -1 WHEN rp IS NULL THEN lp ELSE rp END AS BIGINT) AS partner_pos,
  row_number() OVER (PARTITION BY {_K}, sample ORDER BY mei_aln_len + ref_aln_len DESC, contig_len DESC, contig_id DESC) AS n FROM p JOIN w USING ({_CK})),
z AS (SELECT *, row_number() OVER (PARTITION BY {_K}, sample ORDER BY list_position(['unknown', 'simple_mei', 'mei_plus_sv', 'multi_junction'], complex_class) DESC,
  CASE side_status WHEN 'both' THEN 2 WHEN 'none' THEN 0 ELSE 1 END DESC, CAST(partner_type <> '' AS INT) DESC, mei_aln_len DESC, n) AS k, string_agg(contig_id, ',' ORDER BY n) OVER (PARTITION BY {_K}, sample) AS top_contigs FROM c WHERE n <= 3)
SELECT {_K}, sample, complex_class, side_status, partner_chrom, partner_pos, partner_type, mei_aln_len, top_contigs FROM z WHERE k = 1""")
def q_contig_topology(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _CONTIG.items()])
    lengths = hits.groupBy(*contigs.CONTIG).agg(F.max("qend").alias("contig_len"))
    return contigs.topology(contigs.contig_breakpoints(hits), lengths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
