"""Queries over the driver's star-schema tables, each with its DuckDB text.

Every operator is shown on a deterministic projection of those tables into the
domain's shape; both texts alias every column alike and round doubles alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.operators import aggregates, cluster, intervals, loci, rules
from mobilome_spark.plans import locus_queries, refine_queries
from mobilome_spark.plans.projections import evidence, hits, spans, table

EV_SQL = """ev AS (
  SELECT event_id, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS pos,
         user_id AS read_name, CASE WHEN user_id % 2 = 0 THEN 'disease' ELSE 'control' END AS sample,
         CASE WHEN event_id % 3 = 0 THEN 'discordant' ELSE 'split' END AS kind,
         CASE WHEN event_id % 4 < 2 THEN 'L' ELSE 'R' END AS clip_side,
         CAST(event_id % 61 AS BIGINT) AS mapq, value
  FROM events)"""

IV_SQL = """iv AS (
  SELECT CAST(o_orderkey AS BIGINT) AS iv_id, CAST(o_custkey % 10 AS VARCHAR) AS chrom, CAST(o_orderkey * 3 AS BIGINT) AS start_pos,
         CAST(o_orderkey * 3 + 20 + o_orderkey % 97 AS BIGINT) AS end_pos FROM orders),
tr AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS tr_id, CAST(l_suppkey % 10 AS VARCHAR) AS chrom, CAST(l_orderkey * 3 + l_linenumber * 7 AS BIGINT) AS tr_start,
         CAST(l_orderkey * 3 + l_linenumber * 7 + 5 + l_partkey % 40 AS BIGINT) AS tr_end FROM lineitem)"""

HITS_SQL = """hits AS (
  SELECT CAST(l_suppkey AS BIGINT) AS locus, CAST(l_orderkey AS BIGINT) AS read_name, l_returnflag || l_linestatus AS target, l_quantity AS score,
         CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END AS side, CAST(l_partkey % 50 AS BIGINT) AS pos, l_linenumber AS line,
         CAST(l_orderkey % 1000 AS BIGINT) AS anchor, CAST(l_partkey % 700 AS BIGINT) AS target_mid, l_extendedprice AS price, l_shipdate
  FROM lineitem)"""

SEQ_SQL = """s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    """Register a query under its function's name, with its DuckDB text."""

    def add(build):
        _QUERIES[build.__name__] = build
        if sql is not None:
            _ORACLES[build.__name__] = sql
        return build

    return add


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


@_query(f"""
WITH {EV_SQL},
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS brk FROM ev),
c AS (SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY pos) AS cid FROM g)
SELECT chrom, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_rows, count(DISTINCT read_name) AS n_reads
FROM c GROUP BY chrom, cid""")
def q_gap_clusters(spark, sf_dir):
    ev = cluster.gap_clusters(evidence(spark, sf_dir), "chrom", "pos", 600)
    return ev.groupBy("chrom", "cluster_id").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("read_name").alias("n_reads")
    ).drop("cluster_id")


@_query(f"""
WITH RECURSIVE {EV_SQL},
p AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM (SELECT DISTINCT chrom, pos FROM ev)),
w AS (SELECT chrom, pos, i, pos AS s FROM p WHERE i = 1
      UNION ALL
      SELECT p.chrom, p.pos, p.i, CASE WHEN p.pos - w.pos > 900 OR p.pos - w.s > 3000 THEN p.pos ELSE w.s END
      FROM w JOIN p ON p.chrom = w.chrom AND p.i = w.i + 1)
SELECT chrom, s AS start_pos, max(pos) AS end_pos, count(*) AS n_positions FROM w GROUP BY chrom, s""")
def q_greedy_span_clusters(spark, sf_dir):
    return cluster.greedy_segments(evidence(spark, sf_dir), "chrom", "pos", 900, 3000)


@_query(f"""
WITH {IV_SQL},
m AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM iv),
g AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_merged FROM g GROUP BY chrom, g""")
def q_interval_merge(spark, sf_dir):
    return cluster.merge_intervals(spans(spark, sf_dir)[0], "chrom", "start_pos", "end_pos")


@_query(f"""
WITH {IV_SQL},
j AS (SELECT tr_id, tr_start, iv_id, start_pos, end_pos,
      row_number() OVER (PARTITION BY tr_id ORDER BY end_pos - start_pos, abs(CAST(floor((start_pos + end_pos + 1) / 2) AS BIGINT) - tr_start), start_pos) AS n
      FROM tr JOIN iv ON tr.chrom = iv.chrom AND tr_start BETWEEN start_pos AND end_pos)
SELECT tr_id, iv_id, start_pos, end_pos FROM j WHERE n = 1""")
def q_tightest_interval(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.tightest_interval(tr, iv, "chrom", "tr_start", "start_pos", "end_pos", ["tr_id"]).select("tr_id", "iv_id", "start_pos", "end_pos")


@_query(f"""
WITH {IV_SQL},
j AS (SELECT tr_id, start_pos, end_pos, greatest(start_pos - tr_start, tr_start - end_pos, 0) AS distance
      FROM tr JOIN iv ON tr.chrom = iv.chrom AND tr_start BETWEEN start_pos - 15 AND end_pos + 15),
k AS (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY distance, start_pos, end_pos) AS n FROM j)
SELECT tr.tr_id, k.start_pos AS start_pos, k.distance AS distance FROM tr LEFT JOIN k ON tr.tr_id = k.tr_id AND n = 1""")
def q_nearest_seed(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.nearest_seed(tr, iv, "chrom", "tr_start", "start_pos", "end_pos", 15, ["tr_id"]).select("tr_id", "start_pos", "distance")


@_query(f"WITH {IV_SQL} SELECT iv_id FROM iv WHERE EXISTS (SELECT 1 FROM tr WHERE tr.chrom = iv.chrom AND tr_start <= end_pos AND tr_end >= start_pos)")
def q_overlap_semi(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.overlapping(iv, tr, "chrom", "start_pos", "end_pos", "tr_start", "tr_end", ["iv_id"]).select("iv_id")


@_query(f"WITH {IV_SQL} SELECT iv_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.chrom = iv.chrom AND tr_start <= end_pos AND tr_end >= start_pos)")
def q_overlap_anti(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.overlapping(iv, tr, "chrom", "start_pos", "end_pos", "tr_start", "tr_end", ["iv_id"], inverse=True).select("iv_id")


@_query(f"""
WITH {IV_SQL} SELECT iv_id FROM iv WHERE EXISTS (SELECT 1 FROM tr WHERE tr.chrom = iv.chrom AND tr_start <= end_pos AND tr_end >= start_pos
  AND least(tr_end, end_pos) - greatest(tr_start, start_pos) + 1 >= 0.3::DOUBLE * (end_pos - start_pos + 1))""")
def q_overlap_fraction_semi(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.overlapping(iv, tr, "chrom", "start_pos", "end_pos", "tr_start", "tr_end", ["iv_id"], 0.3).select("iv_id")


@_query(f"""
WITH {IV_SQL},
j AS (SELECT iv_id, tr_id, least(tr_end, end_pos) - greatest(tr_start, start_pos) + 1 AS overlap_bp,
      row_number() OVER (PARTITION BY iv_id ORDER BY least(tr_end, end_pos) - greatest(tr_start, start_pos) DESC, tr_start, tr_id) AS n
      FROM iv JOIN tr ON tr.chrom = iv.chrom AND tr_start <= end_pos AND tr_end >= start_pos)
SELECT iv.iv_id, j.tr_id AS tr_id, j.overlap_bp AS overlap_bp FROM iv LEFT JOIN j ON iv.iv_id = j.iv_id AND n = 1""")
def q_best_overlap(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    return intervals.best_overlap(iv, tr, "chrom", "start_pos", "end_pos", "tr_start", "tr_end", ["iv_id"], "tr_id").select("iv_id", "tr_id", "overlap_bp")


@_query(f"""
WITH {IV_SQL},
e AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, start_pos AS p, 1 AS d FROM iv UNION ALL SELECT chrom, end_pos + 1, -1 FROM iv) GROUP BY chrom, p),
r AS (SELECT chrom, p AS from_pos, lead(p) OVER w - 1 AS to_pos, CAST(sum(d) OVER w AS BIGINT) AS depth FROM e WINDOW w AS (PARTITION BY chrom ORDER BY p))
SELECT * FROM r WHERE depth > 0""")
def q_depth_pileup(spark, sf_dir):
    return aggregates.depth(spans(spark, sf_dir)[0], "chrom", "start_pos", "end_pos")


@_query(f"""
WITH {HITS_SQL},
s AS (SELECT locus, target, sum(score) AS s FROM hits GROUP BY locus, target),
r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY s DESC, target) AS n, sum(s) OVER (PARTITION BY locus) AS t FROM s)
SELECT locus, target AS top_label, s AS top_score, round(s / t, 6) AS purity FROM r WHERE n = 1""")
def q_top_label_purity(spark, sf_dir):
    return aggregates.top_label(hits(spark, sf_dir), ["locus"], "target", "score").withColumn("purity", F.round("purity", 6))


@_query(f"""
WITH {HITS_SQL},
p AS (SELECT locus, side, pos, count(DISTINCT read_name) AS c FROM hits GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY locus, side ORDER BY c DESC, pos) AS n, CAST(sum(c) OVER (PARTITION BY locus, side) AS BIGINT) AS total_reads,
      count(*) OVER (PARTITION BY locus, side) AS unique_positions FROM p)
SELECT locus, side, pos AS mode_pos, c AS mode_reads, total_reads, unique_positions FROM r WHERE n = 1""")
def q_breakpoint_mode(spark, sf_dir):
    return aggregates.breakpoint_mode(hits(spark, sf_dir), ["locus", "side"], "pos", "read_name")


@_query(f"""
WITH {HITS_SQL}, b AS (SELECT locus, side, pos // 10 AS bin, count(DISTINCT read_name) AS c FROM hits GROUP BY ALL)
SELECT locus, side, round(max(c) / sum(c), 6) AS bin_mode_fraction FROM b GROUP BY locus, side""")
def q_bin_mode_fraction(spark, sf_dir):
    return aggregates.bin_mode_fraction(hits(spark, sf_dir), ["locus", "side"], "pos", 10, "read_name").withColumn("bin_mode_fraction", F.round("bin_mode_fraction", 6))


@_query(f"""
WITH {HITS_SQL}
SELECT locus, count(DISTINCT CASE WHEN side = 'L' THEN read_name END) AS left_reads, count(DISTINCT CASE WHEN side = 'R' THEN read_name END) AS right_reads,
       round(quantile_cont(target_mid, 0.5), 6) AS median_mid, greatest(CAST(floor(quantile_cont(price, 0.995)) AS BIGINT), 1000) AS size_threshold
FROM hits GROUP BY locus""")
def q_side_distinct_quantile(spark, sf_dir):
    side = lambda s: F.countDistinct(F.when(F.col("side") == s, F.col("read_name")))
    return hits(spark, sf_dir).groupBy("locus").agg(
        side("L").alias("left_reads"), side("R").alias("right_reads"), F.round(F.percentile("target_mid", 0.5), 6).alias("median_mid"),
        F.greatest(F.floor(F.percentile("price", 0.995)), F.lit(1000)).cast("bigint").alias("size_threshold"),
    )


@_query(f"""
WITH {HITS_SQL},
r AS (SELECT locus, rank() OVER (PARTITION BY locus ORDER BY anchor) + (count(*) OVER (PARTITION BY locus, anchor) - 1) / 2.0::DOUBLE AS x,
             rank() OVER (PARTITION BY locus ORDER BY target_mid) + (count(*) OVER (PARTITION BY locus, target_mid) - 1) / 2.0::DOUBLE AS y FROM hits)
SELECT locus, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 1.0 WHEN var_pop(x) * var_pop(y) <= 1e-9 THEN 0.0 ELSE abs(corr(x, y)) END, 6) AS spearman FROM r GROUP BY locus""")
def q_spearman(spark, sf_dir):
    return aggregates.abs_spearman(hits(spark, sf_dir), ["locus"], "anchor", "target_mid").withColumn("spearman", F.round("spearman", 6))


@_query(f"""
WITH {EV_SQL},
a AS (SELECT chrom, mapq, count(*) FILTER (sample = 'disease') AS disease_rows, count(DISTINCT CASE WHEN sample = 'disease' THEN read_name END) AS disease_reads,
      count(*) FILTER (sample = 'control') AS control_rows, count(DISTINCT CASE WHEN sample = 'control' THEN read_name END) AS control_reads FROM ev GROUP BY chrom, mapq),
c AS (SELECT *, disease_rows * 1e6::DOUBLE / 50000 AS d, control_rows * 1e6::DOUBLE / 40000 AS c FROM a)
SELECT chrom, mapq, disease_rows, disease_reads, control_rows, control_reads, round(d, 6) AS disease_cpm, round(c, 6) AS control_cpm,
       round((d + 0.1) / (c + 0.1), 6) AS enrichment_ratio, round(d - c, 6) AS delta_cpm FROM c""")
def q_case_control_enrichment(spark, sf_dir):
    out = aggregates.case_control(evidence(spark, sf_dir), ["chrom", "mapq"], "sample", "read_name", {"disease": 50000, "control": 40000})
    return out.withColumns({c: F.round(c, 6) for c in ("disease_cpm", "control_cpm", "enrichment_ratio", "delta_cpm")})


@_query(f"""
WITH {HITS_SQL},
d AS (SELECT DISTINCT locus, anchor, target_mid FROM hits),
s AS (SELECT locus, anchor, target_mid, least(abs((target_mid - lag(target_mid) OVER w) - (anchor - lag(anchor) OVER w)), abs((target_mid - lag(target_mid) OVER w) + (anchor - lag(anchor) OVER w))) AS s
      FROM d WINDOW w AS (PARTITION BY locus ORDER BY anchor, target_mid)),
b AS (SELECT *, coalesce(max(CASE WHEN s > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY locus ORDER BY anchor, target_mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s)
SELECT locus, coalesce(max(CASE WHEN over = 0 THEN s END), 0) AS max_swing, max(CASE WHEN s > 600 THEN 1 ELSE 0 END) AS violates FROM b GROUP BY locus""")
def q_jump_violation(spark, sf_dir):
    return aggregates.jump_violation(hits(spark, sf_dir), ["locus"], "anchor", "target_mid", 600)


@_query(f"""
WITH {EV_SQL},
bg AS (SELECT chrom, value AS v FROM ev), q AS (SELECT event_id, chrom, value AS v FROM ev),
n AS (SELECT chrom, count(*) AS n FROM bg GROUP BY chrom)
SELECT q.event_id, round((count(b.v) FILTER (b.v >= q.v) + 1) / (count(b.v) + 1), 9) AS p_high
FROM q LEFT JOIN n ON q.chrom = n.chrom JOIN bg b ON coalesce(n.n, 0) < 50 OR b.chrom = q.chrom GROUP BY q.event_id""")
def q_empirical_tail(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    return aggregates.empirical_tail(ev, ev, ["event_id"], "chrom", "value").withColumn("p_high", F.round("p_high", 9))


@_query(f"""
WITH {SEQ_SQL}, r AS (SELECT doc_id, seq, regexp_extract_all(seq, '(A+|T+)') AS runs FROM s),
m AS (SELECT *, coalesce(list_max(list_transform(runs, lambda x: length(x))), 0) AS run FROM r)
SELECT doc_id, CAST(run AS INTEGER) AS run, coalesce(left(list_filter(runs, lambda x: length(x) = run)[1], 1), '') AS base,
       round(CASE WHEN length(seq) = 0 THEN 0.0 ELSE (length(seq) - length(regexp_replace(seq, '[AT]', '', 'g'))) / length(seq) END, 6) AS fraction FROM m""")
def q_poly_run(spark, sf_dir):
    s = F.col("seq")
    return _seqs(spark, sf_dir).select("doc_id", seq.poly_at_run(s).alias("run"), seq.poly_at_base(s).alias("base"), F.round(seq.poly_at_fraction(s), 6).alias("fraction"))


@_query(f"""
WITH {SEQ_SQL}, c AS (SELECT doc_id, left(seq, 80) AS c FROM s),
n AS (SELECT *, length(c) AS n, [length(c) - length(replace(c, b, '')) FOR b IN ['A', 'C', 'G', 'T']] AS k FROM c),
e AS (SELECT *, coalesce(list_sum([CASE WHEN x > 0 THEN -(x / n) * log2(x / n) ELSE 0.0 END FOR x IN k]), 0.0) AS e FROM n)
SELECT doc_id, c AS clip, round(e, 6) AS entropy, n >= 20 AND (k[2] + k[3]) / greatest(n, 1) >= 0.15 AND e >= 1.2 AS informative FROM e""")
def q_entropy_informative(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", seq.normalized_clip(F.col("text")).alias("clip"))
    return c.select("doc_id", "clip", F.round(seq.entropy(F.col("clip")), 6).alias("entropy"), seq.informative_clip(F.col("clip")).alias("informative"))


@_query(f"WITH {SEQ_SQL} SELECT doc_id, reverse(translate(left(seq, 60), 'ACGT', 'TGCA')) AS rc FROM s")
def q_revcomp(spark, sf_dir):
    return _seqs(spark, sf_dir).select("doc_id", seq.revcomp(F.left("seq", F.lit(60))).alias("rc"))


@_query(f"""
WITH {SEQ_SQL}, t AS (SELECT doc_id, left(seq, 6) AS six FROM s)
SELECT doc_id, round(CASE WHEN length(six) = 6 THEN list_sum([log2(CASE WHEN contains(CASE WHEN k <= 2 THEN 'CT' ELSE 'AG' END, substr(six, k, 1)) THEN 0.45 ELSE 0.05 END / 0.25) FOR k IN range(1, 7)]) ELSE 0.0 END, 6) AS logodds FROM t""")
def q_motif_logodds(spark, sf_dir):
    return _seqs(spark, sf_dir).select("doc_id", F.round(seq.motif_logodds(F.left("seq", F.lit(6))), 6).alias("logodds"))


@_query(f"""
WITH {SEQ_SQL}, t AS (SELECT doc_id, left(seq, 6) AS six FROM s)
SELECT doc_id, CAST(CASE WHEN length(six) <> 6 THEN greatest(length(six), 6) ELSE hamming(six, 'TTAAAA') END AS INTEGER) AS distance FROM t""")
def q_hamming_motif(spark, sf_dir):
    return _seqs(spark, sf_dir).select("doc_id", seq.hamming(F.left("seq", F.lit(6)), F.lit("TTAAAA")).alias("distance"))


_CIGAR = "CAST(10 + l_partkey % 40 AS VARCHAR) || 'M' || CAST(1 + l_suppkey % 30 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN 'I' ELSE 'D' END || CAST(5 + l_linenumber AS VARCHAR) || 'M3S'"


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'I' ELSE 'D' END AS kind, CAST(1 + l_suppkey % 30 AS BIGINT) AS len,
       CAST(1000 + 10 + l_partkey % 40 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE (1 + l_suppkey % 30) // 2 END AS BIGINT) AS ref_pos FROM lineitem""")
def q_cigar_events(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CIGAR.replace("VARCHAR", "STRING")).alias("cigar"))
    return reads.select("l_orderkey", "l_linenumber", F.inline(rules.cigar_events(F.col("cigar"), F.lit(1000))))


@_query("""
SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 7 = 0 THEN 'mate_unmapped' END, CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 'interchrom' END,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 AND abs(value) >= 50 THEN 'large_insert' END, CASE WHEN event_id % 3 = 0 THEN 'same_strand' END,
  CASE WHEN event_id % 2 = 0 THEN 'improper_pair' END, CASE WHEN event_id % 11 = 0 THEN 'poly_tail_anchor_rescue' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  event_id % 7 = 0 OR event_id % 5 = 0 OR abs(value) >= 50 OR event_id % 11 = 0 AS strong FROM events""")
def q_discordant_reasons(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    reasons = rules.discordant_reasons(i % 7 == 0, i % 5 == 0, F.col("value"), 50, i % 3 == 0, i % 2 != 0, i % 11 == 0)
    return e.select("event_id", reasons.alias("reasons")).withColumn("strong", rules.has_strong_reason(F.col("reasons")))


@_query("""
WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 400 + 100 AS BIGINT) AS s, CAST(o_orderkey % 400 + 160 AS BIGINT) AS e,
  list_filter([CAST(CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 400 + 90 + o_custkey % 50 ELSE 0 END AS BIGINT), CAST(CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 400 + 120 + o_custkey % 30 ELSE 0 END AS BIGINT)], lambda x: x > 0) AS c,
  CAST(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 400 + 130 ELSE 0 END AS BIGINT) AS p FROM orders),
f AS (SELECT *, CASE WHEN p > 0 THEN p ELSE CAST(floor((s + e) / 2) AS BIGINT) END AS one FROM k),
b AS (SELECT o_orderkey, greatest(s, least(e, coalesce(list_min(c), one))) AS bp_left, greatest(s, least(e, coalesce(list_max(c), one))) AS bp_right FROM f)
SELECT *, bp_right - bp_left + 1 AS bp_width, CASE WHEN bp_right - bp_left < 3 THEN 'high' WHEN bp_right - bp_left < 15 THEN 'medium' ELSE 'low' END AS bp_tier,
       CAST(round_even((bp_left + bp_right) / 2, 0) AS BIGINT) AS bp_pos FROM b""")
def q_breakpoint_interval(spark, sf_dir):
    base, c = F.col("o_orderkey") % 400, F.col("o_custkey")
    found = [F.when(c % 3 == 0, base + 90 + c % 50).otherwise(0), F.when(c % 5 == 0, base + 120 + c % 30).otherwise(0)]
    return table(spark, sf_dir, "orders").select("o_orderkey", *rules.breakpoint_interval(found, F.when(c % 2 == 0, base + 130).otherwise(0), base + 100, base + 160))


@_query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity + 0.5 * l_linenumber AS alt, CAST(l_partkey % 60 AS DOUBLE) AS ref FROM lineitem), p AS (SELECT *, alt / (alt + ref) AS p FROM k)
SELECT l_orderkey, l_linenumber, round(p, 6) AS vaf, round(greatest(0.0, p - 1.96 * sqrt(p * (1 - p) / (alt + ref))), 6) AS vaf_low, round(least(1.0, p + 1.96 * sqrt(p * (1 - p) / (alt + ref))), 6) AS vaf_high FROM p""")
def q_vaf_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *rules.vaf_bounds(F.col("l_quantity") + 0.5 * F.col("l_linenumber"), (F.col("l_partkey") % 60).cast("double")))
    return rows.withColumns({c: F.round(c, 6) for c in ("vaf", "vaf_low", "vaf_high")})


@_query(f"""
WITH {HITS_SQL}, c AS (SELECT locus, count(DISTINCT CASE WHEN side = 'L' AND line < 4 THEN read_name END) AS a, count(DISTINCT CASE WHEN side = 'R' AND line < 4 THEN read_name END) AS b,
  count(DISTINCT CASE WHEN side = 'L' AND line >= 4 THEN read_name END) AS c, count(DISTINCT CASE WHEN side = 'R' AND line >= 4 THEN read_name END) AS d, count(DISTINCT read_name) AS m FROM hits GROUP BY locus)
SELECT locus, 'SR_L=' || a || ',SR_R=' || b || ',DPE_L=' || c || ',DPE_R=' || d || ',MEI_MAPPED=' || m AS support, m AS mapped FROM c""")
def q_support_string(spark, sf_dir):
    n = lambda m: F.countDistinct(F.when(m, F.col("read_name")))
    left, split = F.col("side") == "L", F.col("line") < 4
    g = hits(spark, sf_dir).groupBy("locus").agg(n(left & split).alias("a"), n(~left & split).alias("b"), n(left & ~split).alias("c"), n(~left & ~split).alias("d"), F.countDistinct("read_name").alias("m"))
    text = rules.support_string({"SR_L": F.col("a"), "SR_R": F.col("b"), "DPE_L": F.col("c"), "DPE_R": F.col("d"), "MEI_MAPPED": F.col("m")})
    return g.select("locus", text.alias("support")).withColumn("mapped", rules.support_field(F.col("support"), "MEI_MAPPED"))


@_query("""
WITH d AS (SELECT CAST(l_suppkey AS BIGINT) AS locus, count(*) AS depth FROM lineitem GROUP BY 1), s AS (SELECT avg(depth) AS m, stddev_pop(depth) AS sd FROM d)
SELECT locus, depth, round((depth - m) / sd, 6) AS z, (depth - m) / sd >= 2 AS outlier FROM d, s""")
def q_depth_outlier(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("locus")).agg(F.count(F.lit(1)).alias("depth"))
    s = d.agg(F.avg("depth").alias("m"), F.stddev_pop("depth").alias("sd"))  # one row
    z = (F.col("depth") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return d.join(F.broadcast(s)).select("locus", "depth", F.round(z, 6).alias("z"), (z >= 2).alias("outlier"))


@_query(f"""
WITH {HITS_SQL}, r AS (SELECT locus, read_name, line, row_number() OVER (PARTITION BY locus ORDER BY CASE WHEN side = 'L' THEN 0 ELSE 1 END, pos, read_name, line) AS n FROM hits)
SELECT locus, read_name, line FROM r WHERE n <= 25""")
def q_read_cap_priority(spark, sf_dir):
    order = Window.partitionBy("locus").orderBy(F.when(F.col("side") == "L", 0).otherwise(1), "pos", "read_name", "line")
    return hits(spark, sf_dir).withColumn("_n", F.row_number().over(order)).filter("_n <= 25").select("locus", "read_name", "line")


@_query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT), 0) AS page, contains(url, '#') AS anchored FROM pages""")
def q_catalog_parse(spark, sf_dir):
    u = F.col("url")
    page = F.coalesce(F.regexp_extract(u, "[?&]page=([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), page.alias("page"), u.contains("#").alias("anchored"))


_LOCI_SQL = """
sp AS (SELECT DISTINCT chrom, pos FROM ev WHERE kind = 'split'),
sg AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 300 THEN 0 ELSE 1 END AS b FROM sp),
sc AS (SELECT chrom, pos, sum(b) OVER (PARTITION BY chrom ORDER BY pos) AS c FROM sg),
seed AS (SELECT chrom, min(pos) AS s, max(pos) AS e FROM sc GROUP BY chrom, c),
dj AS (SELECT d.chrom, d.pos, s, row_number() OVER (PARTITION BY d.chrom, d.pos ORDER BY greatest(s - d.pos, d.pos - e, 0), s, e) AS n
       FROM (SELECT DISTINCT chrom, pos FROM ev WHERE kind = 'discordant') d LEFT JOIN seed ON d.chrom = seed.chrom AND d.pos BETWEEN s - 600 AND e + 600),
rg AS (SELECT chrom, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS b FROM dj WHERE n = 1 AND s IS NULL),
rc AS (SELECT chrom, pos, sum(b) OVER (PARTITION BY chrom ORDER BY pos) AS c FROM rg),
m AS (SELECT chrom, 300 AS flank, min(pos) OVER (PARTITION BY chrom, c) AS id, pos FROM sc UNION SELECT chrom, 300, s, pos FROM dj WHERE n = 1 AND s IS NOT NULL
      UNION SELECT chrom, 600, min(pos) OVER (PARTITION BY chrom, c), pos FROM rc),
p AS (SELECT *, row_number() OVER (PARTITION BY chrom, flank, id ORDER BY pos) AS i FROM m),
w AS (SELECT chrom, flank, id, pos, i, pos AS s FROM p WHERE i = 1 UNION ALL
      SELECT p.chrom, p.flank, p.id, p.pos, p.i, CASE WHEN p.pos - w.pos > 600 OR p.pos - w.s > 1500 THEN p.pos ELSE w.s END
      FROM w JOIN p ON p.chrom = w.chrom AND p.flank = w.flank AND p.id = w.id AND p.i = w.i + 1),
loci AS (SELECT DISTINCT chrom, CAST(greatest(1, s - flank) AS BIGINT) AS window_start, CAST(max(pos) + flank AS BIGINT) AS window_end FROM w GROUP BY chrom, flank, id, s),
aj AS (SELECT ev.*, window_start, window_end, row_number() OVER (PARTITION BY event_id ORDER BY window_end - window_start, abs(CAST(floor((window_start + window_end + 1) / 2) AS BIGINT) - pos), window_start) AS n
       FROM ev JOIN loci ON ev.chrom = loci.chrom AND ev.pos BETWEEN window_start AND window_end),
a AS (SELECT * FROM aj WHERE n = 1)"""


def _evidence_tables(spark, sf_dir):
    ev, e = evidence(spark, sf_dir), F.col("event_id")
    ev = ev.withColumns({"nm": (e % 4).cast("int"), "rescued": e % 9 == 0, "poly_fraction": (e % 10) / 10, "poly_run": (e % 17).cast("int")})
    split = ev.filter("kind = 'split'").withColumns({"clip_len": (e % 80).cast("int"), "has_sa": e % 5 == 0})
    # a read's mate lies elsewhere on the same contig, if it has one
    mate = {"template_len": (e % 3000).cast("int"), "discordant_reasons": F.when(e % 2 == 0, "interchrom").otherwise("improper_pair,large_insert"), "mate_chrom": F.when(e % 7 == 0, "*").otherwise(F.col("chrom")), "mate_pos": F.col("pos") + e % 5000}
    return split, ev.filter("kind = 'discordant'").withColumns(mate)


@_query(f"""
WITH RECURSIVE {EV_SQL}, {_LOCI_SQL}
SELECT chrom, window_start, window_end, count(*) FILTER (kind = 'split' AND sample = 'disease') AS split_disease_rows,
  count(DISTINCT CASE WHEN kind = 'split' AND sample = 'disease' THEN read_name END) AS split_disease_unique_reads,
  round(coalesce(avg(mapq) FILTER (kind = 'split' AND sample = 'disease'), 0.0), 6) AS split_disease_mapq_mean,
  coalesce(max(event_id % 80) FILTER (kind = 'split' AND sample = 'control'), 0) AS split_control_clip_len_max,
  coalesce(min(mapq) FILTER (kind = 'discordant' AND sample = 'control'), 0) AS discordant_control_mapq_min,
  round(coalesce(avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END) FILTER (kind = 'discordant' AND sample = 'control'), 0.0), 6) AS discordant_control_interchrom_fraction,
  count(DISTINCT CASE WHEN kind = 'discordant' AND sample = 'disease' AND event_id % 9 = 0 THEN read_name END) AS discordant_disease_poly_tail_rescued_unique_reads,
  round((count(*) FILTER (sample = 'disease') * 1e6::DOUBLE / 50000 + 0.1) / (count(*) FILTER (sample = 'control') * 1e6::DOUBLE / 40000 + 0.1), 6) AS enrichment_ratio
FROM a GROUP BY chrom, window_start, window_end""")
def q_candidate_loci(spark, sf_dir):
    out = loci.candidate_loci(*_evidence_tables(spark, sf_dir), {"disease": 50000, "control": 40000}, 300, 600, 1500, pseudo=0.1)
    means = ("split_disease_mapq_mean", "discordant_control_interchrom_fraction", "enrichment_ratio")
    counts = ("split_disease_rows", "split_disease_unique_reads", "discordant_disease_poly_tail_rescued_unique_reads")
    return out.select(*loci.KEY, *counts, F.col("split_control_clip_len_max").cast("bigint"), "discordant_control_mapq_min", *[F.round(c, 6).alias(c) for c in means])


@_query(f"""
WITH RECURSIVE {EV_SQL}, {_LOCI_SQL},
t AS (SELECT o_orderkey % 3 AS k, list_value('purchase', 'click', 'view', 'error', 'signup')[o_custkey % 5 + 1] AS chrom, CAST(o_orderkey * 40 AS BIGINT) AS start_pos, CAST(o_orderkey * 40 + 50 + o_custkey % 900 AS BIGINT) AS end_pos FROM orders),
l AS (SELECT DISTINCT chrom, window_start, window_end FROM a),
h AS (SELECT l.*, k, least(window_end, end_pos) - greatest(window_start, start_pos) + 1 AS o FROM l JOIN t ON t.chrom = l.chrom AND start_pos <= window_end AND end_pos >= window_start),
f AS (SELECT chrom, window_start, window_end, bool_or(k = 0 AND o >= 0.1 * (window_end - window_start + 1)) AS segdup, bool_or(k = 1 AND o >= 0.5 * (window_end - window_start + 1)) AS gap, bool_or(k = 2) AS trusted FROM h GROUP BY ALL),
e AS (SELECT a.chrom, window_start, window_end, bool_or(k = 0) AS mate FROM a JOIN t ON t.chrom = a.chrom AND a.pos + event_id % 5000 BETWEEN start_pos AND end_pos WHERE kind = 'discordant' AND event_id % 7 <> 0 AND a.pos + event_id % 5000 > 0 GROUP BY ALL)
SELECT l.chrom, l.window_start, l.window_end, coalesce(segdup, false) AS flag_segdup, coalesce(gap, false) AS flag_gap_region, NOT coalesce(trusted, false) AS flag_outside_giab_highconf, coalesce(mate, false) AS flag_mate_in_segdup,
  CAST(coalesce(segdup, false) AS INTEGER) + CAST(coalesce(gap, false) AS INTEGER) + CAST(NOT coalesce(trusted, false) AS INTEGER) AS junk_flag_count
FROM l LEFT JOIN f USING (chrom, window_start, window_end) LEFT JOIN e USING (chrom, window_start, window_end)""")
def q_junk_flags(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(n) for n in ("purchase", "click", "view", "error", "signup")])
    t = table(spark, sf_dir, "orders").select((o % 3).alias("k"), F.get(names, (c % 5).cast("int")).alias("chrom"), (o * 40).alias("start_pos"), (o * 40 + 50 + c % 900).alias("end_pos"))
    tracks = {"segdup": (t.filter("k = 0"), 0.1), "gap_region": (t.filter("k = 1"), 0.5)}
    out = loci.candidate_loci(*_evidence_tables(spark, sf_dir), {"disease": 50000, "control": 40000}, 300, 600, 1500, tracks, t.filter("k = 2"))
    return out.select(*loci.KEY, "flag_segdup", "flag_gap_region", "flag_outside_giab_highconf", "flag_mate_in_segdup", "junk_flag_count")


@_query("""
WITH s AS (SELECT doc_id % 20 AS locus, doc_id, CAST(doc_id % 7 AS BIGINT) AS pos, doc_id % 2 = 0 AS l, n_chars AS score, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS q FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY score DESC, doc_id) AS n FROM s),
c AS (SELECT locus, pos, n, left(q, 80) AS c, CASE WHEN l THEN right(left(q, 200), 40) ELSE left(q, 40) END AS x FROM r WHERE n <= 40),
e AS (SELECT *, length(c) AS m, [length(c) - length(replace(c, b, '')) FOR b IN ['A', 'C', 'G', 'T']] AS k FROM c),
i AS (SELECT * FROM e WHERE m >= 20 AND length(x) >= 12 AND (k[2] + k[3]) / m >= 0.15 AND list_sum([CASE WHEN y > 0 THEN -(y / m) * log2(y / m) ELSE 0.0 END FOR y IN k]) >= 1.2),
p AS (SELECT a.locus, greatest(0.0, least(1.0, (list_sum([CASE WHEN substr(a.x, y, 1) = substr(b.x, y, 1) THEN 1 ELSE 0 END FOR y IN range(1, 1 + least(length(a.x), length(b.x)))]) / least(length(a.x), length(b.x)) - 0.25) / 0.75))::DOUBLE AS sim
      FROM i a JOIN i b ON a.locus = b.locus AND a.n < b.n),
o AS (SELECT locus, max(c) / sum(c) AS mode, CAST(sum(c) AS BIGINT) AS n FROM (SELECT locus, pos, count(*) AS c FROM i GROUP BY ALL) GROUP BY locus),
q AS (SELECT locus, quantile_cont(sim, 0.5) AS med, avg(CASE WHEN sim >= 0.2 THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY locus)
SELECT g.locus, coalesce(n, 0) AS informative_reads, round(coalesce(med * mode, 0.0), 6) AS overlap_median, round(coalesce(share, 0.0), 6) AS overlap_share
FROM (SELECT DISTINCT locus FROM s) g LEFT JOIN o ON g.locus = o.locus LEFT JOIN q ON g.locus = q.locus""")
def q_clip_overlap(spark, sf_dir):
    d = F.col("doc_id")
    clips = table(spark, sf_dir, "documents").select((d % 20).alias("locus"), d.alias("read_name"), (d % 7).alias("pos"), F.when(d % 2 == 0, "L").otherwise("R").alias("clip_side"), F.col("text").alias("clip_seq"), F.col("n_chars").alias("score"))
    return aggregates.clip_overlap(clips, ["locus"]).withColumns({c: F.round(c, 6) for c in ("overlap_median", "overlap_share")})


@_query(f"""
WITH {IV_SQL}, f AS (SELECT ['ALU', 'SVA', 'LINE1'] AS n),
r AS (SELECT chrom, start_pos, end_pos, n[iv_id % 3 + 1] AS rf, CASE WHEN iv_id % 2 = 0 THEN '+' ELSE '-' END AS rs FROM iv, f),
q AS (SELECT tr_id, chrom, tr_start, n[tr_id // 10 % 3 + 1] AS fam, CASE WHEN tr_id % 2 = 0 THEN '+' ELSE '-' END AS ori FROM tr, f),
j AS (SELECT tr_id, start_pos, end_pos, rs = ori AS same, row_number() OVER (PARTITION BY tr_id ORDER BY CASE WHEN rs = ori THEN 0 ELSE 1 END, end_pos - start_pos DESC, start_pos) AS n
      FROM q JOIN r ON q.chrom = r.chrom AND tr_start BETWEEN start_pos AND end_pos AND rf = fam)
SELECT q.tr_id, start_pos AS repeat_start, end_pos AS repeat_end, CASE WHEN same THEN 'nested' WHEN NOT same THEN 'unnested' ELSE '' END AS nesting FROM q LEFT JOIN j ON q.tr_id = j.tr_id AND n = 1""")
def q_nested_repeat(spark, sf_dir):
    iv, tr = spans(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("ALU", "SVA", "LINE1")])
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    points = tr.select("tr_id", "chrom", "tr_start", F.get(names, F.expr("CAST(tr_id DIV 10 % 3 AS INT)")).alias("family"), sign("tr_id").alias("orientation"))
    held = iv.select("chrom", "start_pos", "end_pos", F.get(names, (F.col("iv_id") % 3).cast("int")).alias("rep_family"), sign("iv_id").alias("rep_strand"))
    return intervals.nested_repeat(points, held, "chrom", "tr_start", "start_pos", "end_pos", ["tr_id"]).select("tr_id", "repeat_start", "repeat_end", "nesting")


_SITES_SQL = """k AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_orderkey % 300 + 1 END AS dl, o_orderkey % 300 + o_custkey % 45 - 6 AS dr, o_custkey % 9 AS ds,
  CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 300 + 2 END AS cl, o_orderkey % 300 + o_orderkey % 40 - 5 AS cr, o_orderkey % 9 AS cs FROM orders)"""


@_query(f"""
WITH {_SITES_SQL}, c AS (SELECT id, dl AS l, dr AS r, ds AS n, 0 AS turn, 'tsd_disease' AS source FROM k UNION ALL SELECT id, cl, cr, cs, 1, 'tsd_control' FROM k),
g AS (SELECT * FROM c WHERE l > 0 AND r > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, r - l DESC, turn) AS k FROM g WHERE r - l + 1 BETWEEN 2 AND 30),
v AS (SELECT id, l + a AS l, r + b AS r, source, row_number() OVER (PARTITION BY id ORDER BY abs(a) + abs(b), -n, turn, l + a, r + b) AS k
      FROM g, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE l + a > 0 AND r + b > 0 AND r + b - l - a + 1 BETWEEN 2 AND 30)
SELECT k.id, CAST(coalesce(s.l, v.l, 0) AS BIGINT) AS "left", CAST(coalesce(s.r, v.r, 0) AS BIGINT) AS "right", CAST(coalesce(s.r - s.l + 1, v.r - v.l + 1, 0) AS BIGINT) AS length, coalesce(s.source, v.source, '') AS source
FROM k LEFT JOIN s ON k.id = s.id AND s.k = 1 LEFT JOIN v ON k.id = v.id AND v.k = 1""")
def q_tsd_pair(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    base = o % 300
    pair = rules.tsd_pair(
        {"disease": F.when(c % 4 == 0, 0).otherwise(base + 1), "control": F.when(c % 3 == 0, 0).otherwise(base + 2)}, {"disease": base + c % 45 - 6, "control": base + o % 40 - 5}, {"disease": c % 9, "control": o % 9}
    )
    return table(spark, sf_dir, "orders").select(o.alias("id"), pair.alias("p")).select("id", "p.*")


@_query("""
WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'g' || o_orderkey ELSE '' END AS a, CASE WHEN o_custkey % 4 = 0 THEN 'r' || o_orderkey ELSE '' END AS b,
  ['AluYa5', 'L1HS', 'SVA_D', ''][o_custkey % 4 + 1] AS x, ['AluYa5', 'L1HS', 'L1PA2'][o_orderkey % 3 + 1] AS y FROM orders),
f AS (SELECT *, CASE WHEN x LIKE 'Alu%' THEN 'ALU' WHEN x LIKE 'SVA%' THEN 'SVA' WHEN x LIKE 'L1%' THEN 'LINE1' ELSE '' END AS fx, CASE WHEN y LIKE 'Alu%' THEN 'ALU' ELSE 'LINE1' END AS fy FROM k)
SELECT o_orderkey, a <> '' OR b <> '' AS known, concat_ws(',', CASE WHEN a <> '' THEN 'melt_1kg' END, CASE WHEN b <> '' THEN 'long_read_1kg_ont_vienna' END) AS source,
  CASE WHEN a <> '' AND b <> '' THEN CASE WHEN fx = fy THEN fx ELSE 'MIXED' END WHEN a <> '' THEN fx WHEN b <> '' THEN fy ELSE '' END AS family,
  CASE WHEN a <> '' AND b <> '' THEN CASE WHEN x = y THEN x ELSE 'MULTI_SOURCE' END WHEN a <> '' THEN x WHEN b <> '' THEN y ELSE '' END AS subfamily,
  CASE WHEN a <> '' AND b <> '' THEN 'g1k:' || a || '|lr:' || b WHEN a <> '' THEN a ELSE b END AS id FROM f""")
def q_consensus_source(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda m, letter: F.when(m, F.concat(F.lit(letter), o.cast("string"))).otherwise("")
    one = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *rules.known_insertion(name(c % 3 == 0, "g"), one(("AluYa5", "L1HS", "SVA_D", ""), c % 4), name(c % 4 == 0, "r"), one(("AluYa5", "L1HS", "L1PA2"), o % 3)))


@_query(f"""
WITH {SEQ_SQL}, c AS (SELECT doc_id, left(seq, 11) AS c FROM s),
m AS (SELECT * FROM (VALUES (0, 'TTAAAA', 1, 0), (1, 'TTTAAA', 1, 0), (2, 'TTTTAA', 1, 0), (3, 'AAACTT', 1, 0), (4, 'CTGGG', 2, 0), (5, 'CTGGG', 2, 1), (6, 'CCATT', 2, 0), (7, 'CCATT', 2, 1)) t(turn, motif, allowed, o)),
d AS (SELECT doc_id, motif, allowed, turn, o, CASE WHEN length(substr(c, 2 + o, length(motif))) <> length(motif) THEN length(motif) ELSE hamming(substr(c, 2 + o, length(motif)), motif) END AS mm FROM c, m WHERE length(c) >= 8),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mm, turn) AS n FROM d)
SELECT c.doc_id, motif, CAST(mm AS INTEGER) AS mismatches, mm <= allowed AS matched FROM c LEFT JOIN b ON c.doc_id = b.doc_id AND n = 1""")
def q_motif_match(spark, sf_dir):
    m = seq.endonuclease_motif(F.left("seq", F.lit(11)))
    return _seqs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", "m.motif", "m.mismatches", F.col("m.like").alias("matched"))


@_query("""
WITH k AS (SELECT event_id, CAST(event_id * 7919 % 100003 AS DOUBLE) / 64 AS v FROM events)
SELECT event_id, CASE WHEN v = 0 THEN v ELSE round(round_even(v * pow(10.0, 2 - floor(log10(abs(v)))), 0) / pow(10.0, 2 - floor(log10(abs(v)))), 6) END AS v3 FROM k""")
def q_round_significant(spark, sf_dir):
    v = (F.col("event_id") * 7919 % 100003).cast("double") / 64
    return table(spark, sf_dir, "events").select("event_id", F.round(seq.significant(v, 3), 6).alias("v3"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **locus_queries.queries(), **refine_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **locus_queries.oracle_sql(), **refine_queries.oracle_sql()}
