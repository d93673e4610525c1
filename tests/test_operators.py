"""Edge cases of the evidence operators, from hand-derived expectations."""

import random

from pyspark.sql import functions as F

from mobilome_spark.functions import seq
from mobilome_spark.operators import cluster, intervals, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_gap_is_inclusive(spark):
    df = spark.createDataFrame([("a", 1), ("a", 11), ("a", 22), ("b", 5), ("a", None)], "chrom string, pos bigint")
    got = {(r.chrom, r.pos): r.cluster_id for r in cluster.gap_clusters(df, "chrom", "pos", 10).collect()}
    assert got == {("a", 1): 1, ("a", 11): 1, ("a", 22): 2, ("b", 5): 1, ("a", None): None}


def test_greedy_segments_match_a_loop(spark):
    rng = random.Random(3)
    pos = sorted({rng.randrange(600) for _ in range(80)})
    want, start, last = [], pos[0], pos[0]
    for p in pos[1:]:
        if p - last > 12 or p - start > 40:
            want.append((start, last))
            start = p
        last = p
    want.append((start, last))
    df = spark.createDataFrame([("c", p) for p in pos + pos[:5]], "chrom string, pos bigint")
    got = cluster.greedy_segments(df, "chrom", "pos", 12, 40).collect()
    assert sorted((r.start_pos, r.end_pos) for r in got) == want
    assert sum(r.n_positions for r in got) == len(pos)


def test_overlaps_match_brute_force_without_repeats(spark):
    rng = random.Random(5)
    a = [(i, "c", s, s + rng.randrange(200)) for i in range(60) for s in [rng.randrange(900)]]
    b = [(i, "c", s, s + rng.randrange(90)) for i in range(60) for s in [rng.randrange(900)]]
    da = spark.createDataFrame(a, "i int, chrom string, s bigint, e bigint")
    db = spark.createDataFrame(b, "j int, chrom string, s2 bigint, e2 bigint")
    got = sorted((r.i, r.j, r.overlap_bp) for r in intervals.overlaps(da, db, "chrom", "s", "e", "s2", "e2", 50).collect())
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2]) + 1) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    assert got == want


def test_tightest_interval_ties_go_to_the_smaller_start(spark):
    pts = spark.createDataFrame([(1, "c", 10)], "k int, chrom string, pos bigint")
    iv = spark.createDataFrame([("c", 5, 15), ("c", 6, 16), ("c", 1, 90)], "chrom string, s bigint, e bigint")
    row = intervals.tightest_interval(pts, iv, "chrom", "pos", "s", "e", ["k"]).first()
    assert (row.s, row.e) == (5, 15)


def test_sequences(spark):
    assert one(spark, seq.poly_at_run(F.lit("GAAATTTC"))) == 3
    assert one(spark, seq.poly_at_base(F.lit("GTTTAAAC"))) == "T"
    assert one(spark, seq.poly_at_run(F.lit(None).cast("string"))) == 0
    assert one(spark, seq.poly_at_base(F.lit(""))) == ""
    assert one(spark, seq.revcomp(F.lit("AACG"))) == "CGTT"
    assert one(spark, seq.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, seq.hamming(F.lit("AC"), F.lit("ACGT"))) == 4
    assert one(spark, seq.significant(F.lit(0.0123456), 3)) == 0.0123
    assert one(spark, seq.motif_logodds(F.lit("CTAAGA"))) > 5 > one(spark, seq.motif_logodds(F.lit("CTAAG")))


def test_rules(spark):
    assert one(spark, rules.agreement(F.lit(""), F.lit(""))) == 0
    assert one(spark, rules.agreement(F.lit("x"), F.lit(""))) == 1
    assert one(spark, rules.mei_family(F.lit("SVA_D#ALU"))) == "SVA"
    assert one(spark, rules.support_field(F.lit("SR_L=3,MEI_MAPPED=12"), "MEI_MAPPED")) == 12
    events = one(spark, rules.cigar_events(F.lit("10M4D5M2I3M"), F.lit(100)))
    assert [(e.kind, e.len, e.ref_pos) for e in events] == [("D", 4, 112), ("I", 2, 119)]


def test_registered_functions_equal_the_builders(spark):
    from mobilome_spark.functions import names, register, variants

    texts = [None, "", " @r/1 x", "a:2/1", "chrM", "chrchr1", "1", "acgTTTnA", "AATTTTT", "L1_3END#x", "AluY_short_", "END=9;END=2", "A;END=x", "x\n"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "s string, i long")
    c, i = F.col("s"), F.col("i")
    built = {
        "canonical_read_name(s)": names.canonical_read_name(c), "chrom_style(s, true)": names.chrom_style(c, F.lit(True)), "chrom_style(s, false)": names.chrom_style(c, F.lit(False)), "revcomp(s)": seq.revcomp(c),
        "poly_at_run(s)": seq.poly_at_run(c), "poly_at_fraction(s)": seq.poly_at_fraction(c), "normalized_clip(s)": seq.normalized_clip(c), "vcf_end(i, s, s)": variants.vcf_end(i, c, c), "panel_element(s)": variants.panel_element(c),
    }
    assert {k.split("(")[0] for k in built} == set(register.register(spark))
    for row in df.select("s", *[F.struct(F.expr(call).alias("x"), column.alias("y")).alias(call) for call, column in built.items()]).collect():
        for call in built:
            assert row[call].x == row[call].y, (call, row.s)
