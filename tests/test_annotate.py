"""Planted loci through the annotation stage; windows, contigs and coordinates against plain rules."""

import pytest

from mobilome_spark.operators import annotate, breakpoints, calls, context, contigs, review, support
from mobilome_spark.operators.loci import KEY

SPLIT = "chrom string, window_start long, window_end long, sample string, clip_side string, read_name string, pos long, clip_seq string, score double, family string, target string, strand string, alnlen long, target_len long, target_start long, target_end long, mapq long, qcov double, pid double, poly_tail_rescued boolean, clip_poly_at_run int, clip_poly_at_fraction double"
PAIR = "chrom string, window_start long, window_end long, sample string, read_name string, pos long, mapq long, score double, family string, target string, strand string, target_start long, target_end long, template_len long, discordant_reasons string, poly_tail_anchor_rescued boolean, anchor_poly_at_run int"
CLIP = "GACGGCTCATGCCAGTCGATCGGCATTGCAGCTCAG"


def clip(k, sample, side, read, pos, start, target="AluYb8", aligned=True):
    hit = (1.0, "ALU", target, "+", 36, 280, start, start + 36, 60, 0.95, 0.98) if aligned else (0.0, "", "", "", 0, 0, 0, 0, 0, 0.0, 0.0)
    return ("chr1", k * 1000, k * 1000 + 400, sample, side, read, pos, CLIP, *hit, False, 1, 0.5)


def pair(k, sample, read, pos, start, aligned=True):
    hit = (1.0, "ALU", "AluYb8", "+", start, start + 80) if aligned else (0.0, "", "", "", 0, 0)
    return ("chr1", k * 1000, k * 1000 + 400, sample, read, pos, 60, *hit, 300, "interchrom", False, 1)


@pytest.fixture(scope="module")
def planted(spark):
    split, pairs = [], []
    for s in ("disease", "control"):  # locus 1: both sides, both samples, a duplication of twelve bases
        split += [clip(1, s, "L", f"{s}l{i}", 1200, 1) for i in range(4)] + [clip(1, s, "R", f"{s}r{i}", 1211, 240) for i in range(4)]
    split += [clip(2, "disease", "L", f"a{i}", 2200, 1) for i in range(3)]  # locus 2: disease only, pairs on the right
    pairs += [pair(2, "disease", f"p{i}", 2300 + i, 150) for i in range(3)] + [pair(2, "disease", f"q{i}", 2100 + i, 20) for i in range(3)]
    split += [clip(3, "control", "L", f"c{i}", 3200, 1) for i in range(4)] + [clip(3, "control", "R", f"d{i}", 3211, 240) for i in range(4)]  # control only
    split += [clip(4, "disease", "L", f"e{i}", 4200, 1, aligned=False) for i in range(3)]  # no element read
    pairs += [pair(4, "disease", "f", 4100, 0, aligned=False)]
    split += [clip(5, s, "L", f"{s}g{i}", 5200, 1) for s in ("disease", "control") for i in range(4)]  # in a junk region
    loci = spark.createDataFrame([("chr1", k * 1000, k * 1000 + 400, 8, 8, int(k == 5)) for k in range(1, 7)], "chrom string, window_start long, window_end long, disease_total_rows long, control_total_rows long, junk_flag_count int")
    out = annotate.annotate(loci, spark.createDataFrame(split, SPLIT), spark.createDataFrame(pairs, PAIR))
    return {r["window_start"] // 1000: r for r in out.collect()}, out


def test_planted_loci(planted):
    rows, _ = planted
    assert len(rows) == 6
    assert rows[1]["sample_status_label"] == "shared" and rows[1]["analysis_stage_tier"] == "gold"
    assert (rows[1]["tsd_len_estimate"], rows[1]["insertion_breakpoint_pos"]) == (12, 1206) and rows[1]["insertion_orientation"] == "+"
    assert (rows[1]["disease_insertion_mei_start"], rows[1]["disease_insertion_mei_end"], rows[1]["insertion_mei_span"]) == (276, 1, 276)
    assert rows[2]["sample_status_label"] == "disease_only" and rows[2]["analysis_stage_tier"] in ("gold", "silver")
    assert rows[2]["disease_supporting_reads"] == "SR_L=3,SR_R=0,DPE_L=3,DPE_R=3,MEI_MAPPED=9"
    assert rows[3]["sample_status_label"] == "control_only" and rows[3]["likely_false_positive_control_only"]
    assert rows[4]["sample_status_label"] == "low_support" and rows[4]["stage_fail_reason"].startswith("no_mei_signal")
    assert rows[5]["analysis_stage_tier"] == "bronze" and rows[5]["stage_fail_reason"] == "junk_region_flagged"
    # a locus without any row keeps its place in the table
    assert rows[6]["analysis_stage_tier"] == "bronze" and rows[6]["disease_mei_supported_reads"] == 0
    assert sorted(r["priority_rank"] for r in rows.values()) == [1, 2, 3, 4, 5, 6] and rows[1]["priority_rank"] < rows[5]["priority_rank"]


def test_review_and_commands(planted):
    _, out = planted
    got = {r["window_start"]: r for r in review.review_table(out).collect()}
    assert (got[1000]["consensus_insertion_mei_3p_coord_full"], got[1000]["consensus_insertion_mei_5p_coord_full"], got[1000]["consensus_insertion_mei_span_full"]) == (276, 1, 276)
    assert got[6000]["consensus_insertion_mei_3p_coord_full"] == -1 and got[6000]["consensus_insertion_mei_span_full"] == 0
    lines = {r["name"]: r["commands"] for r in review.snapshot_commands(out, "/shots").collect()}
    assert lines["chr1_1000_1400"] == "goto chr1:800-1600\nsnapshotDirectory /shots\nsnapshot chr1_1000_1400.png"
    assert len(review.snapshot_commands(out, "/shots", tier=None, top=2).collect()) == 2
    assert all(r["sample_status_label"] is not None for r in review.export_texts(out.select("sample_status_label", "tsd_detected")).collect())


def test_empty_tables(spark):
    loci = spark.createDataFrame([("chr1", 1, 9)], "chrom string, window_start long, window_end long")
    out = annotate.annotate(loci, spark.createDataFrame([], SPLIT), spark.createDataFrame([], PAIR)).collect()
    assert len(out) == 1 and out[0]["analysis_stage_tier"] == "bronze" and out[0]["priority_rank"] == 1
    assert annotate.annotate(loci.limit(0), spark.createDataFrame([], SPLIT), spark.createDataFrame([], PAIR)).count() == 0


def test_random_windows(spark):
    lengths = spark.createDataFrame([("a", 5000), ("b", 80), ("c", 100000)], "chrom string, length long")
    avoid = spark.createDataFrame([("a", 1, 2500), ("c", 40000, 60000)], "chrom string, start_pos long, end_pos long")
    rows = context.random_windows(lengths, 30, 100, avoid=avoid).collect()
    assert rows and {r["chrom"] for r in rows} == {"a", "c"}
    for r in rows:
        low, high = (1, 2500) if r["chrom"] == "a" else (40000, 60000)
        assert r["window_end"] - r["window_start"] == 99 and r["window_start"] >= 1 and r["window_end"] <= (5000 if r["chrom"] == "a" else 100000)
        assert r["window_end"] < low or r["window_start"] > high
    assert sum(r["chrom"] == "c" for r in rows) == 30
    assert sorted(rows) == sorted(context.random_windows(lengths.repartition(5), 30, 100, avoid=avoid).collect())
    assert sorted(rows) != sorted(context.random_windows(lengths, 30, 100, seed=14, avoid=avoid).collect())


def test_contigs(spark):
    shape = "chrom string, window_start long, window_end long, sample string, contig_id string, target_set string, qstart long, qend long, strand string, tname string, tstart long, tend long, nmatch long, alnlen long, mapq long"
    k = ("chr1", 1, 400)
    hits = [
        (*k, "disease", "n1", "mei", 100, 380, "+", "AluYb8", 0, 280, 275, 280, 60), (*k, "disease", "n1", "ref", 0, 100, "+", "chr1", 100, 200, 100, 100, 60), (*k, "disease", "n1", "ref", 380, 480, "+", "chr1", 210, 310, 100, 100, 60),
        (*k, "control", "n1", "mei", 0, 90, "+", "L1HS", 0, 90, 90, 90, 60), (*k, "control", "n1", "ref", 85, 200, "+", "chr7", 500, 615, 115, 115, 60), (*k, "control", "n2", "ref", 0, 100, "+", "chr1", 100, 200, 100, 100, 60),
    ]
    points = contigs.contig_breakpoints(spark.createDataFrame(hits, shape))
    got = {(r["sample"], r["contig_id"]): r for r in points.collect()}
    a, b, c = got["disease", "n1"], got["control", "n1"], got["control", "n2"]
    assert (a["side_status"], a["complex_class"], a["breakpoint_pos"], a["tsd_len"], a["partner_type"]) == ("both", "simple_mei", 205, 12, "")
    assert (b["side_status"], b["complex_class"], b["partner_chrom"], b["partner_pos"]) == ("right_only", "mei_plus_sv", "chr7", 501)
    assert (c["side_status"], c["complex_class"], c["mei_aln_len"]) == ("none", "unknown", 0)
    lengths = spark.createDataFrame([(*k, s, n, 500) for s, n in got], "chrom string, window_start long, window_end long, sample string, contig_id string, contig_len long")
    tops = {r["sample"]: r for r in contigs.topology(points, lengths).collect()}
    assert tops["control"]["complex_class"] == "mei_plus_sv" and tops["control"]["top_contigs"] == "n1,n2"
    features = contigs.topology(points, lengths).selectExpr(*KEY, "sample", "complex_class", "side_status", "partner_type", "mei_aln_len", "CASE WHEN sample = 'disease' THEN 280 ELSE -1 END AS insertion_mei_start", "CASE WHEN sample = 'disease' THEN 1 ELSE -1 END AS insertion_mei_end", "0 AS left_anchor", "0 AS right_anchor", "'' AS coord_model")
    assert [(r["picked"], r["complex_source"]) for r in contigs.choose_sample(features).collect()] == [("disease", "control")]


def test_read_priority(spark):
    from pyspark.sql import functions as F

    base = {"is_secondary": False, "is_supplementary": False, "is_duplicate": False, "is_qcfail": False, "mate_is_unmapped": False, "is_proper_pair": True, "is_read1": True, "nm": 0, "mapq": 60, "cigar": "100M", "seq": "ACGT", "chrom": "c", "window_start": 1, "window_end": 9, "sample": "disease"}
    rows = [{**base, "read_name": "clean", "pos": 1}, {**base, "read_name": "clip", "pos": 5, "cigar": "80M20S"}, {**base, "read_name": "clip", "pos": 7}, {**base, "read_name": "told", "pos": 9}, {**base, "read_name": "dup", "pos": 2, "is_duplicate": True}, {**base, "read_name": "bare", "pos": 2, "seq": ""}]
    names = lambda n: {r["read_name"] for r in contigs.read_priority(spark.createDataFrame(rows), n, F.col("read_name") == "told").collect()}
    assert names(1) == {"told"} and names(2) == {"told", "clip"} and names(9) == {"told", "clip", "clean"}


def test_tail_like_duplications(spark):
    rows = spark.createDataFrame([("AATA", "x_rescue"), ("AATA", "tsd_disease"), ("ACTA", "x_rescue"), ("AAAAAAAAAC", "x_rescue"), ("", "x_rescue"), (None, "x_rescue")], "s string, src string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(breakpoints.tail_like_tsd(F.col("s"), F.col("src"))).collect()] == [True, False, False, True, False, False]


def test_effective_hits_and_fractions(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([(0.0, 0.5, "", "ALU", "", "AluY", "", "-", 10, 30, None, 280)], "score double, score_coord double, family string, family_coord string, target string, target_coord string, strand string, strand_coord string, alnlen long, alnlen_coord long, target_len long, target_len_coord long")
    r = support.effective(raw).collect()[0]
    assert (r["score"], r["family"], r["target"], r["strand"], r["alnlen"], r["target_len"]) == (0.5, "ALU", "AluY", "-", 30, 280)
    loci = spark.createDataFrame([(4, 2, 0, 0, 5, 0, True)], "disease_split_mei_supported_reads int, disease_discordant_mei_supported_reads int, control_split_mei_supported_reads int, control_discordant_mei_supported_reads int, disease_context_non_sv_reads int, control_context_non_sv_reads int, silver_stage_pass boolean")
    r = calls.allele_fractions(loci).collect()[0]
    assert (r["asm_disease_vaf"], r["asm_control_vaf"], r["asm_status"]) == (0.5, None, "heuristic_estimated")
    bare = calls.allele_fractions(loci.drop("disease_context_non_sv_reads").withColumn("silver_stage_pass", F.lit(True))).collect()[0]
    assert bare["asm_status"] == "heuristic_no_callable_reads"


def test_reference_around_breakpoints(spark):
    from pyspark.sql import functions as F

    from mobilome_spark.sources.text import reference_blocks

    text = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(25000))
    text = text[:12005] + "N" + text[12006:]
    blocks = reference_blocks(spark.createDataFrame([("chr1", text)], "name string, seq string"))
    cases = [(500, 511, 3, 0, 0, 0), (9995, 10003, 2, 0, 0, 0), (700, 690, 2, 700, 712, 1), (12000, 12010, 4, 0, 0, 0), (24980, 24999, 2, 0, 0, 0), (0, 90, 2, 0, 0, 0)]
    rows = [("chr1", k, *c, max(c[0], c[3])) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "chrom string, id int, disease_L_mei_breakpoint_mode long, disease_R_mei_breakpoint_mode long, disease_L_mei_supported_reads long, control_L_mei_breakpoint_mode long, control_R_mei_breakpoint_mode long, control_L_mei_supported_reads long, insertion_breakpoint_pos long")
    df = df.withColumns({"disease_R_mei_supported_reads": F.lit(1), "control_R_mei_supported_reads": F.lit(1), "tsd_left_breakpoint": F.lit(0), "tsd_right_breakpoint": F.lit(0), "tsd_len_estimate": F.lit(0), "tsd_evidence_source": F.lit(""), "insertion_orientation": F.lit("-")})
    out = breakpoints.rescue_tsd(breakpoints.near(df, blocks), [breakpoints.reference_rescue()])
    got = {r["id"]: r for r in breakpoints.sequence_metrics(out).collect()}
    for k, (dl, dr, dn, cl, cr, cn) in enumerate(cases):
        seeds = [(l, r, n + 1, s, src) for s, (l, r, n, src) in enumerate([(dl, dr, dn, "tsd_disease"), (cl, cr, cn, "tsd_control")]) if l > 0 and r > 0]
        tried = []
        for l0, r0, n, s, src in seeds:
            for a in range(-12, 13):
                for b in range(-12, 13):
                    l, r = l0 + a, r0 + b
                    here = text[l - 1 : r]
                    if l > 0 and 4 <= r - l + 1 <= 40 and len(here) == r - l + 1 and "N" not in here:
                        tried.append((abs(a) + abs(b), s, abs((l + r) // 2 - (seeds[0][0] + seeds[0][1]) // 2), -n, l - r, l, r, src))
        want = min(tried)[5:] if tried else (0, 0, "")
        row = got[k]
        assert (row["tsd_left_breakpoint"], row["tsd_right_breakpoint"], row["tsd_evidence_source"]) == (want[0], want[1], want[2] and want[2] + "_seq_rescue"), k
        assert row["tsd_seq"] == (text[want[0] - 1 : want[1]] if tried else "")
        bp = row["insertion_breakpoint_pos"]
        plain = text[bp - 6 : bp + 5] if bp > 5 else ""
        assert row["breakpoint_context"] == plain[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_clips_without_tails(spark):
    from pyspark.sql import functions as F

    from mobilome_spark.functions import seq

    a, b = "CGTCGGCTAGCCG", "GGCTCCGCATCGC"
    cases = [(a + "A" * 9 + b, "L", b), (a + "A" * 9 + b, "R", a), (a + "T" * 8 + "GC", "L", a), ("GCGCGC" + "A" * 9 + "CGCGCG", "L", "GCGCGCCGCGCG"), ("GC" + "A" * 9 + "C", "L", "GC" + "A" * 9 + "C"), (a + "AAAA" + b, "L", a + "AAAA" + b), ("", "L", ""), (None, "R", ""), (a.lower() + "a" * 8 + b, "", b), (a + "T" * 8 + b[:12], "", a)]
    rows = spark.createDataFrame([(c, s) for c, s, _ in cases], "c string, s string")
    assert [r[0] for r in rows.select(seq.without_tail(F.col("c"), F.col("s"))).collect()] == [w for *_, w in cases]


def test_full_panel(spark):
    """Element reads that only the full panel has are a sign too."""
    loci = spark.createDataFrame([("chr1", 1000, 1400), ("chr1", 2000, 2400)], "chrom string, window_start long, window_end long")
    split = spark.createDataFrame([clip(1, "disease", "L", f"r{i}", 1200, 5) for i in range(3)], SPLIT)
    pairs = spark.createDataFrame([pair(1, "control", "p", 1300, 40)], PAIR)
    got = {r["window_start"]: r for r in annotate.full_panel(loci, split, pairs).collect()}
    assert (got[1000]["disease_full_mei_supported_reads"], got[1000]["control_full_mei_supported_reads"], got[1000]["disease_full_L_mei_start"]) == (3, 1, 5)
    assert got[2000]["disease_full_mei_supported_reads"] == 0
    whole = {r["window_start"]: r for r in annotate.annotate(loci, spark.createDataFrame([], SPLIT), spark.createDataFrame([], PAIR), full=(split, pairs)).collect()}
    assert whole[1000]["silver_any_mei_support"] and not whole[2000]["silver_any_mei_support"]
