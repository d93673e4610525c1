"""Readers and evidence extraction on small planted files."""

import gzip

from mobilome_spark.operators import evidence, loci
from mobilome_spark.sources import sinks, text


def test_tracks(spark, tmp_path):
    p = tmp_path / "t.bed.gz"
    p.write_bytes(gzip.compress(b"#c\nchr1\t5\t9\t0.5\n7\tchr2\t1\t4\t0.9\nchr1\t9\t9\nx\t1\t2\nchr3\ta\t2\n"))
    got = sorted(map(tuple, text.track(spark, str(p)).collect()))
    assert got == [("chr1", 5, 9, 0.5), ("chr2", 1, 4, 0.9)]
    assert [tuple(r) for r in text.closed(text.track(spark, str(p), below=0.6)).collect()] == [("chr1", 6, 9)]


def test_vcf_catalog(spark, tmp_path):
    p = tmp_path / "c.vcf"
    p.write_text(
        "##x\n#CHROM\nchr1\t10\t.\tA\t<INS:ME:ALU>\t.\t.\tSVTYPE=INS;MEINFO=AluYa5,1,280,+;SVLEN=280;TSD=ACG;END=12;FLAG\n"
        "chr1\t20\tb\tA\t<DEL>\t.\t.\tSVTYPE=DEL\nchr2\t30\tL1_x\tAC\t<INS>\t.\t.\tSVTYPE=INS;SVTYPE=DEL\n"
    )
    got = sorted(map(tuple, text.insertion_catalog(text.vcf(spark, str(p))).collect()))
    assert got == [("chr1", 10, 12, "chr1:10:INS", "ALU", "AluYa5", 280, "ACG"), ("chr2", 30, 31, "L1_x", "LINE1", "", 1, "")]


def test_paf_best_hits(spark, tmp_path):
    p = tmp_path / "h.paf"
    line = "q\t100\t0\t{}\t+\t{}\t300\t5\t90\t{}\t{}\t{}\n"
    p.write_text(line.format(90, "b", 85, 90, 60) + line.format(90, "a", 85, 90, 60) + line.format(50, "c", 50, 50, 0) + "short\t1\n")
    assert [(r.qname, r.tname) for r in text.best_hits(text.paf(spark, str(p))).collect()] == [("q", "a")]


def test_fasta_blocks(spark, tmp_path):
    p = tmp_path / "r.fa"
    p.write_text(">c1 x\nacgt\nAC\n>c2\n\n>c3\nTTTTTTTTTTTT\n")
    records = text.fasta(spark, str(p))
    assert sorted(map(tuple, records.collect())) == [("c1", "ACGTAC"), ("c2", ""), ("c3", "TTTTTTTTTTTT")]
    blocks = {(r.chrom, r.block_id): (r.block_start0, r.seq) for r in text.reference_blocks(records, 5, 2).collect()}
    assert blocks[("c1", 0)] == (0, "ACGTACx"[:6]) and blocks[("c1", 1)] == (5, "C") and len(blocks) == 6


def test_blocks_are_slices(spark):
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1003))
    records = spark.createDataFrame([("c", seq), ("e", ""), ("s", "AC")], "name string, seq string")
    for size, overlap in ((100, 20), (7, 20), (1003, 5), (10, 0)):
        got = sorted((r.chrom, r.block_id, r.block_start0, r.seq) for r in text.reference_blocks(records, size, overlap).collect())
        assert got == [(n, k, at, t[at : at + size + overlap]) for n, t in (("c", seq), ("e", ""), ("s", "AC")) for k, at in enumerate(range(0, max(len(t), 1), size))]


def test_evidence(spark, tmp_path):
    p, s = tmp_path / "a.sam", "ACGT" * 10
    row = "{}\t{}\tchr1\t100\t{}\t{}\t{}\t{}\t{}\t" + "{}\t*\tNM:i:2\n"
    p.write_text(
        "@HD\tx\n"
        + row.format("clip", 0, 60, "25S15M", "*", 0, 0, s)
        + row.format("poly", 0, 60, "30M10S", "*", 0, 0, s[:30] + "A" * 10)
        + row.format("short", 0, 60, "30M10S", "*", 0, 0, s)
        + row.format("low", 0, 5, "25S15M", "*", 0, 0, s)
        + row.format("inter", 1 | 64, 60, "40M", "chr2", 5, 0, s)
        + row.format("weak", 1 | 2 | 64, 60, "40M", "=", 150, 90, s)
    )
    reads = text.sam(spark, str(p), "disease")
    split = {r.read_name: r for r in evidence.split_evidence(reads).collect()}
    assert set(split) == {"clip", "poly"} and split["poly"].poly_tail_rescued
    assert (split["clip"].pos, split["clip"].clip_side, split["clip"].clip_len) == (100, "L", 25)
    assert (split["poly"].pos, split["poly"].clip_side, split["poly"].nm) == (129, "R", 2)
    got = evidence.discordant_evidence(reads).collect()
    assert [(r.read_name, r.discordant_reasons) for r in got] == [("inter", "improper_pair,interchrom,same_strand")]
    total = evidence.summary(reads).first()
    assert (total.total_reads_scanned, total.passing_reads) == (6, 5)


def test_discordant_poly_tail(spark, tmp_path):
    p, s = tmp_path / "a.sam", "ACGT" * 10
    row = "{}\t{}\tchr1\t100\t60\t40M\t=\t150\t90\t" + "{}\t*\n"
    p.write_text(row.format("tail", 1 | 64, "A" * 25 + s[:15]) + row.format("plain", 1 | 64, s) + row.format("usual", 1 | 2 | 32 | 64, "A" * 25 + s[:15]))
    reads = text.sam(spark, str(p), "disease")
    got = evidence.discordant_evidence(reads).collect()
    assert [(r.read_name, r.discordant_reasons, r.anchor_poly_side, r.anchor_poly_at_run) for r in got] == [("tail", "improper_pair,poly_tail_anchor_rescue,same_strand", "L", 25)]
    assert {r.read_name for r in evidence.discordant_evidence(reads, require_strong=False).collect()} == {"tail", "plain"}


def test_repeats_and_fastq_names(spark, tmp_path):
    p = tmp_path / "r.txt"
    full = "1\t2\t3\t4\t5\tchr1\t10\t20\t0\t+\tAluY\tSINE\tAlu\n"
    p.write_text("#h\n" + full + "chr2\t1\t9\t.\t.\t-\tL1HS\tLINE\nchr3\t5\t5\t.\t.\t-\tL1HS\tLINE\nchr4\t1\t2\t.\t.\t-\tMIR\tSINE\tMIR\n")
    got = sorted((r.chrom, r.start0, r.end0, r.rep_strand, r.rep_family) for r in text.repeats(spark, str(p)).collect())
    assert got == [("chr1", 10, 20, "+", "ALU"), ("chr2", 1, 9, "-", "LINE1"), ("chr4", 1, 2, "-", "")]
    f = tmp_path / "x.fastq.gz"
    f.write_bytes(gzip.compress(b"@a:1 z\nAC\n+\n@@\n@b:x:2\nAC\n+\nII\n@a:2\nA\n+\nI\n"))
    assert sorted(r.read_name for r in text.fastq_names(spark, str(f)).collect()) == ["a", "b:x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 5, 9, None, True), ("chr1", 7, 7, "x", None)], "chrom string, window_start long, window_end long, note string, ok boolean")
    sinks.write_table(df, str(tmp_path / "t"))
    assert sorted(spark.read.parquet(str(tmp_path / "t.parquet")).collect()) == sorted(df.collect())
    lines = [r.value for r in spark.read.text(str(tmp_path / "t.tsv")).collect()]
    assert "chr1\t5\t9\t\t1" in lines and "chrom\twindow_start\twindow_end\tnote\tok" in lines
    assert sorted(r.value for r in sinks.bed_lines(df).collect()) == ["chr1\t4\t9", "chr1\t6\t7"]


def test_candidate_loci_without_evidence(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text("clip\t0\tchr1\t100\t60\t25S15M\t*\t0\t0\t" + "ACGT" * 10 + "\t*\n")
    reads = text.sam(spark, str(p), "disease")
    one = loci.candidate_loci(evidence.split_evidence(reads), evidence.discordant_evidence(reads), {"disease": 1}).first()
    assert (one.window_start, one.window_end, one.split_disease_rows, one.discordant_control_rows, one.junk_flag_count) == (70, 130, 1, 0, 0)
    none = reads.filter("mapq > 99")
    assert loci.candidate_loci(evidence.split_evidence(none), evidence.discordant_evidence(none), {}).count() == 0


def test_manifests_and_orders(spark, tmp_path):
    for name, body in {"a": '{"status": "ok", "interval": {"start": 3}}', "b": "[1]", "c": "{broken", "d": ""}.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = {r.path[-6]: r.manifest for r in text.manifests(spark, f"{tmp_path}/*.json").collect()}
    assert got["a"] == {"status": "ok", "interval": '{"start":3}'} and not any(got.get(k) for k in "bcd")
    rows = spark.createDataFrame([("chr2", 5, None), ("chrM", 1, "x"), ("chr10", 9, "y"), ("Un", 2, ""), ("chrX", 3, "z"), ("chr2", 4, "w"), (None, 1, "n")], "chrom string, pos long, note string")
    assert [(r.chrom, r.pos) for r in sinks.in_vcf_order(rows).collect()] == [("chr2", 4), ("chr2", 5), ("chr10", 9), ("chrX", 3), ("chrM", 1), (None, 1), ("Un", 2)]
    assert sinks.manifest_lines(rows.filter("pos = 5").select("pos", "note", "chrom")).first().value == '{"chrom":"chr2","note":null,"pos":5}'
    sinks.write_table(rows.fillna("", ["chrom"]), str(tmp_path / "t"), order_by=("chrom", "pos"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 7
    loci = rows.selectExpr("chrom", "pos AS window_start", "pos AS window_end", "CAST(pos % 3 AS double) AS enrichment", "pos AS disease_rows")
    assert [r.window_start for r in sinks.enriched_first(loci).collect()] == [5, 2, 4, 1, 1, 9, 3]
