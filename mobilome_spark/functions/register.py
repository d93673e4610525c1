"""The scalar functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Signature, result and body of each; the bodies say in SQL what the Column builders of this package say, and a test holds them equal.
FUNCTIONS = {
    "canonical_read_name(name STRING)": ("STRING", r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(coalesce(name, ''), r'^\s+|\s+$', ''), '^@', ''), r'(\S+)', 1), '/[12]$', ''), ':[012]$', '')"),
    "chrom_style(chrom STRING, prefixed BOOLEAN)": ("STRING", "CASE WHEN NOT prefixed THEN regexp_replace(chrom, '^chr', '') WHEN startswith(chrom, 'chr') THEN chrom ELSE concat('chr', chrom) END"),
    "revcomp(seq STRING)": ("STRING", "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"),
    "poly_at_run(seq STRING)": ("INT", "coalesce(array_max(transform(regexp_extract_all(coalesce(seq, ''), '(A+|T+)', 1), r -> length(r))), 0)"),
    "poly_at_fraction(seq STRING)": ("DOUBLE", "coalesce(length(regexp_replace(seq, '[^AT]', '')) / nullif(length(seq), 0), 0D)"),
    "normalized_clip(seq STRING)": ("STRING", "left(regexp_replace(upper(coalesce(seq, '')), '[^ACGT]', ''), 80)"),
    "vcf_end(pos BIGINT, ref STRING, info STRING)": ("BIGINT", "greatest(coalesce(try_cast(regexp_extract(concat(';', coalesce(info, '')), ';END=([^;]*)', 1) AS BIGINT), pos + greatest(length(coalesce(ref, '')), 1) - 1), pos)"),
    "panel_element(header STRING)": ("STRING", "regexp_replace(regexp_replace(regexp_replace(coalesce(header, ''), '(?s)#.*$', ''), '(?i)_(3end|5end|orf2)$', ''), '(?i)_short_?$', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Make every function of ``FUNCTIONS`` a temporary one of the session; their names. They are
    plain expressions that the optimizer sees through; a second call replaces them."""
    for signature, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
