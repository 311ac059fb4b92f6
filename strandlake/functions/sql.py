"""The scalar functions under SQL names. They are SQL expressions, inlined by the optimiser."""

from __future__ import annotations

from pyspark.sql import SparkSession

NORM = "regexp_replace(translate(upper(s), 'U', 'T'), '[^ACGTNRYSWKMBDHV]', 'N')"
COUNT = "length({0}) - length(translate({0}, '{1}', ''))"
FUNCTIONS = {
    "seq_normalise(s STRING)": ("STRING", NORM),
    "revcomp(s STRING)": ("STRING", "translate(reverse(regexp_replace(upper(s), '[^ACGTNU]', 'N')), 'ACGTU', 'TGCAA')"),
    "gc_content(s STRING)": ("DOUBLE", f"coalesce(CAST({COUNT.format(NORM, 'CG')} AS DOUBLE) / nullif({COUNT.format(NORM, 'ACGT')}, 0), IF(s IS NULL, NULL, 0D))"),
    "kmer_code(s STRING)": ("BIGINT", "CAST(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT)"),
    "kmer_decode(code BIGINT, k INT)": ("STRING", "translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT')"),
    "kmer_canonical(s STRING)": ("STRING", "least(s, translate(reverse(s), 'ACGT', 'TGCA'))"),
    "phred_scores(q STRING)": ("ARRAY<INT>", "IF(length(q) > 0, transform(split(q, ''), c -> ascii(c) - 33), IF(q IS NULL, NULL, CAST(array() AS ARRAY<INT>)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
