"""The registered queries with, where SQL can express them, the same in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.functions import vector as V
from strandlake.operators import align, kmers, pileup, prep, qc, quant
from strandlake.plans import derive as D
from strandlake.plans.catalog import ORACLES, QUERIES, Query, query
from strandlake.sources import fasta

K, SPECTRUM_K, MOTIF = 9, 11, "TATAA"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ------------------------------------------------------------------------------ sequences and encoding

NORM = "regexp_replace(translate(upper({0}), 'U', 'T'), '[^ACGTNRYSWKMBDHV]', 'N', 'g')"
CODES = "list_transform(range(1, length(sequence) + 1), lambda i: instr('ACGTNRYSWKMBDHV', substr(sequence, i, 1)) - 1)"


@query(f"WITH {D.SEQS} SELECT doc_id, len(c) AS n, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS total, array_to_string(c, ',') AS codes FROM (SELECT doc_id, {CODES} AS c FROM seqs)")
def seq_encode(spark, sf):
    codes = S.encode("sequence")
    coded = D.sequences(spark, sf).select("doc_id", codes.alias("c"))
    return coded.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("codes"))


@query(f"""WITH {D.SEQS} SELECT class, count(*) AS n FROM (SELECT unnest(list_transform({CODES}, lambda c: c % 5)) AS class FROM seqs) GROUP BY class""")
def seq_one_hot_counts(spark, sf):
    hot = D.sequences(spark, sf).select(F.explode(S.one_hot(S.encode("sequence"))).alias("v"))
    return hot.groupBy((F.array_position("v", F.lit(1.0).cast("float")) - 1).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {D.SEQS} SELECT doc_id, {NORM.format('sequence')} AS decoded FROM seqs")
def seq_decode(spark, sf):
    return D.sequences(spark, sf).select("doc_id", S.decode(S.pad(S.encode("sequence"), F.length("sequence") + 7), F.length("sequence")).alias("decoded"))


@query(f"WITH {D.SEQS} SELECT doc_id, translate(reverse(sequence), 'ACGTN', 'TGCAN') AS rc FROM seqs")
def revcomp(spark, sf):
    return D.sequences(spark, sf).select("doc_id", S.reverse_complement("sequence").alias("rc"))


@query(f"WITH {D.SEQS} SELECT doc_id, i - 1 AS position FROM (SELECT doc_id, sequence, unnest(range(1, length(sequence) - {len(MOTIF) - 2})) AS i FROM seqs WHERE length(sequence) >= {len(MOTIF)}) WHERE substr(sequence, i, {len(MOTIF)}) = '{MOTIF}'")
def motif_positions(spark, sf):
    return D.sequences(spark, sf).select("doc_id", F.explode(S.motif_positions("sequence", MOTIF)).alias("p")).select("doc_id", F.col("p").cast("long").alias("position"))


def _cut_sql() -> str:
    parts = [f"SELECT doc_id, '{e}' AS enzyme, i + {o} AS position FROM (SELECT doc_id, sequence, unnest(range(1, length(sequence) - {len(s) - 2})) AS i FROM seqs WHERE length(sequence) >= {len(s)}) WHERE substr(sequence, i, {len(s)}) = '{s}'" for e, (s, o) in S.ENZYMES.items()]
    return f"WITH {D.SEQS} {' UNION ALL '.join(parts)}"


@query(_cut_sql())
def restriction_sites(spark, sf):
    return S.cut_sites(D.sequences(spark, sf), "doc_id")


AMBIGUOUS_MOTIFS = {"box": "TATAWAW", "site": "RCCGGY", "short": "ACGTN", "palindrome": "GAATTC"}


def _motif_sql() -> str:
    turned = str.maketrans("ACGTNRYSWKMBDHV", "TGCANYRSWMKVHDB")
    parts = []
    for name, motif in AMBIGUOUS_MOTIFS.items():
        for strand, text in {"+": motif, "-": motif[::-1].translate(turned)}.items():
            if strand == "+" or text != motif:
                rx = "".join(f"[{V.AMBIGUOUS[x]}]" for x in text)
                parts.append(f"SELECT doc_id, '{name}' AS motif, '{strand}' AS strand, i - 1 AS position FROM (SELECT doc_id, sequence, unnest(range(1, length(sequence) - {len(text) - 2})) AS i FROM seqs WHERE length(sequence) >= {len(text)}) WHERE regexp_full_match(substr(sequence, i, {len(text)}), '{rx}')")
    return f"WITH {D.SEQS} {' UNION ALL '.join(parts)}"


@query(_motif_sql())
def motif_hits(spark, sf):
    return V.motif_hits(D.sequences(spark, sf), "doc_id", AMBIGUOUS_MOTIFS, both_strands=True)


@query(f"""WITH {D.SEQS}, recs AS (SELECT doc_id, 'NM_' || doc_id AS id, 'Homo sapiens gene ABC' || (doc_id % 9) || ' transcript variant ' || (doc_id % 5) || ', ' || CASE WHEN doc_id % 2 = 0 THEN 'mRNA' ELSE 'other' END AS d FROM seqs)
SELECT doc_id, id || ' ' || d AS header, id AS accession, 'Homo sapiens' AS species, 'ABC' || (doc_id % 9) AS gene, 'Transcript variant ' || (doc_id % 5) AS variant, CASE WHEN doc_id % 2 = 0 THEN 'mRNA' END AS type FROM recs""")
def header_metadata(spark, sf):
    described = F.concat(F.lit("Homo sapiens gene ABC"), (F.col("doc_id") % 9).cast("string"), F.lit(" transcript variant "), (F.col("doc_id") % 5).cast("string"), F.lit(", "), F.when(F.col("doc_id") % 2 == 0, "mRNA").otherwise("other"))
    recs = D.sequences(spark, sf).select("doc_id", F.concat(F.lit("NM_"), F.col("doc_id").cast("string")).alias("id"), described.alias("d"))
    return recs.select("doc_id", S.header("id", "d").alias("header"), *[c.alias(n) for n, c in S.parse_header("id", "d").items()])


@query(f"WITH {D.SEQS} SELECT doc_id, i AS fragment_start, substr(sequence, i + 1, 500) AS sequence FROM (SELECT doc_id, sequence, unnest(range(0, length(sequence), 500)) AS i FROM seqs WHERE length(sequence) > 0) WHERE length(substr(sequence, i + 1, 500)) >= 21")
def sequence_fragments(spark, sf):
    return fasta.fragments(D.sequences(spark, sf), 500).withColumn("fragment_start", F.col("fragment_start").cast("long"))


@query(f"WITH {D.SEQS} SELECT doc_id, '>' || doc_id || CASE WHEN length(sequence) > 0 THEN chr(10) || regexp_replace(regexp_replace(sequence, '(.{{60}})', '\\1' || chr(10), 'g'), '\\n$', '') ELSE '' END AS value FROM seqs")
def fasta_text(spark, sf):
    recs = D.sequences(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("description"), "sequence")
    return recs.select("doc_id", fasta.fasta_value().alias("value"))


# ------------------------------------------------------------------------------ quality control

VALID = "nullif(length(regexp_replace(sequence, '[^ACGT]', '', 'g')), 0)"
GC = f"coalesce(CAST(length(regexp_replace(sequence, '[^CG]', '', 'g')) AS DOUBLE) / {VALID}, 0)"
SCORES = "(SELECT doc_id, i - 1 AS position, ascii(substr(quality, i, 1)) - 33 AS score FROM (SELECT doc_id, quality, unnest(range(1, length(quality) + 1)) AS i FROM reads))"


@query(f"WITH {D.SEQS} SELECT doc_id, round({GC}, 9) AS gc, round({GC} * 100, 6) AS gc_percent FROM seqs")
def gc_content(spark, sf):
    return D.sequences(spark, sf).select("doc_id", F.round(S.gc_content("sequence"), 9).alias("gc"), F.round(S.gc_percent("sequence"), 6).alias("gc_percent"))


@query(f"WITH {D.SEQS} SELECT " + ", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT") + ", CAST(0 AS BIGINT) AS n FROM seqs")
def base_composition(spark, sf):
    return qc.composition(D.sequences(spark, sf))


@query(f"WITH {D.READS} SELECT doc_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, round(avg(score), 9) AS mean_score FROM {SCORES} GROUP BY doc_id")
def phred_scores(spark, sf):
    scored = D.reads(spark, sf).where(F.length("quality") > 0).select("doc_id", "quality", S.phred("quality").alias("s"))
    return scored.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round(S.mean_score("quality"), 9).alias("mean_score"))


@query(f"WITH {D.READS} SELECT position, round(CAST(sum(score) AS DOUBLE) / greatest(count(*) FILTER (score > 0), 1), 9) AS mean_quality FROM {SCORES} GROUP BY position")
def quality_distribution(spark, sf):
    return qc.quality_by_position(D.reads(spark, sf)).select(F.col("position").cast("long").alias("position"), F.round("mean_quality", 9).alias("mean_quality"))


W = 5


@query(f"""WITH {D.READS}, w AS (SELECT doc_id, position, sum(score) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS s, count(*) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS n FROM {SCORES}),
cuts AS (SELECT doc_id, min(position) AS cut FROM w WHERE n = {W} AND s < 12 * {W} GROUP BY doc_id)
SELECT doc_id, substr(sequence, 1, coalesce(cut, length(quality))) AS sequence, substr(quality, 1, coalesce(cut, length(quality))) AS quality FROM reads LEFT JOIN cuts USING (doc_id) WHERE coalesce(cut, length(quality)) > 0""")
def trim_by_quality(spark, sf):
    return qc.trim_by_quality(D.reads(spark, sf), min_quality=12, window=W)


@query(f"""WITH {D.READS}, m AS (SELECT doc_id, avg(score) AS mean FROM {SCORES} GROUP BY doc_id)
SELECT doc_id, length(sequence) AS n FROM reads LEFT JOIN m USING (doc_id) WHERE coalesce(mean, 0) >= 20 AND length(sequence) >= 20 AND CAST(length(sequence) - length(replace(sequence, 'N', '')) AS DOUBLE) / length(sequence) <= CAST(0.01 AS DOUBLE)""")
def filter_by_quality(spark, sf):
    return qc.filter_by_quality(D.reads(spark, sf), 20.0, 20, 0.01).select("doc_id", F.length("sequence").cast("long").alias("n"))


@query(f"""WITH {D.READS}, p AS (SELECT count(*) AS num_reads, CAST(sum(length(sequence)) AS BIGINT) AS total_bases, round(avg(length(sequence)), 6) AS mean_read_length, round(avg({GC} * 100), 6) AS gc_content_percent,
  {", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT")} FROM reads),
q AS (SELECT round(avg(score), 6) AS mean_quality FROM {SCORES}), c AS (SELECT position, CAST(sum(score) AS DOUBLE) / greatest(count(*) FILTER (score > 0), 1) AS m FROM {SCORES} GROUP BY position)
SELECT p.*, q.mean_quality, (SELECT count(*) FROM c) AS positions, (SELECT round(sum(m), 4) FROM c) AS curve_sum FROM p, q""")
def qc_report(spark, sf):
    r = qc.report(D.reads(spark, sf))
    return r.select(
        "num_reads", "total_bases", F.round("mean_read_length", 6).alias("mean_read_length"), F.round("gc_content_percent", 6).alias("gc_content_percent"), *[F.col("base_composition")[b].alias(b.lower()) for b in "ACGT"],
        F.round("mean_quality", 6).alias("mean_quality"), F.size("quality_by_position").cast("long").alias("positions"), F.round(F.aggregate("quality_by_position", F.lit(0.0), lambda a, x: a + x), 4).alias("curve_sum"),
    )


@query(f"""WITH {D.SEQS}, w AS (SELECT doc_id, substr(sequence, i + 1, 1000) AS sequence FROM (SELECT doc_id, sequence, unnest(range(0, length(sequence), 1000)) AS i FROM seqs WHERE length(sequence) > 0)),
b AS (SELECT sum({GC} * length(sequence)) AS gc, sum(length(sequence)) AS total, {", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT")} FROM w)
SELECT (SELECT count(*) FROM seqs) AS num_sequences, round(gc / total * 100, 3) AS gc_content_percent, round(CAST(total AS DOUBLE) / (SELECT count(*) FROM seqs), 3) AS mean_length, a, c, g, t FROM b""")
def qc_report_windowed(spark, sf):
    s = D.sequences(spark, sf)
    r = qc.windowed_report(s, 1000)
    exact = s.agg((F.sum(F.length("sequence")) / F.count("*")).alias("m"))
    return r.crossJoin(exact).select("num_sequences", F.round("gc_content_percent", 3).alias("gc_content_percent"), F.round("m", 3).alias("mean_length"), *[F.col("base_composition")[b].alias(b.lower()) for b in "ACGT"])


@query(f"""WITH {D.SEQS} SELECT doc_id, length(sequence) AS length, round({GC} * 100, 6) AS gc_percent, {", ".join(f"length(sequence) - length(replace(sequence, '{b}', '')) AS n_{b.lower()}" for b in "ACGT")},
length(sequence) - length(regexp_replace(sequence, '[^ACGT]', '', 'g')) AS others, substr(sequence, 1, 100) AS first_bases FROM seqs""")
def fasta_stats(spark, sf):
    r = qc.record_stats(D.sequences(spark, sf), "doc_id")
    return r.select("doc_id", "length", F.round("gc_percent", 6).alias("gc_percent"), "n_a", "n_c", "n_g", "n_t", "others", "first_bases")


@query(f"WITH {D.SEQS} SELECT count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS total_bases, round(avg(length(sequence)), 6) AS mean_length, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, round(avg({GC} * 100), 6) AS mean_gc_percent FROM seqs")
def dataset_stats(spark, sf):
    r = qc.dataset_stats(D.sequences(spark, sf))
    return r.select("records", "total_bases", F.round("mean_length", 6).alias("mean_length"), "min_length", "max_length", F.round("mean_gc_percent", 6).alias("mean_gc_percent"))


# ------------------------------------------------------------------------------ k-mers


def kmer_sql(k: int, canonical: bool = True) -> str:
    least = "least(w, translate(reverse(w), 'ACGT', 'TGCA'))" if canonical else "w"
    return f"""{D.SEQS}, kmers AS (SELECT {least} AS kmer FROM (SELECT substr(sequence, i, {k}) AS w FROM (SELECT sequence, unnest(range(1, length(sequence) - {k - 2})) AS i FROM seqs WHERE length(sequence) >= {k})) WHERE NOT contains(w, 'N')),
counts AS (SELECT kmer, count(*) AS "count" FROM kmers GROUP BY kmer)"""


def code_sql(k: int) -> str:
    return " + ".join(f"CAST(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1 AS BIGINT) * {4 ** (k - 1 - i)}" for i in range(k))


@query(f'WITH {kmer_sql(K)} SELECT kmer, "count" FROM counts')
def kmer_count(spark, sf):
    return kmers.count(D.sequences(spark, sf), K).select("kmer", "count")


@query(f'WITH {kmer_sql(K, False)} SELECT kmer, "count" FROM counts')
def kmer_count_noncanonical(spark, sf):
    return kmers.count(D.sequences(spark, sf), K, canonical=False).select("kmer", "count")


@query(f'WITH {kmer_sql(K)} SELECT kmer, {code_sql(K)} AS code, "count" FROM counts ORDER BY "count" DESC, code LIMIT 20')
def kmer_topk(spark, sf):
    return kmers.top(kmers.count(D.sequences(spark, sf), K))


@query(f'WITH {kmer_sql(K)} SELECT kmer, "count" FROM counts WHERE "count" >= 50')
def kmer_min_abundance(spark, sf):
    return kmers.count(D.sequences(spark, sf), K, min_abundance=50).select("kmer", "count")


@query(f"WITH {kmer_sql(31)} SELECT kmer, {code_sql(31)} AS code, kmer AS decoded, translate(reverse(kmer), 'ACGT', 'TGCA') AS rc FROM counts")
def kmer_codes(spark, sf):
    found = kmers.count_binned(D.sequences(spark, sf), 31)
    turned = found.withColumn("turned", S.reverse_complement_code("code", 31))
    return turned.select("kmer", "code", S.kmer_decode("code", 31).alias("decoded"), S.kmer_decode("turned", 31).alias("rc"))


@query(f'WITH {kmer_sql(31)} SELECT kmer, "count" FROM counts')
def kmer_count_binned(spark, sf):
    return kmers.count_binned(D.sequences(spark, sf), 31).select("kmer", "count")


@query(f'WITH {kmer_sql(K, False)} SELECT kmer, "count" FROM counts WHERE "count" >= 3')
def kmer_count_binned_one_strand(spark, sf):
    return kmers.count_binned(D.sequences(spark, sf), K, canonical=False, min_abundance=3, m=5, bins=64).select("kmer", "count")


@query(f'WITH {kmer_sql(SPECTRUM_K)} SELECT "count" AS multiplicity, count(*) AS n_kmers FROM counts GROUP BY 1')
def kmer_spectrum(spark, sf):
    return kmers.spectrum(kmers.count(D.sequences(spark, sf), SPECTRUM_K))


@query(f"""WITH {kmer_sql(SPECTRUM_K)}, s AS (SELECT "count" AS m, count(*) AS f FROM counts WHERE "count" >= 2 GROUP BY 1), peak AS (SELECT m FROM s ORDER BY f DESC, m LIMIT 1)
SELECT round(CAST((SELECT sum(m * f) FROM s) AS DOUBLE) / m, 6) AS genome_size, m AS coverage FROM peak""")
def genome_estimate(spark, sf):
    return kmers.estimate_genome_size(D.sequences(spark, sf), SPECTRUM_K).select(F.round("genome_size", 6).alias("genome_size"), "coverage")


@query(f'WITH {kmer_sql(K)} SELECT kmer, "count" FROM counts')
def kmer_windowed(spark, sf):
    return kmers.count(D.sequences(spark, sf), K, window=64).select("kmer", "count")


@query(f"""WITH {kmer_sql(21)}, coded AS (SELECT kmer, {code_sql(21)} AS code, "count" AS n FROM counts), best AS (SELECT * FROM coded ORDER BY n DESC, code LIMIT 20),
s AS (SELECT n AS m, count(*) AS f FROM coded GROUP BY 1)
SELECT 21 AS k, count(*) AS total_unique, CAST(sum(n) AS BIGINT) AS total_kmers, (SELECT string_agg(kmer || ':' || n, ',' ORDER BY n DESC, code) FROM best) AS top_kmers, (SELECT string_agg(m || ':' || f, ',' ORDER BY m) FROM s) AS spectrum,
round_even(CAST(sum(n) AS DOUBLE) / (SELECT m FROM s ORDER BY f DESC, m LIMIT 1), 0) AS genome_estimate FROM coded""")
def kmer_report(spark, sf):
    """All fields of the report."""
    r = kmers.report(D.sequences(spark, sf))
    top = F.array_join(F.transform("top_kmers", lambda x: F.concat_ws(":", x["kmer"], x["count"].cast("string"))), ",")
    curve = F.array_join(F.transform(F.array_sort(F.map_entries("spectrum")), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",")
    return r.select("k", "total_unique", "total_kmers", top.alias("top_kmers"), curve.alias("spectrum"), "genome_estimate")


# ------------------------------------------------------------------------------ pileup and variants

PILE = f"""{D.PLACED}, aligned AS (SELECT ref_id, start, CASE WHEN strand = '-' THEN translate(reverse(sequence), 'ACGT', 'TGCA') ELSE sequence END AS s, quality FROM placed),
bases AS (SELECT a.ref_id, start + i - 1 AS pos, substr(s, i, 1) AS base, ascii(substr(quality, i, 1)) - 33 AS q FROM (SELECT ref_id, start, s, quality, unnest(range(1, length(s) + 1)) AS i FROM aligned) a JOIN refs r USING (ref_id) WHERE start + i - 1 < length(r.sequence) AND start + i - 1 >= 0 AND substr(s, i, 1) IN ('A', 'C', 'G', 'T')),
places AS (SELECT ref_id, pos, {", ".join(f"count(*) FILTER (base = '{b}') AS {b.lower()}" for b in "ACGT")}, count(*) AS depth FROM bases GROUP BY ref_id, pos),
called AS (SELECT *, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS consensus FROM places),
dense AS (SELECT ref_id, i - 1 AS pos, substr(sequence, i, 1) AS ref_base, sequence FROM (SELECT ref_id, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM refs)),
piled AS (SELECT d.ref_id, d.pos, d.ref_base, coalesce(a, 0) AS a, coalesce(c, 0) AS c, coalesce(g, 0) AS g, coalesce(t, 0) AS t, coalesce(depth, 0) AS depth, coalesce(consensus, 'N') AS consensus FROM dense d LEFT JOIN called p ON d.ref_id = p.ref_id AND d.pos = p.pos),
snv AS (SELECT ref_id, pos + 1 AS position, ref_base AS ref, consensus AS alt, 'SNV' AS type, depth, greatest(a, c, g, t) AS alt_count, round(CAST(greatest(a, c, g, t) AS DOUBLE) / depth, 9) AS freq FROM piled WHERE depth >= 10 AND consensus <> ref_base AND ref_base <> 'N' AND CAST(greatest(a, c, g, t) AS DOUBLE) / depth >= 0.2),
gaps AS (SELECT ref_id, pos, depth, lag(pos) OVER w AS before, lag(depth) OVER w AS before_depth FROM called WINDOW w AS (PARTITION BY ref_id ORDER BY pos)),
del AS (SELECT ref_id, coalesce(before, -1) + 2 AS position, substr(sequence, coalesce(before, -1) + 2, pos - coalesce(before, -1) - 1) AS ref, '-' AS alt, 'DEL' AS type, 0 AS depth, 0 AS alt_count, CAST(1 AS DOUBLE) AS freq FROM gaps JOIN refs USING (ref_id)
  WHERE pos - coalesce(before, -1) - 1 >= 2 AND depth >= 2 AND (before IS NULL OR before_depth >= 2)),
calls AS (SELECT * FROM snv UNION ALL SELECT * FROM del)"""
CALL = ("ref_id", "position", "ref", "alt", "type", "depth", "alt_count")


def _inputs(spark, sf):
    return D.references(spark, sf), D.placed_reads(spark, sf)


@query(f"WITH {PILE} SELECT * FROM piled")
def pileup_counts(spark, sf):
    return pileup.pileup(*_inputs(spark, sf))


@query(f"WITH {PILE} SELECT d.ref_id, d.pos, count(*) FILTER (b.base = 'A') AS a, count(b.base) AS depth FROM dense d LEFT JOIN (SELECT * FROM bases WHERE q >= 20) b ON d.ref_id = b.ref_id AND d.pos = b.pos GROUP BY ALL")
def pileup_min_quality(spark, sf):
    return pileup.pileup(*_inputs(spark, sf), min_base_quality=20).select("ref_id", "pos", "a", "depth")


@query(f"WITH {PILE} SELECT ref_id, string_agg(consensus, '' ORDER BY pos) AS consensus FROM piled GROUP BY ref_id")
def consensus(spark, sf):
    return pileup.consensus_sequences(pileup.pileup(*_inputs(spark, sf)))


@query(f"WITH {PILE} SELECT * FROM snv")
def snv_calls(spark, sf):
    refs, reads = _inputs(spark, sf)
    return pileup.snvs(refs, pileup.covered(refs, reads)).select(*CALL, F.round("freq", 9).alias("freq"))


@query(f"WITH {PILE} SELECT * FROM del")
def deletion_calls(spark, sf):
    refs, reads = _inputs(spark, sf)
    return pileup.deletions(refs, pileup.covered(refs, reads)).select(*CALL, "freq")


@query(f"WITH {PILE} SELECT * FROM calls")
def variant_calls(spark, sf):
    return pileup.call_variants(*_inputs(spark, sf)).select(*CALL, F.round("freq", 9).alias("freq"))


@query(f"""WITH {PILE} SELECT r.ref_id, count(c.type) AS total_variants, count(*) FILTER (c.type = 'SNV') AS snvs, count(*) FILTER (c.type = 'DEL') AS deletions,
  any_value(round_even(CAST(coalesce(d.depth, 0) AS DOUBLE) / greatest(length(r.sequence), 1), 2)) AS mean_depth FROM refs r LEFT JOIN calls c USING (ref_id) LEFT JOIN (SELECT ref_id, sum(depth) AS depth FROM places GROUP BY ref_id) d USING (ref_id) GROUP BY r.ref_id""")
def variant_summary(spark, sf):
    return pileup.summary(*_inputs(spark, sf))


@query(f"WITH {PILE}, known AS (SELECT position, ref, alt, 'rs' || position AS rsid FROM (SELECT DISTINCT position, ref, alt FROM calls) WHERE position % 2 = 0) SELECT ref_id, position, ref, alt, type, rsid FROM calls JOIN known USING (position, ref, alt)")
def known_variant_match(spark, sf):
    calls = pileup.call_variants(*_inputs(spark, sf)).select("ref_id", "position", "ref", "alt", "type")
    known = calls.select("position", "ref", "alt").distinct().where("position % 2 = 0").withColumn("rsid", F.concat(F.lit("rs"), F.col("position").cast("string")))
    return align.match_known(calls, known).select("ref_id", "position", "ref", "alt", "type", "known_data.rsid")


# ------------------------------------------------------------------------------ alignment


def _pairs(spark, sf):
    """Each reference with the next one's letters in its middle: (pair, query, target)."""
    refs = D.references(spark, sf)
    n = F.floor(F.length("sequence") / 2).cast("int")
    changed = F.concat(F.substring("sequence", F.lit(1), n - 3), F.translate(F.substring("sequence", n - 2, F.lit(3)), "ACGT", "CATG"), F.substring("sequence", n + 3, F.length("sequence")))
    return refs.select(F.col("ref_id").alias("pair"), changed.alias("query"), F.col("sequence").alias("target"))


def align_sql(match: float, mismatch: float, opened: float, extended: float | None) -> str:
    """The dynamic programme by anti-diagonals: a row for each pair and query letter holds its last two cells, with the
    texts aligned so far, and its best cell."""
    up = f"CASE WHEN a.i > 1 THEN greatest(b.h1 + {opened}, b.u + {extended}) ELSE -1e9 END" if extended is not None else f"b.h1 + {opened}"
    left = f"CASE WHEN a.s + 1 - a.i > 1 THEN greatest(a.h1 + {opened}, a.l + {extended}) ELSE -1e9 END" if extended is not None else f"a.h1 + {opened}"
    return f"""{D.REFS}, half AS (SELECT *, length(sequence) // 2 AS n FROM refs),
pairs AS (SELECT ref_id AS pair, regexp_replace(substr(sequence, 1, n - 3) || translate(substr(sequence, n - 2, 3), 'ACGT', 'CATG') || substr(sequence, n + 3), '[^ACGT]', 'N', 'g') AS q, regexp_replace(sequence, '[^ACGT]', 'N', 'g') AS t FROM half),
dp(pair, i, s, m, n, x, t, h1, h2, u, l, q1, t1, q2, t2, best, bq, bt) USING KEY (pair, i) AS (
  SELECT pair, i, 0 AS s, length(q) AS m, length(t) AS n, substr(q, i, 1) AS x, t, CAST(0 AS DOUBLE) AS h1, CAST(0 AS DOUBLE) AS h2, CAST(-1e9 AS DOUBLE) AS u, CAST(-1e9 AS DOUBLE) AS l,
         '' AS q1, '' AS t1, '' AS q2, '' AS t2, CAST(0 AS DOUBLE) AS best, '' AS bq, '' AS bt
  FROM (SELECT pair, q, t, unnest(range(0, length(q) + 1)) AS i FROM pairs)
  UNION ALL
  SELECT pair, i, s, m, n, x, t, h, h2, u, l, cq, ct, q2, t2, greatest(h, best), CASE WHEN h > best THEN cq ELSE bq END, CASE WHEN h > best THEN ct ELSE bt END
  FROM (SELECT *, CASE WHEN live THEN greatest(0, d, u, l) ELSE 0 END AS h,
               CASE WHEN NOT live OR greatest(0, d, u, l) <= 0 THEN '' WHEN d >= greatest(u, l) THEN dq || x WHEN u >= l THEN uq || x ELSE lq || '-' END AS cq,
               CASE WHEN NOT live OR greatest(0, d, u, l) <= 0 THEN '' WHEN d >= greatest(u, l) THEN dt || y WHEN u >= l THEN ut || '-' ELSE lt || y END AS ct
        FROM (SELECT a.pair, a.i, a.s + 1 AS s, a.m, a.n, a.x, a.t, a.h1 AS h2, a.q1 AS q2, a.t1 AS t2, a.best, a.bq, a.bt, substr(a.t, a.s + 1 - a.i, 1) AS y,
                     a.i > 0 AND a.s + 1 - a.i BETWEEN 1 AND a.n AS live, b.h2 + CASE WHEN a.x = substr(a.t, a.s + 1 - a.i, 1) THEN {match} ELSE {mismatch} END AS d,
                     CASE WHEN a.i > 0 AND a.s + 1 - a.i BETWEEN 1 AND a.n THEN {up} ELSE -1e9 END AS u, CASE WHEN a.i > 0 AND a.s + 1 - a.i BETWEEN 1 AND a.n THEN {left} ELSE -1e9 END AS l,
                     b.q2 AS dq, b.t2 AS dt, b.q1 AS uq, b.t1 AS ut, a.q1 AS lq, a.t1 AS lt
              FROM dp a LEFT JOIN dp b ON a.pair = b.pair AND b.i = a.i - 1 WHERE a.s < a.m + a.n))),
ends AS (SELECT pair, best AS score, bq AS aligned_query, bt AS aligned_target FROM dp WHERE s = m + n QUALIFY row_number() OVER (PARTITION BY pair ORDER BY best DESC, i) = 1)"""


ALIGNED = align_sql(2, -1, -2, -0.5)
ALIGNED_COLUMNS = "cols AS (SELECT pair, j, substr(aligned_query, j, 1) AS q, substr(aligned_target, j, 1) AS t FROM (SELECT *, unnest(range(1, length(aligned_query) + 1)) AS j FROM ends))"
FOUND = f"""{ALIGNED}, {ALIGNED_COLUMNS}, numbered AS (SELECT *, CAST(count(*) FILTER (t <> '-') OVER (PARTITION BY pair ORDER BY j) AS INTEGER) AS position FROM cols),
changes AS (SELECT pair, position, replace(t, '-', '') AS ref, replace(q, '-', '') AS alt, CASE WHEN q = '-' THEN 'DELETION' WHEN t = '-' THEN 'INSERTION' ELSE 'SNV' END AS type FROM numbered WHERE q <> t),
measured AS (SELECT pair, CAST(count(*) FILTER (q = t) AS DOUBLE) / count(*) * 100 AS identity_percent FROM cols GROUP BY pair)"""


@query(f"""WITH RECURSIVE {ALIGNED}, {ALIGNED_COLUMNS},
facts AS (SELECT pair, count(*) AS n, count(*) FILTER (q = t AND q <> '-') AS same, count(*) FILTER (q = '-' OR t = '-') AS gaps, count(*) FILTER (q <> t AND q <> '-' AND t <> '-') AS mismatches,
  string_agg(CASE WHEN q = t THEN 'M' WHEN q = '-' THEN 'D' WHEN t = '-' THEN 'I' ELSE 'X' END, '' ORDER BY j) AS ops FROM cols GROUP BY pair)
SELECT pair, score, aligned_query, aligned_target, CAST(n AS INTEGER) AS alignment_length, round(CAST(same AS DOUBLE) / n * 100, 6) AS identity_percent, CAST(gaps AS INTEGER) AS gaps, CAST(mismatches AS INTEGER) AS mismatches,
  array_to_string(list_transform(regexp_extract_all(ops, 'M+|D+|I+|X+'), lambda r: length(r) || r[1]), '') AS cigar FROM ends JOIN facts USING (pair)""")
def align_pairs(spark, sf):
    return align.align_pairs(_pairs(spark, sf)).drop("query", "target").withColumn("identity_percent", F.round("identity_percent", 6))


@query(f"WITH RECURSIVE {FOUND} SELECT * FROM changes")
def mutations(spark, sf):
    return align.find_variants(align.align_pairs(_pairs(spark, sf)), "pair")


@query(f"""WITH RECURSIVE {FOUND}, known AS (SELECT DISTINCT position, ref, alt FROM changes WHERE type = 'SNV'),
kinds AS (SELECT pair, count(*) AS total_variants, count(*) FILTER (type = 'SNV') AS snvs, count(*) FILTER (type = 'INSERTION') AS insertions, count(*) FILTER (type = 'DELETION') AS deletions FROM changes GROUP BY pair),
matches AS (SELECT pair, count(*) AS known_matches FROM changes JOIN known USING (position, ref, alt) GROUP BY pair)
SELECT pair, score AS alignment_score, round(identity_percent, 6) AS identity_percent, coalesce(total_variants, 0) AS total_variants, coalesce(snvs, 0) AS snvs, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions, coalesce(known_matches, 0) AS known_matches
FROM ends LEFT JOIN measured USING (pair) LEFT JOIN kinds USING (pair) LEFT JOIN matches USING (pair)""")
def mutation_stats(spark, sf):
    aligned = align.align_pairs(_pairs(spark, sf)).persist()
    known = align.find_variants(aligned, "pair").where("type = 'SNV'").select("position", "ref", "alt").distinct()
    return align.mutation_stats(aligned, known, "pair").withColumn("identity_percent", F.round("identity_percent", 6))


@query(f"""WITH RECURSIVE {align_sql(2, -1, -1, None)}, {ALIGNED_COLUMNS}, numbered AS (SELECT *, count(*) FILTER (t <> '-') OVER (PARTITION BY pair ORDER BY j) AS position FROM cols),
found AS (SELECT pair, CAST(count(*) AS INTEGER) AS n, string_agg(position || t || '>' || q || '@' || (j - 1), ',' ORDER BY j) AS changed FROM numbered WHERE q <> t AND q <> '-' AND t <> '-' GROUP BY pair)
SELECT pair AS idx, score, aligned_query, aligned_target, coalesce(changed, '') AS mutations, coalesce(n, 0) AS mutation_count FROM ends LEFT JOIN found USING (pair)""")
def align_simple(spark, sf):
    pairs = _pairs(spark, sf)
    found = align.align_simple(pairs.select(F.col("pair").alias("idx"), "query"), pairs.select(F.col("pair").alias("idx"), "target")).drop("query", "target")
    each = F.transform("mutations", lambda m: F.concat(m["position"].cast("string"), m["ref"], F.lit(">"), m["alt"], F.lit("@"), m["alignment_pos"].cast("string")))
    return found.withColumn("mutations", F.array_join(each, ","))


# ------------------------------------------------------------------------------ quantitative genetics

STATS = f"{D.GENO}, stats AS (SELECT marker, avg(dosage) / 2 AS p FROM geno GROUP BY marker), spread AS (SELECT marker, p, 2 * p * (1 - p) AS s FROM stats)"


def _gram_sql(z: str, total: str, where: str = "") -> str:
    return f"""WITH {STATS}, z AS (SELECT individual, marker, {z} AS z FROM geno JOIN spread USING (marker) {where})
SELECT a.individual AS i, b.individual AS j, round(sum(a.z * b.z) / (SELECT {total} FROM spread {where}), 6) + 0 AS value FROM z a JOIN z b ON a.marker = b.marker GROUP BY 1, 2"""


def _six_places(value: str):
    """Rounded as in the SQL, by arithmetic on doubles: ``F.round`` makes a decimal of each, which took longer than the products."""
    return F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6 + 0


@query(_gram_sql("coalesce(dosage, 2 * p) - 2 * p", "sum(s)"))
def grm_vanraden(spark, sf):
    return quant.kinship(D.genotypes(spark, sf)).select("i", "j", _six_places("value").alias("value"))


@query(_gram_sql("(coalesce(dosage, 2 * p) - 2 * p) / sqrt(s)", "CAST(count(*) AS DOUBLE)", "WHERE s > 0"))
def grm_gcta(spark, sf):
    return quant.kinship(D.genotypes(spark, sf), "gcta").select("i", "j", _six_places("value").alias("value"))


def oneway_sql(level: str) -> str:
    return f"""WITH {D.PHENO}, g AS (SELECT {level} AS level, count(*) AS n, avg(y) AS m FROM pheno GROUP BY 1), w AS (SELECT *, n / (n * CAST(1.2 AS DOUBLE) + CAST(0.64 AS DOUBLE)) AS w FROM g), b AS (SELECT sum(w * m) / sum(w) AS beta, sum(w) AS s FROM w)
SELECT level, round(n * CAST(1.2 AS DOUBLE) / (n * CAST(1.2 AS DOUBLE) + CAST(0.64 AS DOUBLE)) * (m - beta), 6) AS value, round(CAST(1.2 AS DOUBLE) * (w - w * w / s), 6) AS reliability, round(beta, 6) AS beta FROM w, b"""


ONEWAY, ONEWAY40 = oneway_sql("label"), oneway_sql("CAST(individual % 40 AS INTEGER)")


def _oneway(spark, sf, level="label"):
    p = D.phenotypes(spark, sf).withColumn("level", F.expr(level).cast("int"))
    people = p.select(F.lit("all").alias("group"), "individual", "level", "y", F.array(F.lit(1.0)).alias("x"))
    levels = p.select("level").distinct()
    return people, levels.select(F.lit("all").alias("group"), F.col("level").alias("i"), F.col("level").alias("j"), F.lit(1.0).alias("value"))


@query(ONEWAY)
def gblup_oneway_fixed(spark, sf):
    """Individuals are added up by level in the cluster; the task of an analysis is cubic in its levels."""
    fits = quant.fit_groups(*_oneway(spark, sf), genetic_variance=1.2, residual_variance=0.64)
    rows = fits.select(F.element_at("fixed_effects", 1).alias("beta"), F.explode("blup").alias("b")).select("b.*", "beta")
    return rows.select(F.col("individual").cast("int").alias("level"), F.round("value", 6).alias("value"), F.round("reliability", 6).alias("reliability"), F.round("beta", 6).alias("beta"))


@query(f"SELECT row_number() OVER (ORDER BY value DESC, level) AS place, level, value FROM ({ONEWAY40}) ORDER BY value DESC, level LIMIT 15")
def blup_top15(spark, sf):
    """Values are rounded before they are ordered, as in the SQL: of equal ones the smaller level is first."""
    fits = quant.fit_groups(*_oneway(spark, sf, "individual % 40"), genetic_variance=1.2, residual_variance=0.64)
    best = quant.top_blup(fits.withColumn("blup", F.transform("blup", lambda b: b.withField("value", F.round(b["value"], 6)))), 15)
    return best.selectExpr("row_number() OVER (ORDER BY value DESC, individual) AS place", "cast(individual AS int) AS level", "value").withColumn("place", F.col("place").cast("long"))


@query("""WITH base AS (SELECT n_regionkey AS grp, n_nationkey % 5 * CAST(1 AS DOUBLE) + n_regionkey * CAST(4 AS DOUBLE) + (n_nationkey * 7 % 11) * CAST(0.3 AS DOUBLE) AS y FROM nation),
g AS (SELECT grp, count(*) AS m, avg(y) AS mean FROM base GROUP BY grp), a AS (SELECT count(*) AS k, min(m) AS m, avg(mean) AS mean FROM g),
w AS (SELECT sum((y - mean) * (y - mean)) AS s, count(*) AS n FROM base JOIN g USING (grp)), b AS (SELECT sum((g.mean - a.mean) * (g.mean - a.mean)) AS s FROM g, a)
SELECT round(((b.s * a.m / (a.k - 1)) - w.s / (w.n - a.k)) / a.m, 4) AS genetic_variance, round(w.s / (w.n - a.k), 4) AS residual_variance FROM a, w, b""")
def reml_oneway_balanced(spark, sf):
    """REML of a balanced one-way layout, nations in regions, is the analysis of variance."""
    nation = D.table(spark, sf, "nation")
    y = F.col("n_nationkey") % 5 * 1.0 + F.col("n_regionkey") * 4.0 + (F.col("n_nationkey") * 7 % 11) * 0.3
    people = nation.select(F.lit("all").alias("group"), F.col("n_nationkey").alias("individual"), F.col("n_regionkey").alias("level"), y.alias("y"), F.array(F.lit(1.0)).alias("x"))
    labels = nation.select("n_regionkey").distinct()
    fits = quant.fit_groups(people, labels.select(F.lit("all").alias("group"), F.col("n_regionkey").alias("i"), F.col("n_regionkey").alias("j"), F.lit(1.0).alias("value")), kind="lmm")
    return fits.select(F.round("genetic_variance", 4).alias("genetic_variance"), F.round("residual_variance", 4).alias("residual_variance"))


# ------------------------------------------------------------------------------ cleaning


@query(f"WITH {D.CELLS}, f AS (SELECT marker, avg(dosage) AS fill FROM body GROUP BY marker) SELECT individual, marker, round(coalesce(dosage, fill), 9) AS dosage FROM body JOIN f USING (marker)")
def impute_mean(spark, sf):
    return prep.preprocess(D.cells(spark, sf), "mean")[1].select("individual", "marker", F.round("dosage", 9).alias("dosage"))


@query(f"""WITH {D.CELLS}, n AS (SELECT marker, dosage, count(*) AS n FROM body WHERE dosage IS NOT NULL GROUP BY ALL), f AS (SELECT marker, dosage AS fill FROM n QUALIFY row_number() OVER (PARTITION BY marker ORDER BY n DESC, dosage) = 1)
SELECT individual, marker, coalesce(dosage, fill) AS dosage FROM body JOIN f USING (marker)""")
def impute_mode(spark, sf):
    return prep.preprocess(D.cells(spark, sf), "mode")[1]


@query(f"""WITH {D.CELLS} SELECT (SELECT count(*) FROM cells) AS rows_read, (SELECT count(*) FROM cells) - (SELECT count(*) FROM people) AS dropped_rows, (SELECT count(*) FROM body WHERE dosage IS NULL) AS imputed_cells, (SELECT count(*) FROM people) AS final_rows, (SELECT count(*) FROM kept) AS final_markers""")
def prep_report(spark, sf):
    r = prep.preprocess(D.cells(spark, sf), "mean")[2]
    return spark.createDataFrame([(r["rows_read"], r["dropped_rows_no_phenotype"], r["imputed_cells"], r["final_rows"], r["final_markers"])], "rows_read long, dropped_rows long, imputed_cells long, final_rows long, final_markers long")


from strandlake.plans import services  # noqa: E402, F401  registers its queries, which share the SQL above
