"""Registered queries of sources, sinks, services and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.functions import sql, tables
from strandlake.operators import align, envelopes, kmers, markers, prep, qc, quant, wavefront
from strandlake.plans import derive as D
from strandlake.plans import registry as R
from strandlake.plans.catalog import ORACLES, query
from strandlake.sources import fasta, grid, intervals, splits, uploads

# ------------------------------------------------------------------------------ files

RECORDS = f"{D.SEQS}, recs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS record_id, 'letters ' || length(sequence) AS description, sequence FROM seqs)"
RECORD = ("record_id", "description", "sequence")


def _records(spark, sf):
    return D.sequences(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("letters "), F.length("sequence").cast("string")).alias("description"), "sequence")


def _kept(spark, lines, suffix=""):
    return uploads.upload_path(spark, uploads.store(lines, suffix), suffix)


@query(f"WITH {RECORDS} SELECT record_id, description, sequence FROM recs")
def fasta_files(spark, sf):
    """Written as FASTA and read back in splits by Spark's text reader, so from any store."""
    return splits.read_splits(spark, _kept(spark, fasta.fasta_lines(_records(spark, sf))), "fasta").select(*RECORD)


@query(f"WITH {RECORDS} SELECT record_id, description, sequence FROM recs")
def fasta_ranges(spark, sf):
    """Written by the sink and read back by the data source, in many ranges of each file."""
    path = uploads.new_path(spark)
    fasta.register(spark)
    _records(spark, sf).drop("doc_id").coalesce(2).write.format("fasta").mode("append").save(path)
    return spark.read.format("fasta").option("splitBytes", 1 << 16).load(path).select(*RECORD)


@query(f"WITH {RECORDS} SELECT record_id, description, sequence FROM recs")
def fasta_split_files(spark, sf):
    """The same by Spark's text reader, which splits files."""
    return fasta.read_fasta_text(spark, _kept(spark, fasta.fasta_lines(_records(spark, sf)))).select(*RECORD)


@query(f"WITH {D.READS} SELECT CAST(doc_id AS VARCHAR) AS read_id, sequence, quality, '+' AS plus FROM reads WHERE length(sequence) > 0")
def fastq_files(spark, sf):
    """Reads with letters, written as FASTQ and read back: a FASTQ record can't be empty."""
    reads = D.reads(spark, sf).where(F.length("sequence") > 0).withColumn("read_id", F.col("doc_id").cast("string"))
    return splits.read_splits(spark, _kept(spark, fasta.fastq_lines(reads)), "fastq").select("read_id", "sequence", "quality", "plus")


@query(f"WITH {D.READS} SELECT CAST(doc_id AS VARCHAR) AS read_id, sequence, quality, '+' AS plus FROM reads WHERE length(sequence) > 0")
def fastq_ranges(spark, sf):
    """The same through the sink and the data source, a file for each task and in many ranges of it."""
    path = uploads.new_path(spark)
    fasta.register(spark)
    reads = D.reads(spark, sf).where(F.length("sequence") > 0).select(F.col("doc_id").cast("string").alias("read_id"), "sequence", "quality")
    reads.write.format("fastq").mode("append").save(path)
    return spark.read.format("fastq").option("splitBytes", 1 << 16).load(path).select("read_id", "sequence", "quality", "plus")


@query(f"WITH {RECORDS} SELECT record_id, doc_id % 50 AS start, doc_id % 50 + 40 AS \"end\", substr(sequence, doc_id % 50 + 1, 40) AS sequence FROM recs WHERE length(sequence) > doc_id % 50")
def fasta_intervals(spark, sf):
    """An interval of each record, read by its bytes through the offset index."""
    path, index = uploads.new_path(spark), uploads.new_path(spark)
    fasta.register(spark)
    records = _records(spark, sf)
    records.drop("doc_id").coalesce(2).write.format("fasta").mode("append").save(path)
    intervals.build_index(spark, path, index, split_bytes=1 << 16)
    start = F.col("doc_id") % 50
    wanted = records.select("record_id", start.alias("start"), (start + 40).alias("end"))
    return intervals.read_intervals(spark, index, wanted).drop("read_bytes")


@query(f"WITH {RECORDS} SELECT record_id, length(sequence) AS length FROM recs WHERE sequence <> ''")
def fasta_lengths(spark, sf):
    path, index = uploads.new_path(spark), uploads.new_path(spark)
    fasta.register(spark)
    _records(spark, sf).drop("doc_id").coalesce(2).write.format("fasta").mode("append").save(path)
    intervals.build_index(spark, path, index, split_bytes=1 << 16)
    return intervals.record_lengths(spark.read.parquet(index)).select("record_id", "length")


@query(f"WITH {D.READS} SELECT count(*) AS reads FROM reads WHERE length(sequence) > 0")
def fastq_read_count(spark, sf):
    reads = D.reads(spark, sf).where(F.length("sequence") > 0).withColumn("read_id", F.col("doc_id").cast("string"))
    return fasta.count_reads(spark, _kept(spark, fasta.fastq_lines(reads)))


@query(f"WITH {RECORDS} SELECT doc_id // 128 AS batch_id, count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS bases FROM recs GROUP BY 1")
def fasta_batches(spark, sf):
    batched = fasta.with_batches(_records(spark, sf).withColumn("record_index", F.col("doc_id")), 128)
    return batched.groupBy("batch_id").agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("bases"))


@query(f"WITH {RECORDS} SELECT count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS total_bases, arg_min(record_id, doc_id) AS first_id, arg_min(description, doc_id) AS first_description, CAST(arg_min(length(sequence), doc_id) AS INTEGER) AS first_length FROM recs")
def upload_facts(spark, sf):
    found = fasta.upload_summary(_records(spark, sf).withColumns({"source_file": F.lit("one"), "record_index": F.col("doc_id")}))
    return found.select("records", "total_bases", F.col("first.record_id").alias("first_id"), F.col("first.description").alias("first_description"), F.col("first.length").alias("first_length"))


@query(f"WITH {RECORDS} SELECT CAST(sum(length(sequence)) AS BIGINT) AS total_bases FROM recs")
def validated_bases(spark, sf):
    return fasta.validate_fasta(_records(spark, sf))


@query(f"""WITH {D.SEQS} SELECT sequence, CAST(doc_id AS INTEGER) AS start, CASE doc_id % 3 WHEN 0 THEN '-' ELSE '+' END AS strand FROM seqs""")
def parsed_reads(spark, sf):
    end = F.when(F.col("doc_id") % 3 == 0, " , - ").when(F.col("doc_id") % 3 == 1, ",").otherwise("")
    lines = D.sequences(spark, sf).select(F.concat(F.lower("sequence"), F.lit(", "), F.col("doc_id").cast("string"), end).alias("value"))
    return fasta.parse_reads(lines.unionByName(spark.createDataFrame([("",), ("  ",)], "value string")))


@query(f"WITH {D.SEQS} SELECT sequence FROM seqs WHERE sequence <> ''")
def parsed_sequences(spark, sf):
    return fasta.parse_sequences(D.sequences(spark, sf).select(F.concat(F.lit("  "), F.lower("sequence"), F.lit(" ")).alias("value")))


@query("""SELECT c_custkey AS line, c_custkey % 7 + CAST(0.5 AS DOUBLE) AS phenotype, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS DOUBLE) END AS d0, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE CAST(1 AS DOUBLE) END AS d1 FROM customer""")
def dosage_lines(spark, sf):
    key, text = F.col("c_custkey"), lambda x: F.format_string("%d", x)
    doses = F.concat_ws(" , ", F.when(key % 5 == 0, "").otherwise(text(key % 3)), F.when(key % 4 == 1, "NA").otherwise("1"))
    lines = D.table(spark, sf, "customer").select(key.alias("line"), F.concat(text(key % 7), F.lit(".5,"), doses).alias("value"))
    found = grid.parse_dosage_lines(lines)
    return found.select("line", "phenotype", F.get("dosages", F.lit(0)).alias("d0"), F.get("dosages", F.lit(1)).alias("d1"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx, CAST(n_nationkey AS VARCHAR) AS key, n_name || '; \"' AS name, CASE n_regionkey WHEN 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def grid_rows(spark, sf):
    """A small delimited file, with quotes, blank cells and a blank line, read as a grid."""
    n = D.table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    region = F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_regionkey").cast("string"))
    lines = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit('; "'), F.col("n_name"), F.lit('; """ ;'), region, F.lit("\n")).alias("value"))
    lines = lines.withColumn("value", F.replace("value", F.lit('; "'), F.lit(';"')))
    lines = lines.withColumn("value", F.replace("value", F.lit(';"""'), F.lit('; """')))
    cell = lambda k: F.get("cells", F.lit(k))
    return grid.load_grid(spark, _kept(spark, lines, ".csv")).select("row_idx", cell(0).alias("key"), cell(1).alias("name"), cell(2).alias("region"))


READS_EACH, READ_LENGTH = 40, 25


@query(f"WITH {D.REFS} SELECT ref_id, CAST({READS_EACH} AS BIGINT) AS reads, CAST({READS_EACH} AS BIGINT) AS faithful, CAST({READS_EACH * READ_LENGTH} AS BIGINT) AS good_scores FROM refs WHERE length(sequence) >= {READ_LENGTH}")
def simulated_reads(spark, sf):
    """Reads without errors: each is the reference's letters at its start, with scores of 30 to 40."""
    refs = D.references(spark, sf)
    reads = fasta.simulate_reads(refs, READS_EACH, READ_LENGTH, 0.0)
    same = F.substring("whole", F.col("start") + 1, F.lit(READ_LENGTH)) == F.col("sequence")
    good = F.size(F.filter(S.phred("quality"), lambda q: q.between(30, 40)))
    placed = reads.join(refs.select("ref_id", F.col("sequence").alias("whole")), "ref_id")
    return placed.groupBy("ref_id").agg(F.count_distinct("read_idx").alias("reads"), F.count_if(same).alias("faithful"), F.sum(good).cast("long").alias("good_scores"))


@query(f"WITH {RECORDS} SELECT record_id, 'two words' AS description, sequence FROM recs")
def fasta_lenient(spark, sf):
    """Headers without an id are left out, and runs of blanks in descriptions become one."""
    lines = _records(spark, sf).select(F.concat(F.lit(">"), F.col("record_id"), F.lit("  two   words\n"), F.col("sequence"), F.lit("\n>  \nACGT")).alias("value"))
    return splits.read_splits(spark, _kept(spark, lines), "fasta", True).select(*RECORD)


# ------------------------------------------------------------------------------ encoding

LETTER = "translate(upper(letter), 'U', 'T')"


@query(f"""SELECT letter, CASE WHEN instr('ACGTNRYSWKMBDHV', {LETTER}) > 0 THEN CAST(instr('ACGTNRYSWKMBDHV', {LETTER}) - 1 AS INTEGER) ELSE 4 END AS code, count(*) AS n
FROM (SELECT unnest(string_split(c_name || c_mktsegment, '')) AS letter FROM customer) GROUP BY letter""")
def encoded_letters(spark, sf):
    letters = D.table(spark, sf, "customer").select(F.explode(S.letters(F.concat("c_name", "c_mktsegment"))).alias("letter"))
    return letters.groupBy("letter").agg(F.count("*").alias("n")).select("letter", S.encode_char("letter").alias("code"), "n")


@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^ACGT]', 'N', 'g') AS affine, regexp_replace(c_name || '-', '[^ACGT-]', 'N', 'g') AS simple FROM customer")
def aligner_letters(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", S.aligner_letters("c_name").alias("affine"), S.simple_aligner_letters(F.concat("c_name", F.lit("-"))).alias("simple"))


def padded_sql(letters: str, padding: int) -> str:
    return f"""WITH s AS (SELECT c_custkey, {letters} AS s FROM customer), most AS (SELECT max(length(s)) AS m FROM s)
SELECT c_custkey, CAST(length(s) AS INTEGER) AS length, array_to_string(list_transform(range(1, m + 1), lambda i: CASE WHEN i > length(s) THEN {padding} ELSE instr('ACGTNRYSWKMBDHV', substr(s, i, 1)) - 1 END), ',') AS codes FROM s, most"""


def _joined(batch):
    return batch.select("c_custkey", "length", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(padded_sql(R.NORM.format("c_mktsegment"), 4))
def padded_batch(spark, sf):
    return _joined(S.encode_batch(D.table(spark, sf, "customer"), "c_mktsegment"))


@query(padded_sql("regexp_replace(upper(c_mktsegment), '[^ACGT]', 'N', 'g')", 9))
def padded_aligner_batch(spark, sf):
    return _joined(S.encode_batch(D.table(spark, sf, "customer"), "c_mktsegment", 9, S.aligner_letters("c_mktsegment")))


@query(f"""WITH {RECORDS}, b AS (SELECT doc_id, doc_id // 32 AS batch, sequence AS s FROM recs), most AS (SELECT batch, max(length(s)) AS m FROM b GROUP BY batch)
SELECT doc_id, CAST(length(s) AS INTEGER) AS length, CAST(m AS INTEGER) AS padded, CAST(coalesce(list_sum(list_transform(range(1, length(s) + 1), lambda i: instr('ACGTNRYSWKMBDHV', substr(s, i, 1)) - 1)), 0) + 9 * (m - length(s)) AS BIGINT) AS total FROM b JOIN most USING (batch)""")
def padded_by_batch(spark, sf):
    """Whole documents in batches of 32, each as wide as its longest."""
    found = S.encode_batch(D.sequences(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 32)), padding=9, batch="batch")
    return found.select("doc_id", "length", F.size("codes").alias("padded"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ------------------------------------------------------------------------------ quality and k-mers


@query(f"""WITH {D.SEQS}, c AS (SELECT {", ".join(f"sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS {b.lower()}" for b in "ACGT")} FROM seqs)
SELECT {", ".join(f"round(CAST({b} AS DOUBLE) / (a + c + g + t), 9) AS {b}" for b in "acgt")}, CAST(0 AS DOUBLE) AS n FROM c""")
def composition_shares(spark, sf):
    return qc.composition_shares(D.sequences(spark, sf)).select(*[F.round(b, 9).alias(b) for b in "acgtn"])


BY = "doc_id // 16 AS request"


@query(f"""WITH {D.READS}, r AS (SELECT {BY}, sequence, quality FROM reads),
f AS (SELECT request, count(*) AS num_sequences, round_even(avg({R.GC} * 100), 4) AS gc_content_percent, round_even(avg(length(sequence)), 1) AS mean_length,
{", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT")} FROM r GROUP BY request),
scores AS (SELECT request, i AS position, ascii(substr(quality, i, 1)) - 33 AS score FROM (SELECT request, quality, unnest(range(1, length(quality) + 1)) AS i FROM r)),
curve AS (SELECT request, position, sum(score) AS s, count(*) AS n, round_even(CAST(sum(score) AS DOUBLE) / greatest(count(*) FILTER (score > 0), 1), 2) AS m FROM scores GROUP BY request, position),
q AS (SELECT request, round_even(CAST(sum(s) AS DOUBLE) / sum(n), 2) AS quality_mean, count(*) AS positions, round(sum(m), 4) AS curve_sum FROM curve GROUP BY request)
SELECT * FROM f JOIN q USING (request)""")
def quality_service(spark, sf):
    """JSON requests of 16 documents' reads each, and an answer to each."""
    reads = D.reads(spark, sf).groupBy(F.floor(F.col("doc_id") / 16).alias("request")).agg(F.collect_list("sequence").alias("sequences"), F.collect_list("quality").alias("qualities"))
    lines = reads.select("request", F.to_json(F.struct("sequences", "qualities")).alias("value"))
    asked = envelopes.parse_requests(lines, "quality", "request")
    each = asked.select("request", F.explode(F.arrays_zip("sequences", "qualities")).alias("r")).select("request", F.col("r.sequences").alias("sequence"), F.col("r.qualities").alias("quality"))
    r = qc.reports_of(each, "request")
    total = F.aggregate("quality_by_position", F.lit(0.0), lambda a, x: a + x)
    return r.select("request", "num_sequences", "gc_content_percent", "mean_length", *[F.col("base_composition")[b].alias(b.lower()) for b in "ACGT"], "quality_mean", F.size("quality_by_position").cast("long").alias("positions"), F.round(total, 4).alias("curve_sum"))


@query(f"""{ORACLES["trim_by_quality"].replace("WITH ", "WITH trimmed AS (WITH ", 1)})
SELECT count(*) AS num_reads, CAST(sum(length(sequence)) AS BIGINT) AS total_bases, round(avg(length(sequence)), 6) AS mean_read_length,
  round((SELECT avg(score) FROM (SELECT ascii(substr(quality, i, 1)) - 33 AS score FROM (SELECT quality, unnest(range(1, length(quality) + 1)) AS i FROM trimmed))), 6) AS mean_quality,
  round(avg({R.GC} * 100), 6) AS gc_content_percent, {", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT")} FROM trimmed""")
def trim_report(spark, sf):
    """Figures of the trimmed reads, observed while these are written: one scan, one evaluation by Arrow."""
    trimmed, seen = qc.trim_with_report(D.reads(spark, sf), min_quality=12, window=R.W)
    trimmed.write.parquet(uploads.new_path(spark))
    facts = seen.get
    found = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in facts.items()))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


@query(f"""WITH {D.READS}, p AS (SELECT count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS bases, avg(length(sequence)) AS len, avg({R.GC} * 100) AS gc, {", ".join(f"CAST(sum(length(sequence) - length(replace(sequence, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGT")} FROM reads),
q AS (SELECT avg(score) AS mean FROM {R.SCORES})
SELECT unnest(['Reads: ' || n, 'Bases: ' || bases, 'Mean length: ' || printf('%.2f', len), 'Mean quality: ' || printf('%.2f', mean), 'GC percent: ' || printf('%.2f', gc), 'Letters: A=' || a || ', C=' || c || ', G=' || g || ', T=' || t || ', N=0']) AS line FROM p, q""")
def quality_summary(spark, sf):
    return qc.summary_lines(D.reads(spark, sf))


# ------------------------------------------------------------------------------ table functions in SQL


@query(ORACLES["kmer_count"])
def kmer_count_sql(spark, sf):
    tables.register(spark)
    sql.register(spark)
    D.sequences(spark, sf).select("sequence").createOrReplaceTempView("kmer_input")
    return spark.sql(f"SELECT kmer_decode(code, {R.K}) AS kmer, sum(n) AS count FROM kmer_table(TABLE(kmer_input), {R.K}, true) GROUP BY code")


@query(ORACLES["pileup_counts"])
def pileup_counts_sql(spark, sf):
    tables.register(spark)
    refs, reads = R._inputs(spark, sf)
    refs.createOrReplaceTempView("pileup_references")
    reads.createOrReplaceTempView("pileup_reads")
    return spark.sql("""
        WITH input AS (
          SELECT CAST(r.ref_id AS BIGINT) AS ref_id, p.sequence, p.quality, p.strand, p.start, CAST(length(r.sequence) AS BIGINT) AS length, p.start DIV 16384 AS tile
          FROM pileup_reads p JOIN pileup_references r ON p.ref_id = r.ref_id
        ), counted AS (
          SELECT ref_id, pos, sum(a) AS a, sum(c) AS c, sum(g) AS g, sum(t) AS t FROM pileup_table(TABLE(input) PARTITION BY (ref_id, tile), -1) GROUP BY ref_id, pos
        ), places AS (
          SELECT ref_id, CAST(i AS BIGINT) AS pos, letter AS ref_base FROM pileup_references LATERAL VIEW posexplode(split(sequence, '')) AS i, letter WHERE sequence <> ''
        )
        SELECT p.ref_id, p.pos, p.ref_base, coalesce(a, 0) AS a, coalesce(c, 0) AS c, coalesce(g, 0) AS g, coalesce(t, 0) AS t, coalesce(a + c + g + t, 0) AS depth,
          CASE WHEN a IS NULL THEN 'N' WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END AS consensus
        FROM places p LEFT JOIN counted q ON p.ref_id = q.ref_id AND p.pos = q.pos""")


@query(f"SELECT pair, score, aligned_query, aligned_target FROM ({ORACLES['align_pairs']})")
def align_pairs_sql(spark, sf):
    tables.register(spark)
    R._pairs(spark, sf).createOrReplaceTempView("align_input")
    return spark.sql("SELECT id AS pair, score, aligned_query, aligned_target FROM align_table(TABLE(SELECT CAST(pair AS BIGINT) AS id, query, target FROM align_input))")


@query("SELECT c_custkey AS k, list_value(c_name, c_mktsegment)[1] AS first, CAST(2 AS INTEGER) AS n, c_custkey % 2 = 0 AS canonical FROM customer")
def kmer_requests(spark, sf):
    """JSON requests, read by their schema."""
    lines = D.table(spark, sf, "customer").select(F.to_json(F.struct(F.array("c_name", "c_mktsegment").alias("sequences"), F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2 == 0).alias("canonical"))).alias("value"))
    return envelopes.parse_requests(lines, "kmers").select(F.col("k").cast("long").alias("k"), F.get("sequences", F.lit(0)).alias("first"), F.size("sequences").alias("n"), "canonical")


BOTH = f"seqs AS (SELECT {D.NUCLEOTIDES} AS sequence FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))"


@query(f'WITH {R.kmer_sql(R.K).replace(D.SEQS, BOTH)} SELECT kmer, "count" FROM counts')
def kmer_merge(spark, sf):
    return kmers.merge(kmers.count(D.sequences(spark, sf), R.K), kmers.count(D.references(spark, sf), R.K)).select("kmer", "count")


# ------------------------------------------------------------------------------ alignment and models


@query(ORACLES["align_pairs"])
def align_long(spark, sf):
    return wavefront.align_long(R._pairs(spark, sf), block=128).drop("query", "target").withColumn("identity_percent", F.round("identity_percent", 6))


@query(ORACLES["align_pairs"].replace("SELECT pair, score", "SELECT pair AS idx, score"))
def align_lists(spark, sf):
    pairs = R._pairs(spark, sf)
    found = align.align_lists(pairs.select(F.col("pair").alias("idx"), "query"), pairs.select(F.col("pair").alias("idx"), "target"))
    return found.drop("query", "target").withColumn("identity_percent", F.round("identity_percent", 6))


@query("""WITH base AS (SELECT n_regionkey AS grp, n_nationkey % 5 * CAST(1 AS DOUBLE) + n_regionkey * CAST(4 AS DOUBLE) + (n_nationkey * 7 % 11) * CAST(0.3 AS DOUBLE) AS y FROM nation),
g AS (SELECT grp, count(*) AS m, avg(y) AS mean FROM base GROUP BY grp), a AS (SELECT count(*) AS k, min(m) AS m, avg(mean) AS mean FROM g),
w AS (SELECT sum((y - mean) * (y - mean)) AS s, count(*) AS n FROM base JOIN g USING (grp)), b AS (SELECT sum((g.mean - a.mean) * (g.mean - a.mean)) AS s FROM g, a)
SELECT round((b.s * a.m / a.k - w.s / (w.n - a.k)) / a.m, 4) AS genetic_variance, round(w.s / (w.n - a.k), 4) AS residual_variance FROM a, w, b""")
def ml_oneway_balanced(spark, sf):
    """ML of the balanced one-way layout, which has a closed form as REML has, with the groups' mean square over k, not k - 1."""
    nation = D.table(spark, sf, "nation")
    y = F.col("n_nationkey") % 5 * 1.0 + F.col("n_regionkey") * 4.0 + (F.col("n_nationkey") * 7 % 11) * 0.3
    people = nation.select(F.lit("all").alias("group"), F.col("n_nationkey").alias("individual"), F.col("n_regionkey").alias("level"), y.alias("y"), F.array(F.lit(1.0)).alias("x"))
    unrelated = nation.select("n_regionkey").distinct().select(F.lit("all").alias("group"), F.col("n_regionkey").alias("i"), F.col("n_regionkey").alias("j"), F.lit(1.0).alias("value"))
    fits = quant.fit_groups(people, unrelated, "ml", kind="lmm")
    return fits.select(F.round("genetic_variance", 4).alias("genetic_variance"), F.round("residual_variance", 4).alias("residual_variance"))


def _fits(spark, sf):
    return quant.fit_groups(*R._oneway(spark, sf), genetic_variance=1.2, residual_variance=0.64)


ONEWAY_STEPS = R.ONEWAY[: R.ONEWAY.index("\nSELECT level")]


@query(f"""{ONEWAY_STEPS} SELECT individual, round(beta + n * CAST(1.2 AS DOUBLE) / (n * CAST(1.2 AS DOUBLE) + CAST(0.64 AS DOUBLE)) * (m - beta), 6) AS fitted FROM pheno JOIN w ON label = level, b""")
def model_predictions(spark, sf):
    found = quant.fitted(R._oneway(spark, sf)[0], _fits(spark, sf))
    return found.select("individual", F.round("value", 6).alias("fitted"))


@query(f"{ONEWAY_STEPS} SELECT round(avg(sqrt(CAST(1.2 AS DOUBLE) * (w - w * w / s))), 6) AS mean_accuracy, round(CAST(1.2 AS DOUBLE) / CAST(1.84 AS DOUBLE), 6) AS heritability FROM w, b")
def accuracy_summary(spark, sf):
    return quant.blup_summary(_fits(spark, sf)).select(F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("heritability", 6).alias("heritability"))


@query()
def gblup_genomic(spark, sf):
    """Breeding values of each label's individuals by their genomic relationships, variances by REML. No SQL: the optimum
    has no closed form; tests hold it against the solver of the relationship matrix."""
    people = D.phenotypes(spark, sf).select(F.col("label").cast("string").alias("group"), "individual", "y", F.array(F.lit(1.0)).alias("x"))
    return markers.fit_groups(people, D.genotypes(spark, sf))


@query()
def gblup_markers(spark, sf):
    """Breeding values of all individuals by REML through their marker rows. No SQL: the optimum has no closed form; tests hold
    it against the solver of one task."""
    people = D.phenotypes(spark, sf).select("individual", "y", F.array(F.lit(1.0), F.col("label").cast("double")).alias("x"))
    found = markers.fit(people, D.genotypes(spark, sf))
    return found.values.withColumn("heritability", F.lit(found.heritability))


@query(f"""WITH {D.CELLS} SELECT true AS header_detected, (SELECT count(*) + 1 FROM cells) AS rows_read, CAST(5 AS BIGINT) AS columns_total,
(SELECT coalesce(string_agg(name, ',' ORDER BY col), '') FROM (VALUES (1, 'm1'), (2, 'col_3'), (3, 'm3'), (4, 'm4')) AS h(col, name) WHERE col NOT IN (SELECT col FROM kept)) AS dropped_columns, (SELECT count(*) FROM people) AS final_rows""")
def prep_header(spark, sf):
    """A grid whose first row names the columns, one of them blank."""
    named = spark.createDataFrame([(-1, ["y", "m1", "", "m3", "m4"])], "row_idx long, cells array<string>")
    r = prep.preprocess(D.cells(spark, sf).unionByName(named), "mean")[2]
    return spark.createDataFrame([(r["header_detected"], r["rows_read"], r["columns_total"], ",".join(r["dropped_columns"]), r["final_rows"])], "header_detected boolean, rows_read long, columns_total long, dropped_columns string, final_rows long")
