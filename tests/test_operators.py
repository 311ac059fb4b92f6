import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.functions import seq as S
from strandlake.functions import vector as V
from strandlake.operators import align, envelopes, kmers, pileup, prep, qc, quant

SEQ = "ACGT" * 10


def one(spark, *columns, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return tuple(spark.createDataFrame([tuple(values.values())], names).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# ------------------------------------------------------------------------------ functions


def test_encoding(spark):
    got = one(spark, S.encode("s"), S.decode(S.encode("s")), S.encode("s", False), S.encode(F.lit("")), S.pad(S.encode("s"), 12), S.reverse_complement("s"), S.aligner_letters("s"), S.simple_aligner_letters("s"), s="acGUNRkx-")
    assert got[0] == [0, 1, 2, 3, 4, 5, 9, 4, 4] and got[1] == "ACGTNRKNN" and got[2] == [0, 1, 2, 3, 4, 4, 4, 4, 4] and got[3] == []
    assert len(got[4]) == 12 and got[4][9:] == [4, 4, 4] and got[5] == "NNNNNACGT" and got[6] == "ACGNNNNNN" and got[7] == "NNGNNNNN-"
    hot = one(spark, S.one_hot(S.encode("s")), S.one_hot(S.encode("s"), False), S.decode(F.array(F.lit(0), F.lit(99), F.lit(-1), F.lit(3)), 3), s="RKN")
    assert [r.index(1.0) for r in hot[0]] == [0, 4, 4] and hot[1] == [[1.0, 0, 0, 0], [0.0] * 4, [0.0] * 4] and hot[2] == "ANN"
    assert one(spark, S.encode_char(F.lit("u")), S.encode_char(F.lit("?")), s="x") == (3, 4)


def test_scalars(spark):
    got = one(spark, S.gc_content("s"), S.gc_content(F.lit("NN")), S.motif_positions("s", "cg"), S.cut_positions(F.lit("AAGAATTCGAATTC"), "EcoRI"), S.header(F.lit("i"), F.lit("")), S.header(F.lit("i"), F.lit("d e")), s="GCGCAT")
    assert abs(got[0] - 4 / 6) < 1e-12 and got[1:] == (0.0, [1], [4, 10], "i", "i d e")
    assert one(spark, S.phred("s"), S.phred(F.lit("")), S.mean_score("s"), S.mean_score(F.lit("")), V.mean_score("s"), V.mean_score(F.lit("")), s="I!") == ([40, 0], [], 20.0, 0.0, 20.0, 0.0)
    meta = one(spark, *S.parse_header("i", "d").values(), i="NM_1", d="Homo sapiens tumor TP53, Transcript  variant 2, mRNA.")
    assert meta == ("NM_1", "Homo sapiens", "TP53", "Transcript  variant 2", "mRNA")
    assert one(spark, *S.parse_header("i", F.lit(None).cast("string")).values(), i="x") == ("x", None, None, None, None)


def test_codes(spark):
    rng = random.Random(1)
    for k in (1, 5, 31):
        km = "".join(rng.choices("ACGT", k=k))
        code = sum("ACGT".index(c) * 4 ** (k - 1 - i) for i, c in enumerate(km))
        rc = km[::-1].translate(str.maketrans("ACGT", "TGCA"))
        got = one(spark, S.kmer_code("s"), S.kmer_decode(S.kmer_code("s"), k), S.kmer_decode(S.reverse_complement_code(S.kmer_code("s"), k), k), S.canonical("s"), s=km)
        assert got == (code, km, rc, min(km, rc))


# ------------------------------------------------------------------------------ quality control


def reads(spark, rows):
    return spark.createDataFrame(rows, "read_id string, sequence string, quality string")


def test_trim_and_filter(spark):
    df = reads(spark, [("a", "ACGTACGT", "IIII####"), ("b", "ACG", "###"), ("c", "ACGTACGT", "########"), ("d", "", ""), ("e", "ACGTACGT", "IIIIIIII")])
    got = {r.read_id: r.sequence for r in qc.trim_by_quality(df, 20, 2).collect()}
    assert got == {"a": "ACGT", "e": "ACGTACGT"}
    rng = random.Random(2)
    quals = ["".join(chr(33 + rng.randrange(41)) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(quals)), "i long, q string")
    for w, t in ((1, 20), (5, 18), (7, 22.5)):
        both = rows.select("i", V.trim_position("q", t, w).alias("v"), S.trim_position("q", t, w).alias("s")).collect()
        for r in both:
            scores = [ord(c) - 33 for c in quals[r.i]]
            want = next((i for i in range(len(scores) - w + 1) if sum(scores[i : i + w]) / w < t), len(scores))
            assert (r.v, r.s) == (want, want)
    df = reads(spark, [("g", "ACGT" * 9, "I" * 36), ("h", "ACGT" * 9, "!" * 36), ("n", "NnAC" * 9, "I" * 36)])
    assert [r.read_id for r in qc.filter_by_quality(df, 20, 10).collect()] == ["g"]


def test_reports(spark):
    r = qc.report(reads(spark, [("a", "AAATTT", "I!"), ("b", "ACGN", "II")])).first()
    assert r.base_composition == {"A": 4, "C": 1, "G": 1, "T": 3, "N": 0} and r.quality_by_position == [40.0, 40.0] and r.mean_quality == 30.0
    assert (r.num_reads, r.total_bases, r.mean_read_length) == (2, 10, 5.0) and abs(r.gc_content_percent - 100 / 3) < 1e-9
    empty = qc.report(reads(spark, [])).first()
    assert (empty.num_reads, empty.total_bases, empty.mean_quality, empty.quality_by_position) == (0, 0, 0.0, [])
    w = qc.windowed_report(spark.createDataFrame([("GGNN" + "AT",)], "sequence string"), 4).first()
    assert (w.num_sequences, w.gc_content_percent, w.mean_length) == (1, round(4 / 6 * 100, 4), 6.0)
    assert qc.windowed_report(spark.createDataFrame([("",)], "sequence string")).first().num_sequences == 0
    a = envelopes.analyze_quality(spark, ["GCGCAT", "AA"], ["IIIIII"]).first()
    assert (a.num_sequences, a.gc_content_percent, a.mean_length, a.quality_mean) == (2, 33.3333, 4.0, 40.0)
    assert envelopes.analyze_quality(spark, []).first().num_sequences == 0


# ------------------------------------------------------------------------------ k-mers


def brute_kmers(seqs, k, canonical=True):
    out = {}
    for s in seqs:
        s = s.upper().replace("U", "T")
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                w = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) if canonical else w
                out[w] = out.get(w, 0) + 1
    return out


def test_kmer_counts(spark):
    rng = random.Random(3)
    seqs = ["TTGCAACCTTGCAAGGNACCTTGCAA", "", "AC", "NNNN", "acguacguNacgt", "".join(rng.choices("ACGT", k=4000))]
    df = spark.createDataFrame([(s,) for s in seqs] + [(None,)], "sequence string")
    for k, canonical, window in ((5, True, None), (31, False, None), (8, True, 8), (12, True, 40)):
        got = {r.kmer: r["count"] for r in kmers.count(df, k, canonical, window=window).collect()}
        assert got == brute_kmers(seqs, k, canonical)
        assert {r.kmer: r.n for r in kmers.kmers(df, k, canonical).groupBy("kmer").agg(F.count("*").alias("n")).collect()} == got
    own = "CCATG" * 9 + "AATT"
    top = kmers.top(kmers.count(spark.createDataFrame([(own,)], "sequence string"), 6)).first()
    want = brute_kmers([own], 6, True)
    assert (top.kmer, top["count"]) == min(want.items(), key=lambda x: (-x[1], x[0]))
    assert kmers.count(spark.createDataFrame([("GAATTC",)], "sequence string"), 6).count() == 1
    for bad in (0, 32):
        with pytest.raises(ValueError):
            kmers.count(df, bad)
    with pytest.raises(ValueError):
        kmers.count(df, 5, window=3)


def test_spectrum_and_size(spark):
    counts = spark.createDataFrame([("A", 0, 1), ("C", 1, 2), ("G", 2, 2), ("T", 3, 1)], "kmer string, code long, count long")
    assert {r.multiplicity: r.n_kmers for r in kmers.spectrum(counts).collect()} == {1: 2, 2: 2}
    assert tuple(kmers.genome_size(counts).first()) == (6.0, 1) and tuple(kmers.genome_size(counts.limit(0)).first()) == (0.0, 0)
    r = envelopes.count_kmers(spark, [SEQ], 8).first()
    assert r.k == 8 and r.top_kmers[0].kmer == "CGTACGTA" and r.total_kmers == 33 and sum(m * n for m, n in r.spectrum.items()) == 33
    assert envelopes.count_kmers(spark, [], 8).first().total_unique == 0
    assert kmers.merge(counts, counts).where("kmer = 'C'").first()["count"] == 4


# ------------------------------------------------------------------------------ pileup


def test_variants(spark):
    ref = "".join(random.Random(4).choices("ACG", k=40))
    ref = ref[:10] + "G" + ref[11:]
    alt = ref[:10] + "T" + ref[11:]
    rows = [{"sequence": alt[s : s + 15], "start": s} for s in (0, 5, 10, 15) for _ in range(4)]
    r = envelopes.call_variants(spark, ref, rows, 3, 0.8).first()
    assert (r.total_variants, r.snvs, r.deletions) == (1, 1, 0) and (r.variants[0].position, r.variants[0].ref, r.variants[0].alt) == (11, "G", "T")
    minus = [{"sequence": x["sequence"][::-1].translate(str.maketrans("ACGT", "TGCA")), "start": x["start"], "strand": "-"} for x in rows]
    assert envelopes.call_variants(spark, ref, minus, 3, 0.8).first().variants == r.variants
    assert envelopes.call_variants(spark, ref, [], 3, 0.8).first().total_variants == 0


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_deletions_equal_a_scan(spark, span):
    rng = random.Random(5)
    refs, places, want = [], [], []
    for r in range(30):
        n = rng.randrange(5, 60)
        text = "".join(rng.choices("ACGT", k=n))
        depth = [rng.choice([0, 0, 0, 1, 2, 5]) for _ in range(n)]
        refs.append((r, text))
        places += [(r, p, d) for p, d in enumerate(depth) if d]
        p = 0
        while p < n:
            q = p
            while q < n and depth[q] == 0:
                q += 1
            if q - p >= 2 and q < n and depth[q] >= 2 and (p == 0 or depth[p - 1] >= 2):
                want.append((r, p + 1, text[p:q]))
            p = max(q, p + 1)
    got = pileup.deletions(spark.createDataFrame(refs, "ref_id int, sequence string"), spark.createDataFrame(places, "ref_id int, pos long, depth long"), span=span)
    assert sorted((r.ref_id, r.position, r.ref) for r in got.collect()) == sorted(want)


def test_base_quality(spark):
    refs = spark.createDataFrame([(1, "ACGT")], "ref_id int, sequence string")
    one_read = spark.createDataFrame([(1, "ACGT", 0, "+", "I!I"), (1, "ACGTA", 2, "+", None), (1, "AC", -1, "+", "II"), (9, "AC", 0, "+", "II")], "ref_id int, sequence string, start int, strand string, quality string")
    got = {r.pos: (r.depth, r.consensus, r.ref_base) for r in pileup.pileup(refs, one_read, 20).collect()}
    assert got == {0: (2, "A", "A"), 1: (0, "N", "C"), 2: (1, "G", "G"), 3: (0, "N", "T")}
    assert pileup.consensus_sequences(pileup.pileup(refs, one_read)).first().consensus == "ACAC"


# ------------------------------------------------------------------------------ alignment

GOLD = [
    ("ACGTACGT", "ACGTTCGT", 13.0, "ACGTACGT", "ACGTTCGT", "4M1X3M"),
    ("ACGTACGTACGTTT", "ACGTACGTACGTTT", 28.0, "ACGTACGTACGTTT", "ACGTACGTACGTTT", "14M"),
    ("ACGTACGTGGTTACCA", "ACGTACGTTTACCA", 25.5, "ACGTACGTGGTTACCA", "ACGTACGT--TTACCA", "8M2I6M"),
    ("ACGTACGTTTACCA", "ACGTACGTGGTTACCA", 25.5, "ACGTACGT--TTACCA", "ACGTACGTGGTTACCA", "8M2D6M"),
    ("ACGUNN", "ACGTNN", 9.0, "ACGNNN", "ACGTNN", "3M1X2M"),
    ("AAAA", "CCCC", 0.0, "", "", ""),
    ("ATGATTTATGTGGC", "ATAACTGTGGA", 11.5, "TTA-TGTGG", "TAACTGTGG", "1M1X1M1D5M"),
    ("GGCCTTCAACCCTC", "GGCCTACCCTC", 19.0, "GGCCTTCAACCCTC", "GGCC-T--ACCCTC", "4M1I1M2I6M"),
    ("", "ACGT", 0.0, "", "", ""),
]


def direct(q, t, match=2.0, mismatch=-1.0, gap_open=-2.0, gap_extend=-0.5):
    """Scores straight from the definition, cubic in the length."""
    h = np.zeros((len(q) + 1, len(t) + 1), np.float32)
    for i, j in itertools.product(range(1, len(q) + 1), range(1, len(t) + 1)):
        gaps = [h[i - k, j] + gap_open + gap_extend * (k - 1) for k in range(1, i)] + [h[i, j - k] + gap_open + gap_extend * (k - 1) for k in range(1, j)]
        h[i, j] = max([0.0, h[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else mismatch), *gaps])
    return float(h.max())


def test_alignments(spark):
    df = spark.createDataFrame([(k, q, t) for k, (q, t, *_) in enumerate(GOLD)], "k int, query string, target string")
    got = {r.k: r for r in align.align_pairs(df).collect()}
    for k, (q, t, score, aq, at, cigar) in enumerate(GOLD):
        r = got[k]
        assert (r.score, r.aligned_query, r.cigar) == (score, aq, cigar), (q, t)
        if k != 6:
            assert r.aligned_target == at
        assert r.gaps == aq.count("-") + r.aligned_target.count("-") and r.alignment_length == len(aq)
    assert got[0].identity_percent == 87.5 and got[0].mismatches == 1
    rng = random.Random(6)
    pairs = [("".join(rng.choices("ACGT", k=rng.randrange(1, 25))), "".join(rng.choices("ACGT", k=rng.randrange(1, 25)))) for _ in range(60)]
    assert [x[0] for x in align.local_alignments(pairs, 2.0, -1.0, -2.0, -0.5)] == [direct(*p) for p in pairs]


def test_mutations(spark):
    df = spark.createDataFrame([(1, "ACGTACGTGGTTACCA", "ACGTACGTTTACCA"), (2, "ACGTACGT", "ACGTTCGT")], "k int, query string, target string")
    aligned = align.align_pairs(df)
    found = align.find_variants(aligned, "k").orderBy("k", "position", "alt").collect()
    assert [tuple(r) for r in found] == [(1, 8, "", "G", "INSERTION"), (1, 8, "", "G", "INSERTION"), (2, 5, "T", "A", "SNV")]
    known = spark.createDataFrame([(5, "T", "A", "g1", "rs1"), (5, "T", "A", "g2", "rs2"), (9, "T", "A", "g3", "rs3")], "position int, ref string, alt string, gene string, rsid string")
    assert sorted(r.known_data.rsid for r in align.match_known(align.find_variants(aligned, "k"), known).collect()) == ["rs1", "rs2"]
    stats = {r.k: r for r in align.mutation_stats(aligned, known, "k").collect()}
    assert (stats[1].total_variants, stats[1].insertions, stats[2].snvs, stats[2].known_matches) == (2, 2, 1, 2)
    simple = align.align_simple(spark.createDataFrame([(0, "ACGTACGT"), (1, "acgt")], "idx int, query string"), spark.createDataFrame([(0, "ACGTTCGT")], "idx int, target string")).orderBy("idx").collect()
    assert simple[0].score == 13.0 and [tuple(m) for m in simple[0].mutations] == [(5, "T", "A", 4)] and simple[1].target == "ACGTTCGT" and simple[1].score == 0.0
    with pytest.raises(Exception, match="differ in number"):
        align.align_lists(spark.createDataFrame([(0, "A"), (1, "C")], "idx int, query string"), spark.createDataFrame([(0, "A")], "idx int, target string")).collect()


# ------------------------------------------------------------------------------ quantitative genetics


def genotypes(n, m, seed):
    rng = np.random.default_rng(seed)
    return rng.binomial(2, rng.uniform(0.1, 0.9, m), (n, m)).astype(float)


def dense(z, method="vanraden"):
    p = np.nanmean(z, axis=0) / 2
    c = np.where(np.isnan(z), 0, z - 2 * p)
    s = 2 * p * (1 - p)
    return c @ c.T / s.sum() if method == "vanraden" else (c[:, s > 0] / np.sqrt(s[s > 0])) @ (c[:, s > 0] / np.sqrt(s[s > 0])).T / (s > 0).sum()


def long(spark, z):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(z) for j, v in enumerate(r)], "individual long, marker int, dosage double")


@pytest.mark.parametrize("method", ["vanraden", "gcta"])
def test_kinship(spark, method):
    z = genotypes(20, 60, 7)
    z[1], z[3, 5], z[4, 6] = z[0], np.nan, np.nan
    z[:, 9] = 2
    rows = quant.kinship(long(spark, z), method).collect()
    k = np.zeros((20, 20))
    for r in rows:
        k[r.i, r.j] = r.value
    assert len(rows) == 400 and np.allclose(k, dense(z, method), atol=1e-10)
    with pytest.raises(ValueError):
        quant.kinship(long(spark, z), "other")
    with pytest.raises(Exception, match="no variation"):
        quant.kinship(long(spark, np.zeros((10, 5))), method).collect()


def simulated(n, m, g, e, seed):
    rng = np.random.default_rng(seed)
    k = dense(genotypes(n, m, seed))
    u = np.linalg.cholesky(k + 1e-6 * np.eye(n)) @ rng.standard_normal(n) * np.sqrt(g)
    return k, u, 2 + u + rng.standard_normal(n) * np.sqrt(e)


def test_mixed_model():
    k, u, y = simulated(200, 400, 0.6, 0.4, 42)
    model = quant.LinearMixedModel().fit(y, np.ones((200, 1)), k)
    assert model.result["converged"] and np.corrcoef(model.blup(), u)[0, 1] > 0.5 and abs(model.result["heritability"] - 0.6) < 0.35
    assert model.predict().shape == (200,)
    y = 3 + np.random.default_rng(1).standard_normal(150)
    assert abs(quant.LinearMixedModel().fit(y, np.ones((150, 1)), np.eye(150)).blue()[0] - 3) < 0.3
    for bad in ({"method": "x"}, {"x": np.ones((3, 1))}, {"k": np.ones((2, 3))}, {"k": np.triu(np.ones((150, 150)))}, {"x": np.ones((150, 150))}, {"z": np.ones((2, 2))}):
        args = {"y": y, "x": np.ones((150, 1)), "k": np.eye(150)} | bad
        with pytest.raises(ValueError):
            quant.variance_components(**args)
    with pytest.raises(RuntimeError):
        quant.LinearMixedModel().blup()
    with pytest.raises(RuntimeError):
        quant.Rotated.of(np.arange(3.0), np.ones((3, 1)), -np.eye(3), np.eye(3)).diagonal(1.0, 0.5)


def test_reliabilities_equal_the_mixed_model_equations():
    rng = np.random.default_rng(8)
    q, g, e = 30, 1.2, 0.64
    a = rng.standard_normal((q, q))
    k, x, y = a @ a.T / q + np.eye(q), np.column_stack([np.ones(q), rng.standard_normal(q)]), rng.standard_normal(q)
    found = quant.genomic_blup(y, x, k, None, g, e)
    left = np.block([[x.T @ x / e, x.T / e], [x / e, np.eye(q) / e + np.linalg.inv(k) / g]])
    inverse, solution = np.linalg.inv(left), np.linalg.solve(left, np.concatenate([x.T @ y / e, y / e]))
    assert np.allclose(found["u"], solution[2:], atol=1e-8) and np.allclose(found["reliability"], np.clip(1 - np.diag(inverse)[2:] / (g * np.diag(k)), 0, 1), atol=1e-8)
    assert np.allclose(found["accuracy"] ** 2, found["reliability"]) and quant.genomic_blup(y, x, k, None, 0.0, 1.0)["reliability"].sum() == 0
    with pytest.raises(ValueError):
        quant.genomic_blup(y, x, k, None, 1.0)


def test_fit_services(spark):
    z = genotypes(12, 30, 9)
    y = (z[:, 0] + np.random.default_rng(2).standard_normal(12)).tolist()
    r = envelopes.fit_mixed_model(spark, y, z.tolist()).first()
    k = dense(z)
    model = quant.LinearMixedModel().fit(y, np.ones((12, 1)), k)
    assert (r.n_individuals, r.n_markers, r.converged) == (12, 30, True) and abs(r.heritability - model.result["heritability"]) < 1e-5
    assert [b.individual for b in r.blup] == list(range(1, 13)) and np.allclose([b.value for b in r.blup], model.blup(), atol=1e-5)
    p = envelopes.predict_breeding_values(spark, y, z.tolist(), genetic_variance=0.6, residual_variance=0.4).first()
    given = quant.GenomicBLUP().fit(y, np.ones((12, 1)), k, None, 0.6, 0.4)
    assert p.variance_source == "given" and p.log_likelihood is None and np.allclose([b.reliability for b in p.blup], given.reliabilities(), atol=1e-5)
    for bad in ((y[:4], z[:4].tolist()), (y, z[:5].tolist())):
        with pytest.raises(ValueError):
            envelopes.fit_mixed_model(spark, *bad)


# ------------------------------------------------------------------------------ cleaning


def grid(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_idx long, cells array<string>")


def test_cleaning(spark):
    rows = [["feno", "m1", "m2", "sexo"], ["1", "0", "1", "M"], ["2", "", "2", "F"], ["3", "2", "0", "M"], ["4", "1", "", "F"], ["5", "2", "1", "M"], ["6", "1", "0", "F"], ["NA", "9", "9", "M"]]
    people, body, report = prep.preprocess(grid(spark, rows))
    assert report["header_detected"] and report["dropped_columns"] == ["sexo"] and report["imputed_cells"] == 2 and report["dropped_rows_no_phenotype"] == 1
    assert (report["final_rows"], report["final_markers"], report["rows_read"], report["columns_total"]) == (6, 2, 8, 4)
    dosage = {(r.individual, r.marker): r.dosage for r in body.collect()}
    assert abs(dosage[1, 0] - 1.2) < 1e-12 and abs(dosage[3, 1] - 0.8) < 1e-12 and [r.y for r in people.orderBy("individual").collect()] == [1, 2, 3, 4, 5, 6]
    plain = [["2,5", "1", "0"], ["1", "1", "nan"], ["1", "", "2"], ["1", "0", "2"], ["2,5", "2", "0"]]
    people, body, report = prep.preprocess(grid(spark, plain), "moda")
    dosage = {(r.individual, r.marker): r.dosage for r in body.collect()}
    assert not report["header_detected"] and dosage[2, 0] == 1.0 and dosage[1, 1] == 0.0 and people.orderBy("individual").first().y == 2.5
    for bad, how in ((plain[:3], "mean"), ([r[:2] for r in plain], "mean"), (plain, "other")):
        with pytest.raises(ValueError):
            prep.preprocess(grid(spark, bad), how)
