"""Column functions over nucleotide sequences: built-in expressions, so Catalyst can push and fuse them, but for motifs.

Alphabet codes: A C G T N are 0 to 4, and R Y S W K M B D H V, if asked for, 5 to 14. U counts as T; case is ignored;
anything else is N.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import vector

# The order of letters gives their codes.
CANONICAL, IUPAC = "ACGTN", "RYSWKMBDHV"
N_CODE = 4
# Recognition sites of common restriction enzymes and the offset of the cut on the upper strand.
ENZYMES = {"EcoRI": ("GAATTC", 1), "BamHI": ("GGATCC", 1), "HindIII": ("AAGCTT", 1), "NotI": ("GCGGCCGC", 2), "XbaI": ("TCTAGA", 1)}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(seq: Column | str, iupac: bool = True) -> Column:
    """Upper case, U as T, letters outside the alphabet as N."""
    letters = "ACGTN" + (IUPAC if iupac else "")
    return F.regexp_replace(F.translate(F.upper(col(seq)), "U", "T"), f"[^{letters}]", "N")


def letters(seq: Column) -> Column:
    """The characters as an array; an empty text has none."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def piece(seq: Column, start: Column, length: Column | int) -> Column:
    """Substring from a 1-based place of an ASCII text; unlike on text, the cost doesn't grow with the place."""
    return F.substring(seq.cast("binary"), start, F.lit(length) if isinstance(length, int) else length).cast("string")


def encode(seq: Column | str, iupac: bool = True) -> Column:
    """Codes of the letters, an array of int."""
    alphabet = CANONICAL + (IUPAC if iupac else "")
    return F.transform(letters(normalise(seq, iupac)), lambda c: F.instr(F.lit(alphabet), c) - 1)


def encode_char(letter: Column | str, iupac: bool = True) -> Column:
    """The code of one letter; N's for what isn't a letter of the alphabet."""
    alphabet = CANONICAL + (IUPAC if iupac else "")
    at = F.instr(F.lit(alphabet), normalise(letter, iupac))
    return F.when(at > 0, at - 1).when(at == 0, N_CODE)


def pad(codes: Column | str, length: Column | int, padding: int = N_CODE) -> Column:
    """Codes followed by ``padding`` up to a length."""
    codes, length = col(codes), F.lit(length) if isinstance(length, int) else length
    return F.concat(codes, F.array_repeat(F.lit(padding), F.greatest(length - F.size(codes), F.lit(0)).cast("int")))


def encode_batch(sequences: DataFrame, column: str = "sequence", padding: int = N_CODE, letters_: Column | None = None, one_hot_codes: bool = False, batch: str | None = None) -> DataFrame:
    """The rows with ``codes``, padded at the end up to the longest of the table, and ``length`` before padding.

    With ``batch``, a column that names the batch of a row, they are padded up to the longest of their batch: one long
    sequence then widens its own batch only, and an empty table stays empty.

    ``letters_`` are the prepared letters, ``normalise(column)`` by default; a null sequence is empty; with
    ``one_hot_codes`` the codes are one-hot vectors. A table without rows is an error.
    """
    prepared = F.coalesce(normalise(column) if letters_ is None else letters_, F.lit(""))
    if batch is not None:
        longest = sequences.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.length(prepared)).alias("_most"))
        joined = sequences.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
        codes = pad(encode(prepared), F.col("_most"), padding)
        return joined.withColumns({"codes": one_hot(codes) if one_hot_codes else codes, "length": F.length(prepared)}).drop("_batch", "_most")
    most = sequences.agg(F.count("*").alias("n"), F.max(F.length(prepared)).alias("most")).first()
    if not most.n:
        raise ValueError("no sequences")
    codes = pad(encode(prepared), most.most, padding)
    return sequences.withColumns({"codes": one_hot(codes) if one_hot_codes else codes, "length": F.length(prepared)})


def one_hot(codes: Column | str, include_n: bool = True) -> Column:
    """An array of 5 or, without N, 4 floats for each code; codes of ambiguous letters count as code % 5."""
    classes = 5 if include_n else 4
    return F.transform(col(codes), lambda c: F.array(*[F.when(c % 5 == k, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float") for k in range(classes)]))


def decode(codes: Column | str, length: Column | int | None = None, iupac: bool = True) -> Column:
    """Text of the codes, cut to a length; unknown codes are N."""
    codes = col(codes)
    if length is not None:
        codes = F.slice(codes, F.lit(1), F.lit(length) if isinstance(length, int) else length.cast("int"))
    alphabet = F.lit(CANONICAL + (IUPAC if iupac else ""))
    return F.array_join(F.transform(codes, lambda c: F.when((c >= 0) & (c < F.length(alphabet)), F.substring(alphabet, c + 1, F.lit(1))).otherwise("N")), "")


def reverse_complement(seq: Column | str) -> Column:
    """Upper case; U gives A; what isn't A, C, G, T, U or N gives N."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(col(seq)), "[^ACGTNU]", "N")), "ACGTU", "TGCAA")


def aligner_letters(seq: Column | str) -> Column:
    """What the affine aligner sees: A, C, G, T, and N for all else, U included."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")


def simple_aligner_letters(seq: Column | str) -> Column:
    """What the linear-gap aligner sees: upper-case A, C, G, T, the gap sign, and N for all else."""
    return F.regexp_replace(col(seq), "[^ACGT-]", "N")


def motif_positions(seq: Column | str, motif: str) -> Column:
    """All 0-based places of a motif, overlapping ones too, ignoring case."""
    if not motif:
        raise ValueError("empty motif")
    return vector.motif_positions(seq, motif)


def cut_positions(seq: Column | str, enzyme: str) -> Column:
    """1-based position of the first base after each cut of a restriction enzyme on the upper strand."""
    site, offset = ENZYMES[enzyme]
    return F.transform(motif_positions(seq, site), lambda i: i + offset + 1)


def cut_sites(texts: DataFrame, key: str, enzymes: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(key, enzyme, position): as ``cut_positions`` for all enzymes, by default the common ones, in one pass."""
    sites = enzymes or ENZYMES
    found = vector.motif_hits(texts, key, {name: site for name, (site, _) in sites.items()})
    offset = F.create_map(*[x for name, (_, cut) in sites.items() for x in (F.lit(name), F.lit(cut))])
    return found.select(key, F.col("motif").alias("enzyme"), (F.col("position") + F.element_at(offset, F.col("motif")) + 1).cast("long").alias("position"))


def count_of(seq: Column, letters_: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, letters_, ""))).cast("long")


def gc_content(seq: Column | str) -> Column:
    """(C + G) / (A + C + G + T) with U as T; 0 without such letters; null for a null sequence."""
    s = normalise(seq)
    valid = count_of(s, "ACGT")
    return F.when(valid > 0, count_of(s, "CG") / valid).when(s.isNotNull(), F.lit(0.0))


def gc_percent(seq: Column | str) -> Column:
    return gc_content(seq) * 100.0


def header(record_id: Column | str, description: Column | str) -> Column:
    d = col(description)
    return F.when(F.coalesce(d, F.lit("")) != "", F.concat_ws(" ", col(record_id), d)).otherwise(col(record_id))


def tiles(seq: Column | str, window: int, overlap: int = 0) -> Column:
    """(start, tile) structs of a text: windows whose starts are ``window - overlap`` apart."""
    s, step = col(seq), max(1, window - overlap)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), piece(s, i + 1, window).alias("tile")))


#: Molecule types that end a header line.
MOLECULES = ("cds", "dna", "genomic", "mrna", "protein", "rna")


def parse_header(record_id: Column | str, description: Column | str) -> dict[str, Column]:
    """accession, species, gene, variant and type of a sequence's header line; null where there is none.

    The line is taken as words. species: a capitalised first word and the lower-case letters of the second. gene: the
    first run of letters, digits and underscores that is upper-case letters and digits, a letter first, a digit within.
    variant: a number after a word that ends in "variant". type: the last word, if it is a molecule's.
    """
    words = F.filter(F.split(F.trim(col(description)), r"\s+"), lambda w: w != "")
    word = lambda i: F.get(words, i)
    leading = lambda w, what: F.nullif(F.regexp_substr(w, F.lit(f"^{what}+")), F.lit(""))
    genus, epithet = word(F.lit(0)), leading(word(F.lit(1)), "[a-z]")
    runs = F.split(col(description), "[^A-Za-z0-9_]+")
    genes = F.filter(runs, lambda r: r.rlike("^[A-Z][A-Z0-9]*$") & r.rlike("[0-9]"))
    lower = F.transform(words, lambda w: F.lower(w))
    numbered = F.filter(F.transform(lower, lambda w, i: F.struct(w.alias("w"), F.get(lower, i - 1).alias("before"), leading(F.get(lower, i + 1), "[0-9]").alias("n"))), lambda t: t["w"].endswith("variant") & t["n"].isNotNull())
    first = F.get(numbered, F.lit(0))
    spaced = F.regexp_substr(col(description), F.lit(r"(?i)transcript\s+variant(?=\s+[0-9])"))  # with the blanks as they are
    label = F.when((first["w"] == "variant") & F.coalesce(first["before"].endswith("transcript"), F.lit(False)), F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 1000)))).otherwise("Variant")
    last = F.rtrim(F.get(words, F.size(words) - 1), F.lit(",.;"))
    return {
        "accession": col(record_id),
        "species": F.when(genus.rlike("^[A-Z][a-z]+$") & epithet.isNotNull(), F.concat_ws(" ", genus, epithet)),
        "gene": F.get(genes, F.lit(0)),
        "variant": F.when(first.isNotNull(), F.concat_ws(" ", label, first["n"])),
        "type": F.when(F.lower(last).isin(*MOLECULES), last),
    }


# -------------------------------------------------------------------------------------------- qualities


def phred(quality: Column | str, offset: int = 33) -> Column:
    """Scores of a quality text, an array of int."""
    return F.transform(letters(col(quality)), lambda c: F.ascii(c) - offset)


def mean_score(quality: Column | str, offset: int = 33) -> Column:
    """Mean of the scores, 0 for an empty text."""
    scores = phred(quality, offset)
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(scores) > 0, total / F.size(scores)).when(col(quality).isNotNull(), F.lit(0.0))


def n_ratio(seq: Column | str) -> Column:
    """Share of the letter N in any case; other ambiguous letters don't count."""
    s = col(seq)
    return F.when(F.length(s) > 0, count_of(F.upper(s), "N") / F.length(s)).otherwise(F.lit(0.0))


def trim_position(quality: Column | str, min_quality: float = 20, window: int = 5, offset: int = 33) -> Column:
    """Where the first window, from the left, with a mean below the threshold starts; else the length.

    A text shorter than the window isn't trimmed. The window's sum is carried along, so the cost is linear.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    long = lambda x: F.lit(x).cast("long")

    def cut(scores: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            total = a["sum"] + x - F.when(a["at"] >= window, F.get(scores, (a["at"] - window).cast("int"))).otherwise(0)
            low = (a["cut"] < 0) & (a["at"] + 1 >= window) & (total < min_quality * window)
            return F.struct((a["at"] + 1).alias("at"), total.alias("sum"), F.when(low, a["at"] + 1 - window).otherwise(a["cut"]).alias("cut"))

        return F.aggregate(scores, F.struct(long(0).alias("at"), long(0).alias("sum"), long(-1).alias("cut")), step, lambda a: F.when(a["cut"] >= 0, a["cut"]).otherwise(a["at"]))

    return F.transform(F.array(phred(quality, offset)), cut)[0]


# -------------------------------------------------------------------------------------------- k-mers


def kmer_code(kmer: Column | str) -> Column:
    """Base-4 number of a k-mer of A, C, G, T (0 to 3), exact up to 31 letters."""
    return F.conv(F.translate(col(kmer), "ACGT", "0123"), 4, 10).cast("long")


#: All words of four letters in order, one after the other: what the bytes of a code stand for.
WORDS = "".join("".join(w) for w in product("ACGT", repeat=4))


def kmer_decode(code: Column | str, k: int) -> Column:
    """The letters of a code: a lookup for each of its bytes, the highest first."""
    code, words, parts = col(code), F.lit(WORDS).cast("binary"), []
    for low in range(4 * ((k - 1) // 4), -1, -4):
        n = min(4, k - low)
        at = F.shiftright(code, 2 * low).bitwiseAND(F.lit(255)).cast("int") * 4 + (5 - n)
        parts.append(F.substring(words, at, F.lit(n)))
    return F.concat(*parts).cast("string")


def canonical(kmer: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement; as A < C < G < T, also the lesser code."""
    k = col(kmer)
    return F.least(k, F.translate(F.reverse(k), "ACGT", "TGCA"))


def reverse_complement_code(code: Column | str, k: int) -> Column:
    """The code of the reverse complement: digits of two bits, complemented, swapped in ever larger groups, moved down."""
    x = F.bitwise_not(col(code))
    for width in (2, 4, 8, 16, 32):
        lower = F.lit(sum(((1 << width) - 1) << at for at in range(0, 64, 2 * width)))
        x = F.shiftrightunsigned(x, width).bitwiseAND(lower).bitwiseOR(F.shiftleft(x.bitwiseAND(lower), width))
    return F.shiftrightunsigned(x, 64 - 2 * k)
