"""Language identification by language-bitmask n-gram filters.

Training counts byte n-grams of the words for each language and keeps those that are frequent in it and not several
times rarer than in another language. A Bloom filter of all kept n-grams is stored bit-sliced: each slot has one bit
for each language, so the conjunction of an n-gram's slots gives the set of all languages that hold it at once. A text
gets, for each language, the share of its n-grams whose masks have the language's bit, corrected by that bit's rate of
false positives; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, filter_rows, quoted, table

N, HASHES = 4, 2
#: At most about so many training documents for each language, by a hash of doc_id: the bound of the fit.
FIT_DOCUMENTS = 5_000
#: An n-gram is kept for a language if it has at least this share of the language's n-grams, so each language keeps at
#: most 1 / MIN_SHARE of them, and at least RATIO of its largest share in any language.
MIN_SHARE, RATIO = 2e-6, 0.3
#: Filter slots for each kept n-gram, rounded up to a power of two.
SLOTS_EACH = 16
UNKNOWN = "und"
#: A text with at least ENOUGH n-grams is in no learned language if none holds the share ACCEPT of them.
ENOUGH, ACCEPT = 20, 0.2
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    #: One row of 64 languages' masks for each 64 languages.
    slots: np.ndarray
    false_rate: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of all texts, and where each text's codes end.

    Texts are in lower case with each run of bytes that are no letters (ASCII letters and all bytes from 128 on) as one
    blank; an n-gram is N bytes with a blank only at its ends.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b" " + b"  ".join(lowered.cast(pa.binary()).to_pylist()) + b" " * (N + 1), np.uint8)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    is_letter = letter[data]
    before = np.cumsum(sizes + 2) - sizes - 2  # the blank before each text
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[before] = True
    ends = np.cumsum(keep)[before + sizes + 1]
    keep[-N:] = True
    data, is_letter = np.where(is_letter, data, 32)[keep].astype(np.uint32), is_letter[keep]
    count = len(data) - N + 1
    code, inside = np.zeros(count, np.uint32), np.ones(count, bool)
    for k in range(N):
        code = (code << np.uint32(8)) | data[k : k + count]
        if 0 < k < N - 1:  # each text ends with a blank, so no n-gram reaches into the next
            inside &= is_letter[k : k + count]
    total = np.concatenate([[0], np.cumsum(inside)])
    return code[inside], total[np.minimum(ends, count)]


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            lang = batch.column("lang")
            for each in lang.unique():
                codes, _ = grams(batch.column("text").filter(pc.equal(lang, each)))
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([each.as_py()] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                )

    return bounded(training).select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots_of(codes: np.ndarray, size: int) -> list[np.ndarray]:
    wide = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [((wide >> np.uint64(32 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, per_language: int = FIT_DOCUMENTS) -> Model:
    """Learn from the text and lang of documents that are not held out and have both."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, HASHES), np.uint64), np.zeros(0))
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, per_language * span // n))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share[F.col("lang")])
    counts = count_grams(sample).cache()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = shares.where(F.col("share") >= MIN_SHARE).join(best, "gram").where(F.col("share") >= RATIO * F.col("best"))
    rows = kept.select("lang", "gram").toPandas()  # at most 1 / MIN_SHARE rows for each language
    counts.unpersist()
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    size = 1 << max(8, int(np.ceil(np.log2(max(1, rows.gram.nunique()) * SLOTS_EACH))))
    slots = np.zeros(((len(languages) + 63) // 64, size), np.uint64)
    for k, lang in enumerate(languages):
        for at in slots_of(rows.gram[rows.lang == lang].to_numpy(np.uint32), size):
            slots[k // 64, at] |= np.uint64(1 << (k % 64))
    fill = [float(np.mean(slots[k // 64] >> np.uint64(k % 64) & np.uint64(1))) for k in range(len(languages))]
    return Model(languages, slots, np.array(fill) ** HASHES)


def shares(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language, the corrected share of n-grams that the language's filter holds; n-grams of each text."""
    codes, ends = grams(texts)
    starts = np.concatenate([[0], ends[:-1]])
    count = np.maximum(1, ends - starts)
    out = np.zeros((len(texts), len(model.languages)))
    for row in range(model.slots.shape[0]):
        first, *rest = slots_of(codes, model.slots.shape[1])
        mask = model.slots[row, first]
        for at in rest:
            mask &= model.slots[row, at]
        for k in range(row * 64, min(len(model.languages), row * 64 + 64)):
            sums = np.concatenate([[0], np.cumsum(mask >> np.uint64(k % 64) & np.uint64(1), dtype=np.int64)])
            hits = sums[ends] - sums[starts]
            out[:, k] = np.clip((hits / count - model.false_rate[k]) / (1 - model.false_rate[k]), 0, 1)
    return out, ends - starts


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the columns ``keep`` (doc_id) of the documents; only the text decides.

    A null text or one without a letter is ``und`` with score 0; so is every text if there was nothing to learn from.
    Ties go to the language with most training documents; letters without a known n-gram give that with score 0.
    Repeated rows each have their prediction; ``keep`` may have any names but ``_text``, and an empty table gives an empty table.
    """
    keep = keep or ["doc_id"]
    schema = ", ".join([*(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            texts = batch.column("_text")
            table = shares(model, texts)[0] if model.languages else np.zeros((len(texts), 1))
            best = table.argmax(axis=1)
            known = [bool(model.languages and t and LETTER.search(t)) for t in texts.to_pylist()]
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score = np.where(known, table.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return bounded(docs).select(*map(quoted, keep), F.col("text").alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns as they are and of any names, in which a learned language is recognised.

    Repeated rows are each judged by their text; an empty table gives an empty table. Those without a letter go, and those with ENOUGH n-grams of which no language holds the share ACCEPT. If there was
    nothing to learn from, only the letters count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text")
            keep = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()])
            if model.languages:
                table, n = shares(model, texts)
                keep &= (n < ENOUGH) | (table.max(axis=1) >= ACCEPT)
            yield batch.filter(pa.array(keep))

    return filter_rows(docs, run)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
