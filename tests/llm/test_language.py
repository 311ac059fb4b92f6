import random
import re
import zlib

import numpy as np
import pyarrow as pa
from strandlake.llm import language
from strandlake.llm.language import accepted, fit, grams, held_out, op7_language_id, predict, shares, slots_of

SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred long, _text int"


def brute(text):
    s = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ")
    return [int.from_bytes(s[i : i + 4], "big") for i in range(len(s) - 3) if b" " not in s[i + 1 : i + 3]]


def test_grams():
    texts = ["Hello, the world é", "", "  a b cd", " x1y ", "ÀÉ...Z!", None, "abc", "ok ok", "", "tail"]
    for part in (texts, texts[:1], texts[1:2], texts[::-1], texts[5:6]):
        codes, ends = grams(pa.array(part, pa.string()))
        at = 0
        for text, end in zip(part, ends, strict=True):
            assert codes[at:end].tolist() == brute(text or "")
            at = end
        assert at == len(codes)


def corpus(n=400):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "th", "er", "wh"], "de": ["sch", "ung", "ein", "ü", "ge"], "fr": ["eau", "ou", "é", "tion", "le"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(5, 60))), lang))
    return rows


def test_learns_and_ignores_labels(spark):
    rows = corpus()
    extra = [(9000, None, "en"), (9001, "", "en"), (9002, "12 !! 3", "de"), (9003, "the", None), (9003, "the", None), (9004, "漢字", None), (None, "wheringer therther", "en"), (9005, "therwher " * 50_000, None)]
    df = spark.createDataFrame([(*r, "s", 0.5, 7, 1) for r in rows + extra], SCHEMA)
    model = fit(df)
    assert sorted(model.languages) == ["de", "en", "fr"]
    got = {r.doc_id: r for r in predict(df, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.98
    assert [got[i].lang_pred for i in (9000, 9001, 9002, 9005)] == ["und", "und", "und", "en"]
    assert got[9004].score < 0.01 and got[9000].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert predict(df, model).count() == len(rows) + len(extra)
    noise = spark.createDataFrame([(9500, "zqxj kvvq xxzq wwjk " * 9, None, "s", 0.5, 7, 1)], SCHEMA)
    kept = accepted(df.unionByName(noise), model)
    assert kept.columns == df.columns
    gone = {9000, 9001, 9002, 9500}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows + extra if r[0] not in gone)
    # labels and sources of what is predicted don't matter, nor do held-out labels
    other = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'q' AS source")
    assert sorted(map(str, predict(other, fit(other)).collect())) == sorted(map(str, predict(df, model).collect()))


def test_masks_hold_every_kept_gram(spark):
    df = spark.createDataFrame([(*r, "s", 0.5, 7, 1) for r in corpus(60)], SCHEMA)
    model = fit(df)
    counts = {}
    for i, text, lang in corpus(60):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for g in brute(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    share = {k: {g: n / sum(v.values()) for g, n in v.items()} for k, v in counts.items()}
    for k, lang in enumerate(model.languages):
        for g, x in share[lang].items():
            if x >= language.RATIO * max(v.get(g, 0) for v in share.values()):
                assert all(model.slots[0, a[0]] >> np.uint64(k) & np.uint64(1) for a in slots_of(np.array([g]), model.slots.shape[1]))
    assert shares(model, pa.array(["zzzz qqqq"]))[0].max() < 0.2


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 0.5, 7, 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in predict(df, fit(df)).collect()] == [("und", 0.0)]
    assert predict(df.limit(0), fit(df.limit(0))).collect() == []


def test_query(spark):
    df = op7_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95
    assert df.where(held_out(df.doc_id) != df.held_out).count() == 0
