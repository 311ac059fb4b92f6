import random
import zlib

import numpy as np
import public_tokenizers
from strandlake.llm.packing import configurations, cut, pack_documents, pack_lengths
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, length string, _rank long, sequence_id string"


def check_plan(hist, window):
    runs, opened = pack_lengths(hist, window)
    held, seen = {}, {}
    for length, first, end, each, base, offset in runs:
        for r in range(first, end):
            held.setdefault(base + (r - first) // each, []).append((offset + (r - first) % each * length, length))
            seen.setdefault(length, []).append(r)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in hist.items() if n}
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return len(held)


def test_plans():
    rng = random.Random(5)
    for _ in range(40):
        hist = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))}
        n = check_plan(hist, 64)
        assert n <= -(-sum(k * v for k, v in hist.items()) // 64) * 1.35 + 5
    assert check_plan({}, 64) == 0
    assert check_plan({64: 1000}, 64) == 1000
    assert check_plan({40: 300, 24: 300}, 64) <= 302
    assert check_plan({33: 500, 31: 500}, 64) <= 500 + 1000 / 24


def test_configurations_cover_the_demand():
    found = configurations([40, 24], [100, 100], 64)
    assert abs(sum(x for _, x in found) - 100) < 1e-6
    assert all(abs(sum(c[i] * x for c, x in found) - 100) < 1e-6 for i in range(2))


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_documents_match_the_tokenizer(spark):
    rng = random.Random(6)
    words = ["the", "Ümläut", "ciónes", "<|endoftext|>", "x" * 50, "日本語", "\n\n", "  ", "don't", "1234", "🙂", " "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 400, 3000]))) for _ in range(120)] + ["", None, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)
    got = [r.asDict() for r in pack_documents(df).collect()]
    tok, by_doc, by_seq = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert r["piece"] == k and r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
            assert k == 0 or r["length"] == 1024
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for r in sorted(places, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= -(-sum(r["length"] for r in got) // 1024) * 1.1 + 1
    assert pack_documents(df.limit(0)).collect() == []
