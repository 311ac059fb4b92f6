"""The registered queries that SQL can't express, on whole tables, against plain loops."""

import bisect
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from strandlake.llm import language
from strandlake.llm.registry import queries
from test_language import brute as grams_of
from test_simhash import brute_components, brute_fp
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encodings(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tok.encode(r.text or "", add_special_tokens=False) for i, r in docs.items()}


def test_op3(spark, docs):
    fps = {i: brute_fp(r.text) for i, r in docs.items()}
    roots = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op3_simhash_dedup"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in docs}


def test_op4(spark, docs):
    rows = queries()["op4_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shard_of, slots, weight, groups = {}, {}, Counter(), Counter()
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(docs[r.doc_id].text, r.shard) == r.shard and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
        weight[r.shard] += r.size
        groups[docs[r.doc_id].text] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(weight.values()) / 24
    # a shard above the mean by more than a hundredth holds one group that is larger than the mean
    assert all(w <= 1.01 * mean or max(groups[t] for t, s in shard_of.items() if s == k) > mean for k, w in weight.items())


def test_op7(spark, docs):
    """Counts, kept n-grams, filters, corrected shares and predictions, all anew."""
    counts, labels = {}, Counter()
    for i, r in docs.items():
        if zlib.crc32(str(i).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            labels[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(grams_of(r.text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = Counter()
    for s in share.values():
        for g, x in s.items():
            best[g] = max(best[g], x)
    kept = {lang: {g for g, x in s.items() if x >= language.MIN_SHARE and x >= language.RATIO * best[g]} for lang, s in share.items()}
    size = 256
    while size < len(set().union(*kept.values())) * language.SLOTS_EACH:
        size *= 2
    slots = lambda g: [(g * 0x9E3779B97F4A7C15 % (1 << 64) >> 32 * k) % size for k in range(language.HASHES)]
    filters = {lang: {at for g in own for at in slots(g)} for lang, own in kept.items()}
    rate = {lang: (len(f) / size) ** language.HASHES for lang, f in filters.items()}
    order = sorted(labels, key=lambda x: (-labels[x], x))
    places = {}
    for r in queries()["op7_language_id"](spark, SF).collect():
        text, found = docs[r.doc_id].text or "", {}
        codes = grams_of(text)
        for g in codes:
            places.setdefault(g, slots(g))
        for lang in order:
            hits = sum(all(at in filters[lang] for at in places[g]) for g in codes)
            found[lang] = min(1.0, max(0.0, (hits / max(1, len(codes)) - rate[lang]) / (1 - rate[lang])))
        first = max(order, key=lambda x: (found[x], -order.index(x)))
        want = (first, found[first]) if any(c.isalpha() for c in text) else ("und", 0.0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9


def best_fit(lengths, window=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        left = (room.pop(at) if at < len(room) else window) - n
        bisect.insort(room, left)
    return len(room)


def test_op8(spark, docs, encodings):
    rows, held, of = queries()["op8_best_fit_packing"](spark, SF).collect(), {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(of) == set(docs)
    for i, pieces in of.items():
        ids = np.array([*encodings[i].ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(r.length == 1024 for r in pieces[1:])
    for places in held.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(held) <= best_fit([r.length for r in rows])


def test_op9(spark, docs):
    rows = {r.doc_id: r for r in queries()["op9_lm_score"](spark, SF).collect()}
    assert set(rows) == set(docs)
    of = {}
    for i, r in rows.items():
        assert of.setdefault(docs[i].text, (r.n_words, r.log_prob)) == pytest.approx((r.n_words, r.log_prob))
        assert r.log_prob <= 0 and (r.n_words == 0) == (r.perplexity is None)


def test_op10(spark, docs, encodings):
    got = {}
    for r in queries()["op10_token_counts"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens, r.n_crossing))
    assert set(got) == set(docs)
    for i, doc in docs.items():
        lines, at = [], 0
        for part in (doc.text or "").split("\n"):
            lines.append((at, at + len(part) + 1))
            at += len(part) + 1
        lines[-1] = (lines[-1][0], len(doc.text or ""))
        lines = [x for k, x in enumerate(lines) if x[0] < x[1] or k == 0]
        starts, n, across = [a for a, _ in lines], Counter(), Counter()
        for a, b in encodings[i].offsets:
            inside = Counter(bisect.bisect_right(starts, c) - 1 for c in range(a, b))
            owner = max(inside, key=lambda k: (inside[k], -k))
            n[owner] += 1
            across[owner] += len(inside) > 1
        assert sorted(got[i]) == [(a, b, n[k], across[k]) for k, (a, b) in enumerate(lines)]
