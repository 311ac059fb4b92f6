import random
from collections import Counter

import public_tokenizers
import pytest
from strandlake.llm.token_counts import token_counts
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, section string, start int, _sections string"


def place(i, sections):
    return next((k for k, (_, a, b) in enumerate(sections) if a <= i < b), None)


def brute(text, sections, rule, tok):
    """By the tokenizer's own character offsets, one token and character at a time."""
    n, across = Counter(), Counter()
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        places = [place(i, sections) for i in range(a, max(b, a + 1))]
        owner = places[0] if rule == "start" else max(places, key=lambda p: (places.count(p), -places.index(p)))
        n[owner] += 1
        across[owner] += len(set(places)) > 1
    return {**{sections[k][0]: (n[k], across[k]) for k in range(len(sections))}, **({None: (n[None], across[None])} if n[None] or not sections else {})}


def texts():
    rng = random.Random(21)
    parts = ["the", " quick", "\n", "\n\n\n", "  ", "Ümläut", "日本語", "🙂", "x" * 30, "don't", " 1234", "\r\n", "a\n b"]
    return [None, "", "\n", "a", "\n\nb"] + ["".join(rng.choices(parts, k=rng.choice([3, 30, 200]))) for _ in range(80)] + ["word " * 30_000 + "\nend"]


@pytest.mark.parametrize("rule", ["majority", "start"])
def test_lines(spark, rule):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in enumerate(texts())], SCHEMA)
    got = {}
    for r in token_counts(df, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing, r.start, r.end)
    for i, t in enumerate(texts()):
        t, at, sections = t or "", 0, []
        for k, line in enumerate(t.splitlines(keepends=True) if "\r" not in t else [x + "\n" for x in t.split("\n")]):
            line = line[: len(t) - at]
            if line:
                sections.append((str(k), at, at + len(line)))
            at += len(line)
        sections = sections or [("0", 0, 0)]
        if len(t) < 10_000:
            assert {k: v[:2] for k, v in got[i].items()} == brute(t, sections, rule, tok)
        assert [(k, *v[2:]) for k, v in sorted(got[i].items(), key=lambda x: int(x[0]))] == sections
        assert sum(v[0] for v in got[i].values()) == len(tok.encode(t, add_special_tokens=False).ids)


def test_given_sections(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Title of it\nSome words, ünd more 🙂🙂 of them"
    cuts = [("head", 0, 7), ("gap", 9, 9), ("body", 14, 30), ("far", 100, 120)]
    df = spark.createDataFrame([(1, text, "c", 1, "d"), (2, text, "c", 1, "d"), (1, text, "c", 1, "d"), (3, None, "c", 1, "d")], SCHEMA)
    sections = spark.createDataFrame([(1, *c) for c in cuts] + [(1, "bad", 5, 2), (1, "null", None, 3), (3, "head", 0, 4)], "doc_id long, section string, start long, end long")
    rows = token_counts(df, sections).collect()
    want = brute(text, cuts, "majority", tok)
    assert [(r.section, r.n_tokens, r.n_crossing) for r in rows if r.doc_id == 2] == [(None, len(tok.encode(text).ids), 0)]
    assert Counter((r.section, r.n_tokens, r.n_crossing) for r in rows if r.doc_id == 1) == Counter({(k, *v): 2 for k, v in want.items()})
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 3] == [("head", 0)]
    assert token_counts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_counts(df, rule="other")
