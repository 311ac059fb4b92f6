import hashlib
import random
import re

from oracle import agree
from strandlake.llm.secrets import ASSIGN, LEDGER, RULES, _oracle, digest, op6_secret_scan, redact, scan_versions

SCHEMA = "doc_id long, text string, spans string, blob_id string, rank int, start long"
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def brute(text):
    out = []
    for rank, (kind, rx, group, least) in enumerate(BASE):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(rx.replace("(?i)", ""), text, re.I | re.A if rank == 0 else 0) if len(m.group(group)) >= least]
    return out, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def texts():
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "AKIA", "Z9" * 9, "deadbeef" * 3, "é", "🙂", "\n", "x" * 6, "token=token=abcdef", 'secret="token":abcdef', "ab12" * 10]
    out = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(400)]
    return [*out, None, "", "AKIA" + "A" * 16, "token = " + "f" * 40, "🙂" * 1000 + "hot secret: abcdefgh", ("word é " * 20_000) + "password=hunter22"] + ["hot secret: abcdefgh"] * 50


def test_spans(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, texts()[7]), (7, texts()[8]), (None, "token=abcdefg")]
    df = spark.createDataFrame([(*r, "c", "b", 1, 2) for r in rows], SCHEMA)
    added, found = scan_versions(df, ["doc_id"])
    assert added.count() == len({t or "" for _, t in rows}) and added.columns == ["blob_id", "rule_version", "spans"]
    got = digest(found, ["doc_id"]).collect()
    expect = []
    for i, t in rows:
        spans, text = brute(t or "")
        expect.append((i, *[sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect))
    assert scan_versions(df.limit(0), ["doc_id"])[1].collect() == []


def test_ledger_is_incremental(spark):
    one = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("a", 2, "clean")], "path string, version int, text string")
    added, found = scan_versions(one, ["path", "version"])
    added = spark.createDataFrame(added.collect(), LEDGER)
    assert added.count() == 2 and [len(r.spans) for r in found.orderBy("path", "version").collect()] == [1, 0, 1]
    more = one.unionByName(spark.createDataFrame([("c", 1, "token=abcdef"), ("c", 2, "secret=1234567")], one.schema))
    again, found = scan_versions(more, ["path", "version"], added)
    assert again.count() == 1 and sorted(len(r.spans) for r in found.collect()) == [0, 1, 1, 1, 1]
    # a ledger entry is believed, so what it says of a blob is what its paths get
    told = added.selectExpr("blob_id", "rule_version", "CAST(NULL AS array<struct<start:bigint,rank:int,end:bigint>>) AS spans")
    assert sum(len(r.spans) for r in scan_versions(one, ["path", "version"], told)[1].collect()) == 0
    assert scan_versions(more, ["path", "version"], added, rule_version="2")[0].count() == 3


def test_redaction(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "token=abcdefg"), (None, "token=abcdefg"), (5000, "ok")]
    df = spark.createDataFrame([(*r, "c", "b", 1, 2) for r in rows], SCHEMA)
    out = redact(df)
    assert out.columns == df.columns

    def expect(t):
        cuts = []
        for a, _, _, b in sorted(brute(t)[0]):
            if cuts and a <= cuts[-1][1]:
                cuts[-1][1] = max(b, cuts[-1][1])
            else:
                cuts.append([a, b])
        for a, b in reversed(cuts):
            t = t[:a] + "[SECRET]" + t[b:]
        return t

    assert sorted((repr(r.doc_id), repr(r.text)) for r in out.collect()) == sorted((repr(i), repr(t if t is None else expect(t))) for i, t in rows)


def test_query(spark):
    agree(op6_secret_scan(spark, "/root/testdata/sf0.01"), _oracle(), "/root/testdata/sf0.01")
    assert len(RULES) == 3


def test_clashing_columns_repeated_ledger_rows_and_empty_tables(spark):
    names = ["doc_id", "text", "row", "k", "blob_id", "cuts", "_key", "spans"]
    rows = [(1, "password=abcdef12 end", *"abcdef"), (1, "password=abcdef12 end", *"abcdef"), (None, "token: zzzzzz9", *"abcdef"), (2, None, *"abcdef"), (3, "", *"abcdef")]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = redact(df)
    assert out.columns == names
    assert sorted(str(r.text) for r in out.collect()) == sorted(["[SECRET] end", "[SECRET] end", "[SECRET]", "None", ""])
    added, found = scan_versions(df, ["doc_id"])
    ledger = added.unionByName(added)
    more, again = scan_versions(df, ["doc_id"], ledger)
    assert more.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    assert redact(df.limit(0)).collect() == [] and scan_versions(df.limit(0), ["doc_id"])[1].collect() == []
