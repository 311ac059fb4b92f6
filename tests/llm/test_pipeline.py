import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from strandlake.llm.secrets import ASSIGN
from test_decontamination import brute as leaks
from test_simhash import jaccard

SF = "/root/testdata/sf0.01"
SECRET = (re.compile(ASSIGN.replace("(?i)", ""), re.I | re.A), re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}"))


def test_stages_equal_brute_force(spark):
    """Every decision on the small corpus, by plain loops over each stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "x", 0), (90002, "12 34 !!", "en", "x", 8), (90003, "", None, None, 0)], docs.schema)
    now = docs.unionByName(extra)
    rows = {r.doc_id: r for r in now.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(rows) - set(got) == {90001, 90002, 90003}
        if name == "simhash_dedup":
            first = {}
            for i in sorted(rows):
                first.setdefault(rows[i].text, i)
            assert set(got) <= set(first.values())  # no copy stays
            gone = set(first.values()) - set(got)
            assert all(any(jaccard(rows[i].text, rows[j].text) >= 0.7 for j in rows if j != i) for i in gone) and len(got) > 850
        if name == "decontamination":
            planted = {i for i, r in rows.items() if any(b in r.text for b in items)}
            assert planted and planted <= set(rows) - set(got)
            assert all(any(leaks(rows[i].text, b) >= 0.8 for b in items) for i in set(rows) - set(got))
        if name == "secret_scan":
            assert set(got) == set(rows)
            changed = {i for i in rows if rows[i].text != got[i].text}
            assert changed == {i for i, r in rows.items() if any(len(m.group(2) if k == 0 else m.group()) >= (6 if k == 0 else 20) for k, rx in enumerate(SECRET) for m in rx.finditer(r.text))}
            assert changed and all("[SECRET]" in got[i].text and got[i].n_chars == len(got[i].text) for i in changed)
        else:
            assert all(rows[i] == r for i, r in got.items())
        rows, now = got, spark.createDataFrame(list(got.values()), docs.schema)
    pieces, tok = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
    assert set(of) == set(rows)
    for i, r in rows.items():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in of[i]] == [p.ids_crc32 for p in of[i]] and sum(p.length for p in of[i]) == len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
