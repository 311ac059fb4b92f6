import re
from collections import Counter
from math import log, sqrt

from oracle import agree
from strandlake.llm.licenses import APACHE, BSD_FIRST, BSD_LAST, BSD_THIRD, GPL, GPL_HEADER, GPL_WARRANTY, FAMILY, ISC, MENTION, MIT, NOTICE_TERMS, PROPRIETARY, TELLING, TEMPLATES, VERBATIM, _oracle, op5_license_scan, scan_licences

SCHEMA = "key long, path string, text string, licence string, sentence string, term int, _dir string"


def terms(text):
    return Counter(re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)))


DOCUMENTS = Counter(w for _, t in TEMPLATES for w in terms(t))
IDF = {w: log((1 + len(TEMPLATES)) / (1 + n)) + 1 for w, n in DOCUMENTS.items()}


def vector(text):
    found = {w: n * IDF.get(w, log(1 + len(TEMPLATES)) + 1) for w, n in terms(text).items()}
    norm = sqrt(sum(x * x for x in found.values()))
    return {w: x / norm for w, x in found.items()}


VECTORS = [(licence, vector(t)) for licence, t in TEMPLATES]


def cosine(unit):
    """(yields, -similarity, licence) of the best template, by loops."""
    own, told = vector(unit), set(terms(unit)) & set(TELLING)

    def fits(licence, text):
        words = set(terms(text))
        if len(words) <= NOTICE_TERMS:
            return words & set(TELLING) == told
        return words & set(FAMILY) == told & set(FAMILY) and (licence.startswith("BSD") or {c for c in licence if c in "123456789"} <= told)

    found = [(licence == PROPRIETARY, -round(sum(x * own.get(w, 0) for w, x in v.items()), 6), licence) for (licence, v), (_, t) in zip(VECTORS, TEMPLATES, strict=True) if fits(licence, t)]
    return min(found, default=(True, 0, None))


def files():
    return [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.py", "nothing here"),
        ("a/b/c/y.py", None),
        ("a/b/COPYING.txt", "intro line\nThis work is licensed under the GNU General Public License, version 3."),
        ("a/b/z.py", "Code! Licensed under the Apache License, Version 2.0. more"),
        ("d/w.py", ""),
        ("top.py", "what license?"),
        ("e/LICENSE", "a license of our own that nobody else has ever seen before"),
        ("e/f.py", "x"),
        ("g/LICENSE.a", "Released under the MIT License."),
        ("g/LICENSE.b", "RELEASED UNDER THE ISC LICENSE!"),
        ("g/" + "h/" * 30 + "deep.py", "licence " * 20_000),
        ("g/i", "word " * 5_000 + ". Released under the MIT License. " + "tail " * 5_000),
        (None, "Released under the MIT License."),
        ("a/x.py", "nothing here"),
        ("a/x2.py", "Released under the BSD 3-Clause License."),
        ("a/x2.py", "Released under the MIT Licence"),
    ]


def test_scan(spark):
    df = spark.createDataFrame([(k, p, t, "l", "s", 1, "d") for k, (p, t) in enumerate(files())], SCHEMA)
    got = {r.key: r for r in scan_licences(df, ["key"]).collect()}
    short = {k: (r.licence, r.origin, r.licence_dir) for k, r in got.items()}
    assert short == {
        0: ("MIT", "file", None), 1: ("MIT", "inherited", "a"), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "file", None), 4: ("Apache-2.0", "header", None),
        5: (None, "none", None), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None), 9: ("MIT", "file", None), 10: ("ISC", "file", None),
        11: ("ISC", "inherited", "g"), 12: ("MIT", "header", None), 13: (None, "none", None), 14: ("MIT", "inherited", "a"), 15: ("BSD-3-Clause", "header", None), 16: ("BSD-3-Clause", "header", None),
    }
    assert got[0].similarity == 1.0 and scan_licences(df.limit(0), ["key"]).collect() == []
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License.", "l", "s", 1, "d"), (2, "q/r/s", "-", "l", "s", 1, "d"), (3, "t", "-", "l", "s", 1, "d")], SCHEMA)
    assert [(r.origin, r.licence_dir) for r in scan_licences(root, ["key"]).orderBy("key").collect()] == [("file", None), ("inherited", ""), ("inherited", "")]


def test_similarity_equals_loops(spark):
    texts = [t for _, t in TEMPLATES] + ["Licensed under Apache License 2", "the License the license", "MIT License", "Some other license, version 3", "This file is released under the license BSD clause 3", "Copyright 2020 Someone. All rights reserved.\n\nReleased under the MIT License."]
    df = spark.createDataFrame([(k, f"{k}/LICENSE", t, "l", "s", 1, "d") for k, t in enumerate(texts)], SCHEMA)
    got = {r.key: r for r in scan_licences(df, ["key"], least=0.0001).collect()}
    for k, t in enumerate(texts):
        parts = [t, *t.split("\n"), *t.split("\n\n"), *(s for p in t.split("\n\n") for s in re.split(r"(?<=[.!?])[ \t\r\n]+", p))]
        want = min(c for s in parts if re.search(MENTION, s) and (c := cosine(s))[1] <= -0.0001)
        assert (got[k].licence, got[k].similarity) == (want[2], -want[1]), t
    assert all(re.search(MENTION, t) for _, t in TEMPLATES)


def wrapped(text, width, mark=""):
    return "\n".join(f"{mark}{line}".rstrip() for p in text.split("\n\n") for line in [*re.findall(rf".{{1,{width}}}(?:\s|$)", p), ""])


def test_whole_files_headers_and_tags(spark):
    cases = [
        ("1/COPYING", "The MIT License (MIT)\n\nCopyright (c) 2019 Some One\n\n" + wrapped(MIT, 70), "MIT"),
        ("2/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + "words of the terms " * 500, "Apache-2.0"),
        ("3/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n " + wrapped(VERBATIM, 60) + "\n\n                            Preamble\n\n" + "other words " * 900, "GPL-3.0"),
        ("4/a.c", "/* SPDX-License-Identifier: MIT */\nint main() { return 0; }", "MIT"),
        ("5/a.py", wrapped(GPL_HEADER.format(GPL, 2) + "\n\n" + GPL_WARRANTY.format(GPL), 60, "# ") + "\n\nimport os\n", "GPL-2.0"),
        ("6/a.js", "/*\n" + wrapped(APACHE, 70, " * ") + "\n */\n\ncode();\n", "Apache-2.0"),
        ("7/LICENSE", "Copyright (c) 2020, A. All rights reserved.\n\n" + wrapped(f"{BSD_FIRST}\n\n{BSD_THIRD}\n\n{BSD_LAST}", 76), "BSD-3-Clause"),
        ("8/LICENSE", "Copyright (c) 2020, A. All rights reserved.\n\n" + wrapped(f"{BSD_FIRST}\n\n{BSD_LAST}", 76), "BSD-2-Clause"),
        ("9/LICENSE.md", wrapped(ISC, 50), "ISC"),
        ("10/p.txt", "Some prose. Licensed under CC BY-NC 4.0. More prose.", "CC-BY-NC-4.0"),
        ("11/p.txt", "Some prose of ours. All rights reserved.", PROPRIETARY),
        ("12/p.txt", "We reserved a table and held the copyright talk, hereby.", None),
        ("13/a.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0"),
    ]
    df = spark.createDataFrame([(k, p, t, "l", "s", 1, "d") for k, (p, t, _) in enumerate(cases)], SCHEMA)
    got = {r.key: r.licence for r in scan_licences(df, ["key"]).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_versions_clauses_and_denials_must_agree(spark):
    cases = [
        ("Released under the BSD 4-Clause License.", "BSD-4-Clause"), ("Released under the BSD 5-Clause License.", None), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-SA 3.0.", None),
        ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"), ("SPDX-License-Identifier: GPL-1.0", None), ("Not released under the MIT License.", None), ("This work is licensed under the GNU General Public License, version 1.", None),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("# SPDX-License-Identifier:  GPL-2.0 WITH\tClasspath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"),
        ("SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0"), ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("Released under the zlib License.", "Zlib"),
        (GPL_HEADER.format("GNU Affero General Public License", 3), "AGPL-3.0"), (GPL_HEADER.format(GPL, 2), "GPL-2.0"), (GPL_HEADER.format(GPL, 1), None), ("Licensed under Apache License 2", "Apache-2.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ]
    df = spark.createDataFrame([(k, f"{k}/x", t, "l", "s", 1, "d") for k, (t, _) in enumerate(cases)], SCHEMA)
    got = {r.key: r.licence for r in scan_licences(df, ["key"]).collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(cases)] == cases


def test_query(spark):
    agree(op5_license_scan(spark, "/root/testdata/sf0.01"), _oracle(), "/root/testdata/sf0.01")
    assert {"header", "none"} <= {r.origin for r in op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
