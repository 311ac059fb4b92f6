"""Licence scans, in DataFrame operations only.

What a text may say of its licence are units: its paragraphs (runs of lines without an empty one, so a whole comment
header), its sentences, its lines, and, of a licence file, the whole text. Units with a word that notices have are compared
with templates (licence texts, standard headers, short notices and SPDX tags) by the cosine of sparse TF-IDF vectors: terms
are runs of ASCII letters and digits in lower case, and the inverse document frequency is that over the templates, so that a
unit has the same score in every corpus. Each distinct unit is scored once. A file's own licence is that of its best unit;
licence files give their directory its licence, and files without one of their own inherit from the nearest ancestor
directory, found by joins of paths.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

# Texts, standard headers and notices of public licences, with their SPDX identifiers.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_FIRST = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_LAST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
GPL_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program."""
VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
LGPL_HEADER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
BSD_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
PROPRIETARY = "LicenseRef-Proprietary"
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{BSD_FIRST}\n\n{BSD_LAST}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{BSD_FIRST}\n\n{BSD_THIRD}\n\n{BSD_LAST}"),
    ("BSD-3-Clause", BSD_THIRD),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", f"{GPL_HEADER.format(GPL, 2)}"),
    ("GPL-2.0", f"{GPL_HEADER.format(GPL, 2)}\n\n{GPL_WARRANTY.format(GPL)}"),
    ("GPL-2.0", f"{GPL} Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {VERBATIM}"),
    ("GPL-2.0", f"{GPL} Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", f"{GPL_HEADER.format(GPL, 3)}"),
    ("GPL-3.0", f"{GPL_HEADER.format(GPL, 3)}\n\n{GPL_WARRANTY.format(GPL)}"),
    ("GPL-3.0", f"{GPL} Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {VERBATIM}"),
    ("GPL-3.0", f"{GPL} Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("ISC", ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", f"{GPL_HEADER.format(LGPL, 3)}"),
    ("LGPL-3.0", f"{LGPL} Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT),
    ("MIT", MIT.split("\n\n")[0]),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    (PROPRIETARY, "All rights reserved."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", f"{GPL_HEADER.format(AGPL, 3)}"),
    ("AGPL-3.0", f"{AGPL} Version 3, 19 November 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", f"{LGPL_HEADER}"),
    ("LGPL-2.1", f"{LGPL} Version 2.1, February 1999"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "Released under the zlib License."),
    ("Zlib", ZLIB),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-ND-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("BSD-4-Clause", "Released under the BSD 4-Clause License."),
    ("BSD-4-Clause", f"{BSD_FIRST}\n\n{BSD_ADVERTISING}\n\n{BSD_THIRD.replace('3.', '4.')}\n\n{BSD_LAST}"),
)
TEMPLATES = (*TEMPLATES, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(t[0] for t in TEMPLATES) if name != PROPRIETARY))
#: Words one of which every template has; a unit without any isn't a notice.
MENTION = "(?i)licen[cs]|copyright|reserved|hereby|redistribut|spdx|unencumbered"
#: Base names of licence files, and the similarity from which a unit has a template's licence.
LICENCE_FILE = "(?i)^(un)?licen[cs]e([-.].*)?$|(?i)^copying([-.].*)?$|(?i)^notice([-.].*)?$"
LEAST = 0.7
#: Terms that tell licences of one family apart, versions and numbers of clauses among them, and those that deny.
FAMILY = ("affero", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike")
TELLING = (*FAMILY, "not", *"123456789")
#: Up to so many distinct terms a template is a notice: a unit must have the same telling terms.
NOTICE_TERMS = 24
#: A tag that names several licences is its own answer.
EXPRESSION = r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+(?:[\x20\t]+(?:OR|AND|WITH)[\x20\t]+[A-Za-z0-9.+-]+)+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK, STOP = r"\n[\x20\t\r]*\n", r"([.!?])[\x20\t\r\n]+"


def template_weights(templates: tuple = TEMPLATES) -> tuple[list[tuple], float]:
    """(template, licence, term, idf, weight of the unit vector) rows, and the idf of a term that no template has."""
    terms = [[w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.translate(str.maketrans(UPPER, LOWER))).split()] for _, t in templates]
    holders: dict[str, int] = {}
    for words in terms:
        for w in set(words):
            holders[w] = holders.get(w, 0) + 1
    idf = {w: log((1 + len(templates)) / (1 + n)) + 1 for w, n in holders.items()}
    rows = []
    for k, ((licence, _), words) in enumerate(zip(templates, terms, strict=True)):
        vector = {w: words.count(w) * idf[w] for w in words}
        norm = sqrt(sum(x * x for x in vector.values()))
        rows += [(k, licence, w, idf[w], x / norm) for w, x in vector.items()]
    return rows, log(1 + len(templates)) + 1


def tells(templates: tuple = TEMPLATES) -> list[tuple[int, bool, list[str], list[str]]]:
    """For each template whether it is a notice, and the telling terms that a unit must have: of a notice exactly these, of a
    longer text these of its family and, among others, the version in the licence's name, which BSD texts don't have."""
    out = []
    for k, (licence, text) in enumerate(templates):
        words = {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()}
        notice = len(words) <= NOTICE_TERMS
        version = [] if licence.startswith("BSD") else sorted({c for c in licence if c in "123456789"})
        out.append((k, notice, sorted(words & set(TELLING if notice else FAMILY)), [] if notice else version))
    return out


def units(text: Column, whole: Column) -> Column:
    """The paragraphs, sentences and lines of a text, and the text itself where ``whole``, that have a word of notices."""
    apart = F.regexp_replace(text, BLANK, "\x01")
    parts = F.concat(F.split(apart, "\x01", -1), F.split(F.regexp_replace(apart, STOP, "$1\x01"), "\x01", -1), F.split(text, "\n", -1), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(parts), lambda s: s.rlike(MENTION))


def best_of(licence: str = "licence", similarity: str = "similarity") -> Column:
    """The most similar, of equals the first by name; a mere reservation of rights yields to any licence."""
    return F.min(F.struct((F.col(licence) == PROPRIETARY).alias("yields"), (-F.col(similarity)).alias("s"), F.col(licence).alias("licence"))).alias("b")


def scored(texts: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, licence, similarity) of the distinct units (id, unit) that have a template's licence, or are a tag of several."""
    rows, unknown = template_weights(templates)
    spark = texts.sparkSession
    weights = F.broadcast(spark.createDataFrame(rows, "template int, licence string, term string, idf double, weight double"))  # the templates are fixed
    idf = F.broadcast(spark.createDataFrame(sorted({(w, i) for _, _, w, i, _ in rows}), "term string, idf double"))
    lowered = F.translate("unit", UPPER, LOWER)
    terms = texts.dropDuplicates(["id"]).select("id", F.explode(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    counts = terms.groupBy("id", "term").agg(F.count("*").alias("n"))
    vectors = materialize(counts.join(idf, "term", "left").select("id", "term", (F.col("n") * F.coalesce("idf", F.lit(unknown))).alias("x")))
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vectors.join(weights.drop("idf"), "term").groupBy("id", "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "id").select("id", "template", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).where(F.col("similarity") >= least)
    # a telling term that differs lets a unit fail, however similar it is
    told = vectors.where(F.col("term").isin(*TELLING)).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("_told"))
    asked = F.broadcast(spark.createDataFrame(tells(templates), "template int, _notice boolean, _terms array<string>, _version array<string>"))
    own = F.coalesce("_told", F.array().cast("array<string>"))
    of_family = F.filter(own, lambda w: w.isin(*FAMILY))
    fits = F.when(F.col("_notice"), own == F.col("_terms")).otherwise((of_family == F.col("_terms")) & (F.size(F.array_except("_version", own)) == 0))
    cosines = near.join(told, "id", "left").join(asked, "template").where(fits).select("id", "licence", "similarity")
    several = F.regexp_replace(F.regexp_extract("unit", EXPRESSION, 1), r"[\x20\t]+", " ")
    tags = texts.dropDuplicates(["id"]).select("id", several.alias("licence"), F.lit(1.0).alias("similarity")).where("licence <> ''")
    cosines = cosines.join(tags.select("id"), "id", "left_anti").unionByName(tags)
    return cosines.groupBy("id").agg(best_of()).select("id", "b.licence", (-F.col("b.s")).alias("similarity"))


def scan_licences(files: DataFrame, key: list[str], templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The columns ``key`` of every row of files (key..., path, text) with path, licence, similarity, origin, licence_dir.

    origin: ``file`` for a licence file with a licence, ``header`` for another file with one of its own, ``inherited``
    with the directory it comes from, or ``none`` with null licence. A path with several texts takes the best of them
    all; ties go to the first licence by name, and a mere reservation of rights yields to any licence. Of several licence
    files in a directory the best counts likewise. Null and empty texts have no licence of their own; a null path inherits
    nothing. Repeated rows each have their row; an empty table gives an empty table.
    """
    parts = F.split("path", "/", -1)
    name = F.element_at(parts, -1)
    directory = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    rows = materialize(files.select(*key, "path", directory.alias("_dir"), name.rlike(LICENCE_FILE).alias("_is_file")))
    said = files.where(F.col("text").rlike(MENTION) & F.col("path").isNotNull()).select("path", F.explode(units(F.col("text"), name.rlike(LICENCE_FILE))).alias("unit"))
    said = materialize(said.select("path", F.sha2(F.col("unit").cast("binary"), 256).alias("id"), "unit").dropDuplicates(["path", "id"]))
    own = said.select("path", "id").join(scored(said.select("id", "unit"), templates, least), "id")
    own = own.groupBy("path").agg(best_of()).select("path", "b.licence", (-F.col("b.s")).alias("similarity"))
    own = materialize(own)
    of_path = own.select("path", F.col("licence").alias("_own"), F.col("similarity").alias("_own_similarity"))
    given = (
        own.withColumn("_is_file", name.rlike(LICENCE_FILE)).where("_is_file").withColumn("_dir", directory)
        .groupBy("_dir").agg(best_of())
        .select(F.col("_dir").alias("_from"), F.col("b.licence").alias("_given"), (-F.col("b.s")).alias("_given_similarity"))
    )
    # ancestors of directories, not of files: a directory with many files is one row
    folders = rows.where("_dir IS NOT NULL").select("_dir").distinct()
    steps = F.split("_dir", "/", -1)
    depths = F.when(F.col("_dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(steps)))
    above = folders.select("_dir", F.explode(F.transform(depths, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("_from")))).alias("a"))
    nearest = above.select("_dir", "a.*").join(given, "_from").groupBy("_dir").agg(F.max(F.struct("depth", "_from", "_given", "_given_similarity")).alias("g"))
    joined = rows.join(of_path, "path", "left").join(nearest.select("_dir", "g.*"), "_dir", "left")
    mine = F.col("_own").isNotNull()
    return joined.select(
        *key, "path", F.coalesce("_own", "_given").alias("licence"), F.coalesce("_own_similarity", "_given_similarity").alias("similarity"),
        F.when(mine & F.col("_is_file"), "file").when(mine, "header").when(F.col("_given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("_from")).alias("licence_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): a source is a repository, the ids' hundreds and tens are its directories, and a document whose
    id ends in 0 is a licence file of its directory."""
    key = F.col("doc_id").cast("string")
    base = F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE.")).otherwise(F.lit("doc.")), key)
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 100 % 10").cast("string"), F.expr("doc_id div 10 % 10").cast("string"), base).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(document_files(table(spark, sf_dir, "documents")), ["doc_id"])


def _oracle() -> str:
    """The weights, too, are computed in SQL, from the templates' texts."""
    quoted = ", ".join("({}, '{}', '{}')".format(k, licence, text.replace("'", "''")) for k, (licence, text) in enumerate(TEMPLATES))
    terms = rf"regexp_extract_all(translate({{0}}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
    first = f"ORDER BY (licence = '{PROPRIETARY}'), similarity DESC, licence"
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    asked = ", ".join(f"({k}, {notice}, {listed(terms_)}, {listed(version)})" for k, notice, terms_, version in tells())
    return rf"""
WITH templates(template, licence, text) AS (VALUES {quoted}),
asked(template, notice, terms, version) AS (VALUES {asked}),
template_terms AS (SELECT template, licence, term, count(*) AS n FROM (SELECT template, licence, unnest({terms.format("text")}) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln(CAST(1 + (SELECT count(*) FROM templates) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM template_terms GROUP BY term),
weights AS (SELECT template, licence, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM template_terms JOIN idf USING (term)),
paths AS (SELECT doc_id, text, doc_id % 10 = 0 AS is_file, coalesce(source, 'none') || '/' || (doc_id // 100 % 10) || '/' || (doc_id // 10 % 10) AS dir,
          coalesce(source, 'none') || '/' || (doc_id // 100 % 10) || '/' || (doc_id // 10 % 10) || CASE WHEN doc_id % 10 = 0 THEN '/LICENSE.' ELSE '/doc.' END || doc_id AS path FROM documents),
marked AS (SELECT path, is_file, text, regexp_replace(text, '{BLANK}', chr(1), 'g') AS apart FROM paths WHERE regexp_matches(text, '{MENTION}')),
said AS (SELECT DISTINCT path, unit FROM (
  SELECT path, unnest(string_split(apart, chr(1))) AS unit FROM marked UNION ALL SELECT path, unnest(string_split(regexp_replace(apart, '{STOP}', '\1' || chr(1), 'g'), chr(1))) FROM marked
  UNION ALL SELECT path, unnest(string_split(text, chr(10))) FROM marked UNION ALL SELECT path, text FROM marked WHERE is_file) WHERE regexp_matches(unit, '{MENTION}')),
counts AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest({terms.format("unit")}) AS term FROM (SELECT DISTINCT unit FROM said)) GROUP BY ALL),
vectors AS (SELECT unit, term, n * coalesce(idf, ln(CAST(1 + (SELECT count(*) FROM templates) AS DOUBLE)) + 1) AS x FROM counts LEFT JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM vectors GROUP BY unit),
told AS (SELECT unit, list_sort(list(term) FILTER (term IN {TELLING})) AS told FROM counts GROUP BY unit),
tags AS (SELECT unit, regexp_replace(regexp_extract(unit, '{EXPRESSION}', 1), '[\x20\t]+', ' ', 'g') AS licence FROM (SELECT DISTINCT unit FROM said) WHERE regexp_matches(unit, '{EXPRESSION}')),
near AS (
  SELECT unit, template, licence, round(dot / norm, 6) AS similarity FROM (
    SELECT unit, template, licence, sum(x * weight) AS dot FROM vectors JOIN weights USING (term) GROUP BY ALL) JOIN norms USING (unit)),
cosines AS (
  SELECT unit, licence, similarity FROM (SELECT *, coalesce(told, []::VARCHAR[]) AS own FROM near JOIN told USING (unit) JOIN asked USING (template) ANTI JOIN tags USING (unit))
  WHERE CASE WHEN notice THEN own = terms ELSE list_filter(own, lambda w: w IN {FAMILY}) = terms AND len(list_filter(version, lambda w: NOT list_contains(own, w))) = 0 END
  UNION ALL SELECT unit, licence, 1.0 FROM tags),
best AS (SELECT unit, licence, similarity FROM cosines WHERE similarity >= {LEAST} QUALIFY row_number() OVER (PARTITION BY unit {first}) = 1),
own AS (SELECT path, licence, similarity FROM said JOIN best USING (unit) QUALIFY row_number() OVER (PARTITION BY path {first}) = 1),
given AS (SELECT dir AS licence_dir, licence, similarity FROM paths JOIN own USING (path) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir {first}) = 1),
above AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS licence_dir FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM paths))),
nearest AS (SELECT dir, licence_dir, licence, similarity FROM above JOIN given USING (licence_dir) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k DESC) = 1)
SELECT doc_id, p.path, coalesce(o.licence, n.licence) AS licence, coalesce(o.similarity, n.similarity) AS similarity,
       CASE WHEN o.path IS NOT NULL AND is_file THEN 'file' WHEN o.path IS NOT NULL THEN 'header' WHEN n.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.path IS NULL THEN n.licence_dir END AS licence_dir
FROM paths p LEFT JOIN own o ON p.path = o.path LEFT JOIN nearest n ON p.dir = n.dir"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {"op5_license_scan": _oracle()}
