"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds which (blob, rule
version) pairs were scanned and what was found; only pairs that it lacks are scanned, each blob once however many
paths and versions have it, and findings are joined back to all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, materialize, table, whole_rows

#: Raise it with every change of the rules: what older versions found stays in the ledger beside the new.
RULES_VERSION = "1"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group whose length decides, least length). Runs that are too short are left out by the pattern
#: where that gives the same spans: a run of these classes is matched whole or not at all.
RULES = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
LEDGER = f"blob_id string, rule_version string, spans {SPANS}"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def find_spans(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(blob_id, spans) of (blob_id, text); only blobs with findings. Repeated rows of a blob count once.

    A pattern's matches and the gaps between them alternate, so running sums of their lengths in code points give the
    positions; rows are matches, and a window holds those of one pattern in one text.
    """
    hit = blobs.where(reduce(lambda a, b: a | b, [F.col("text").rlike(pattern) for _, pattern, _, _ in rules]))
    each = []
    for rank, (_, pattern, group, least) in enumerate(rules):
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        decides = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else matches
        widths = F.arrays_zip(
            F.transform(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches)), F.length).alias("gap"),
            F.transform(matches, F.length).alias("width"),
            F.transform(decides, lambda x: F.length(x) >= least).alias("kept"),  # noqa: B023
        )
        each.append(F.transform(widths, lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), m["gap"].alias("gap"), m["width"].alias("width"), m["kept"].alias("kept"))))  # noqa: B023
    rows = hit.select("blob_id", F.explode(F.concat(*each)).alias("m")).select("blob_id", "m.*").distinct().selectExpr(
        "blob_id", "rank", "kept", "width", "sum(cast(gap + width AS bigint)) OVER (PARTITION BY blob_id, rank ORDER BY at ROWS UNBOUNDED PRECEDING) AS end"
    )
    spans = rows.where("kept").select("blob_id", F.struct((F.col("end") - F.col("width")).alias("start"), "rank", "end").alias("span"))
    return spans.groupBy("blob_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # those of one text


def scan_versions(versions: DataFrame, path: list[str], ledger: DataFrame | None = None, rules: tuple = RULES, rule_version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """The rows to add to the ledger, and the columns ``path`` of every row of ``versions`` with its blob_id and spans.

    ``versions`` has the columns ``path`` that name a version of a path, and text. A null text is empty. Repeated rows
    each get their findings; null path columns are values. Spans are empty arrays where nothing was found. Rows that the
    ledger repeats count once. An empty table gives empty tables; columns other than ``path`` and text aren't read.
    """
    if ledger is not None:
        ledger = ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob_id"])
    named = versions.select(*path, F.coalesce("text", F.lit("")).alias("text"))
    addressed = materialize(named.select(*path, F.sha2(F.col("text").cast("binary"), 256).alias("blob_id")))
    one = addressed.groupBy("blob_id").agg(F.min(F.struct(*path)).alias("_one"))
    if ledger is not None:
        one = one.join(ledger.select("blob_id"), "blob_id", "left_anti")
    one = materialize(one)
    # one version of each unseen blob brings its text; the small side is the hash table, texts are not sorted
    same = reduce(lambda a, b: a & b, [F.col(f"_one.{c}").eqNullSafe(F.col(f"v.{c}")) for c in path])
    keyed = named.alias("v").join(one.hint("shuffle_hash"), same & (F.sha2(F.col("v.text").cast("binary"), 256) == F.col("blob_id")))
    # as it seems to need both sides, the scan isn't pushed below the join, where it would read seen blobs and copies
    unseen = keyed.select("blob_id", F.when(F.col("blob_id").isNotNull(), F.col("text")).alias("text"))
    found = materialize(find_spans(unseen, rules))
    added = one.select("blob_id").join(found, "blob_id", "left").select("blob_id", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", no_spans()).alias("spans"))
    known = found
    if ledger is not None:
        known = known.unionByName(ledger.where(F.size("spans") > 0).select("blob_id", "spans"))
    return added, addressed.join(known, "blob_id", "left").select(*path, "blob_id", F.coalesce("spans", no_spans()).alias("spans"))


def digest(found: DataFrame, path: list[str], rules: tuple = RULES) -> DataFrame:
    """Counts of each kind, the spans as text, and the SHA-256 of that text."""
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{r[0]}") for k, r in enumerate(rules)]  # noqa: B023
    return found.select(*path, *counts, text.alias("spans")).withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256)).select(*path, *[f"n_{r[0]}" for r in rules], "base_sha256", "spans")


def redact(docs: DataFrame, key: str = "doc_id", mark: str = "[SECRET]", ledger: DataFrame | None = None) -> DataFrame:
    """The documents, all columns as they are, with every found span, or union of overlapping spans, of text replaced by
    ``mark``.

    Null texts, and texts without a finding, stay. Rows that repeat ``key`` are treated each by its own text, null keys
    too; rows that repeat in full stay as many. Other columns may have any names. An empty table gives an empty table.
    """
    _, found = scan_versions(docs, [key], ledger)
    marked = found.where(F.size("spans") > 0).select(F.col(key).alias("k"), "blob_id", "spans").distinct()
    pieces = (
        marked.select("k", "blob_id", F.explode("spans").alias("s")).select("k", "blob_id", "s.*")
        .selectExpr("*", "max(end) OVER (PARTITION BY blob_id, k ORDER BY start, rank, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
        .selectExpr("*", "count_if(before IS NULL OR start > before) OVER (PARTITION BY blob_id, k ORDER BY start, rank, end) AS island")
        .groupBy("k", "blob_id", "island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
        .groupBy("k", "blob_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    )
    # the document is one column, so that no name of its own can clash
    rows = whole_rows(docs)
    text, cuts = F.col("row.text"), F.col("cuts")
    start_of = lambda i: F.when(i == 0, F.lit(0)).otherwise(cuts[i - 1]["b"])
    whole = F.concat(
        F.array_join(F.transform(cuts, lambda c, i: F.concat(F.substring(text, (start_of(i) + 1).cast("int"), (c["a"] - start_of(i)).cast("int")), F.lit(mark))), ""),
        F.substring(text, (F.element_at(cuts, -1)["b"] + 1).cast("int"), F.length(text)),
    )
    joined = rows.join(pieces, F.col("row").getField(key).eqNullSafe(F.col("k")) & (F.sha2(text.cast("binary"), 256) == F.col("blob_id")), "left")
    clean = F.when(cuts.isNull(), text).otherwise(whole)
    return columns_of(joined, docs, text=clean)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    return digest(found, ["doc_id"])


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        rx = pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
       list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS w
FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {group}) AS g, regexp_split_to_array(t, '{rx}') AS p
            FROM docs WHERE regexp_matches(t, '{rx}')))
WHERE length(g[i]) >= {least}""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + w AS BIGINT), ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN joined j ON d.doc_id = j.doc_id"""


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES = {"op6_secret_scan": _oracle()}
