"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' byte lengths give their character spans, and these are joined to
the sections' character intervals by binary search. A token that crosses a border goes, by the rule ``majority``, to the
section with most of its characters (of equals to the earlier), or, by the rule ``start``, to that of its first
character; so the sections' counts and the tokens outside all sections always add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, table, worker_cache
from .packing import SPECIAL, VOCABULARY, encoder

RULES = ("majority", "start")
OUT = "doc_id long, section string, start long, end long, n_tokens long, n_crossing long"


def token_bytes(path: str, pattern: str) -> np.ndarray:
    """The number of bytes of each id."""
    held = worker_cache().__dict__.setdefault("token_bytes", {})
    if path not in held:
        ranks = encoder(path, pattern)._mergeable_ranks
        sizes = np.zeros(max([*ranks.values(), *SPECIAL.values()]) + 1, np.int64)
        for word, rank in [*ranks.items(), *((k.encode(), v) for k, v in SPECIAL.items())]:
            sizes[rank] = len(word)
        held[path] = sizes
    return held[path]


def spans(data: bytes, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token; a token that is a part of a character has that character's place."""
    ends = np.cumsum(sizes[ids])
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, -1 for none, and whether it crosses a border. Sections are in order and don't overlap."""

    def section_of(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, "right") - 1
        return np.where((k >= 0) & (at < ends[np.maximum(k, 0)]), k, -1) if len(starts) else np.full(len(at), -1)

    owner, other = section_of(first), section_of(last)
    # a token also crosses if a whole gap or section lies within it; empty sections have no characters to cross into
    borders = np.sort(np.concatenate([starts[ends > starts], ends[ends > starts]]))
    between = np.searchsorted(borders, last, "right") != np.searchsorted(borders, first, "right")
    crossing = (owner != other) | between
    if rule == "majority":
        for t in np.flatnonzero(crossing).tolist():
            places = section_of(np.arange(first[t], last[t] + 1))
            found, at, n = np.unique(places, return_index=True, return_counts=True)
            owner[t] = found[min(range(len(found)), key=lambda i: (-n[i], at[i]))]
    return owner, crossing


def line_sections(data: bytes) -> list[tuple[str, int, int]]:
    """The lines of a text, each with its line feed, in code points; an empty text has one empty line."""
    if not data:
        return [("0", 0, 0)]
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 10) + 1
    cuts = np.unique(np.concatenate([[0], feeds, [len(raw)]]))
    count = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[cuts].tolist()
    return [(str(k), a, b) for k, (a, b) in enumerate(zip(count, count[1:], strict=False))]


def token_counts(docs: DataFrame, sections: DataFrame | None = None, rule: str = "majority", path: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing of each section of every document.

    ``sections`` is (doc_id, section, start, end) in code points, end excluded, without overlaps; without it, sections are
    the lines. Tokens in no section are counted under a null section, if there are any or the document has no section.
    Null texts are empty. Rows that repeat a doc_id are documents of their own, with the same sections. Intervals
    beyond a text hold nothing; null bounds and sections that end before they start are left out; of overlapping ones
    a character belongs to the one that starts last.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    path, pattern = path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    given = sections is not None
    if given:
        kept = sections.where("start <= end").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("section", "string"))]))).alias("_sections")
        )  # the sections of one document
        rows = rows.join(kept, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, sizes = encoder(path, pattern)._core_bpe, token_bytes(path, pattern)
        for batch in chunks(batches, "text"):
            out = []
            given_rows = batch.column("_sections").to_pylist() if given else [None] * batch.num_rows
            for doc, text, mine in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), given_rows, strict=True):
                data = (text or "").encode()
                parts = [(s["section"], s["start"], s["end"]) for s in mine or []] if given else line_sections(data)
                starts = np.array([p[1] for p in parts], np.int64)
                ends = np.array([p[2] for p in parts], np.int64)
                if len(parts) > 1:
                    ends[:-1] = np.minimum(ends[:-1], starts[1:])
                ids = np.frombuffer(bytes(core.encode_to_tiktoken_buffer(text or "", set(SPECIAL))), np.uint32)
                owner, crossing = attribute(*spans(data, ids, sizes), starts, ends, rule) if len(ids) else (np.zeros(0, int), np.zeros(0, bool))
                n = np.bincount(owner + 1, minlength=len(parts) + 1)
                across = np.bincount(owner + 1, weights=crossing, minlength=len(parts) + 1).astype(np.int64)
                out += [(doc, *p, a, b) for p, a, b in zip(parts, n[1:].tolist(), across[1:].tolist(), strict=True)]
                if n[0] or not parts:
                    out.append((doc, None, None, None, int(n[0]), int(across[0])))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return bounded(rows).mapInArrow(run, OUT)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
