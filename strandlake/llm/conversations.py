"""Repair of conversations by the cheapest edits that give them a legal sequence of roles.

Legal sequences of role initials are ``(s?(ua)+)?``. Its four states are: nothing yet, after s, after u, after a. A
backward program finds, for every turn and state, the cost to go; a forward walk then takes at each step the
ASCII-least edit among those that lie on a cheapest way, so that the audit is the least of all cheapest ones.

Rows are sorted by conversation and turn over range partitions, so a task finds conversations one after the other and
repairs them as they pass. Those that may go on in a neighbouring partition, or are longer than a block, are split:
each block gives the costs from each state to each state, a scan over the blocks of a conversation turns these into the
costs at each block's end, every block is walked from every state, and a second scan tells which of the walks is the
real one. Blocks are bounded in rows and bytes, and the scans read a few numbers a block, so no task holds a long
conversation; only its digest reads its text in one task, in blocks, as SHA-256 can't be computed otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
INITIALS = "sua"
#: The state after an initial in each state, -1 if it isn't legal there: nothing yet, after s, after u, after a.
STEP = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
#: The turn that a state asks for next, which inserted and reroled turns get, and the state after it.
WANTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Costs at the end of a conversation: a cheapest completion inserts what is missing.
ENDS = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATE = range(4)
#: Rows and bytes of text that a block holds at most; a longer text is a block of its own.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def costs_to_go(symbols: list[int], faults: list[int], ends: tuple[int, ...]) -> list[list[int]]:
    """For each turn, and for the end, the cost to go from each state. Symbols: place in INITIALS, -1 for others."""
    now, out = list(ends), [list(ends)]
    for symbol, fault in zip(reversed(symbols), reversed(faults), strict=True):
        cost = [DELETE + v for v in now]
        if fault in (OK, TRUNCATE):
            extra = TRUNCATED if fault == TRUNCATE else 0
            for s in range(4):
                to = STEP[s][symbol] if symbol >= 0 else -1
                cost[s] = min(cost[s], REROLE + extra + now[AFTER[s]], KEEP + extra + now[to] if to >= 0 else FAR)
        for _ in range(3):  # a run of insertions passes each state once at most
            cost = [min(c, INSERT + cost[AFTER[s]]) for s, c in enumerate(cost)]
        now = cost
        out.append(now)
    return out[::-1]


def transfer(symbols: list[int], faults: list[int]) -> list[int]:
    """The least cost from each state to each state, row by row."""
    columns = [costs_to_go(symbols, faults, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
    return [min(columns[e][s], FAR) for s in range(4) for e in range(4)]


def walk(symbols: list[int], faults: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[list[str], int]:
    """Each turn's edits (insertions before it, then its own) from ``state``, and the state at the end.

    For the last block one more entry has the insertions after all turns.
    """
    out = []
    for i, (symbol, fault) in enumerate(zip(symbols, faults, strict=True)):
        edits = ""
        while True:
            go, rest = costs[i][state], costs[i + 1]
            if go == DELETE + rest[state]:
                edits += "D"
                break
            if go == INSERT + costs[i][AFTER[state]]:
                edits, state = edits + "I", AFTER[state]
                continue
            extra, to = TRUNCATED if fault == TRUNCATE else 0, STEP[state][symbol] if symbol >= 0 else -1
            kept = to >= 0 and go == KEEP + extra + rest[to]
            edits, state = edits + ("K" if kept else "R"), to if kept else AFTER[state]
            break
        out.append(edits)
    if last:
        edits = ""
        while state in (1, 2):
            edits, state = edits + "I", AFTER[state]
        out.append(edits)
    return out, state


def repaired(edits: list[str], turns: list[tuple[str, str]], state: int) -> Iterator[tuple[int, str, str, str]]:
    """(place of the turn, edit, role, text) of what stays, from ``state`` on; the place after the last is for the end."""
    for i, todo in enumerate(edits):
        for edit in todo:
            if edit == "I":
                yield i, edit, WANTED[state], ""
                state = AFTER[state]
            elif edit == "R":
                yield i, edit, WANTED[state], turns[i][1]
                state = AFTER[state]
            elif edit == "K":
                yield i, edit, *turns[i]
                state = STEP[state][INITIALS.index(turns[i][0][0])]


def symbol_of(role: str) -> int:
    return INITIALS.find(role[:1]) if role else -1


def illegal_steps(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with what their faults need, sorted over range partitions. Rows of one turn go by role, then by a digest."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.rtrim("_text", F.lit(BLANKS))
    prepared = (
        rows.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"))
        .withColumn("_digest", F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256)))
        .withColumn("_fault", F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), OK).otherwise(TRUNCATE))
        .withColumn("_salt", F.monotonically_increasing_id())  # parts equal rows, so that many of them can be dealt out
    )
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_digest", "_salt"]
    return prepared.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")


def blocks_of(batches: Iterator[pa.RecordBatch], block: int, block_bytes: int) -> Iterator[tuple[object, list[tuple], bool, bool]]:
    """Runs of rows of one conversation, bounded: (conversation, rows, whether it begins here, whether it ends here).

    What begins or ends with the partition counts as neither, for it may go on in a neighbour.
    """
    conv, rows, size, begins, first = None, [], 0, False, True
    for batch in batches:
        for c, *row in zip(*(batch.column(n).to_pylist() for n in ("_conv", "_turn", "_role", "_text", "_digest", "_fault")), strict=True):
            other = first or c != conv
            if rows and (other or len(rows) == block or size + len(row[2]) > block_bytes):
                yield conv, rows, begins, other
                begins, rows, size = False, [], 0
            if other:
                conv, begins, first = c, not first, False
            rows.append(row)
            size += len(row[2])
    if rows:
        yield conv, rows, begins, False


def faults_of(rows: list[tuple]) -> list[int]:
    """Each row's first fault, as far as the rows at hand tell."""
    seen, out = set(), []
    for _turn, _role, _text, digest, fault in rows:
        out.append(DUPLICATE if fault != BLANK and digest in seen else fault)
        seen.add(digest)
    return out


def digest_of(turns: Iterator[tuple[int, str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in turns).encode("utf-8", "surrogatepass")).hexdigest()


def report_whole(rows: list[tuple]) -> tuple:
    """The result of a conversation at hand as a whole."""
    faults, symbols = faults_of(rows), [symbol_of(r[1]) for r in rows]
    costs = costs_to_go(symbols, faults, ENDS)
    edits, _ = walk(symbols, faults, costs, 0, last=True)
    turns = {r[0] for r in rows if r[0] is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATE)), illegal_steps([r[1][:1] for r in rows]),
        costs[0][0], "".join(edits), digest_of(repaired(edits, [(r[1], r[2]) for r in rows], 0)),
    )


def solved(split: DataFrame) -> DataFrame:
    """(conv, block, last, start, edits, faults) of each block of split rows: its real walk."""
    spark = split.sparkSession
    conv = split.schema["conv"].dataType.simpleString()
    # a turn said before: in the same block, or in an earlier one, where each block sends each saying once
    sayings = split.where(f"fault <> {BLANK}").groupBy("conv", "digest", "block").agg(F.min("row").alias("row"))
    before = sayings.groupBy("conv", "digest").agg(F.min("block").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = sayings["conv"].eqNullSafe(before["conv"]) & (sayings["digest"] == before["digest"])
    again = sayings.join(before, same).where("block > earliest").groupBy("block").agg(F.collect_set("row").alias("again"))
    cells = F.array_sort(F.collect_list(F.struct("row", "symbol", "fault", "digest")))
    blocks = split.groupBy("conv", "block").agg(cells.alias("cells"), F.max("initial_last").alias("to"), F.max("initial_first").alias("of")).join(again, "block", "left")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cells, again in zip(batch.column("cells").to_pylist(), batch.column("again").to_pylist(), strict=True):
                local = faults_of([(None, None, None, c["digest"], c["fault"]) for c in cells])
                earlier = set(again or ())
                firsts = {c["digest"] for c in cells if c["row"] in earlier}
                faults = [DUPLICATE if c["digest"] in firsts and f != BLANK else f for c, f in zip(cells, local, strict=True)]
                symbols = [c["symbol"] for c in cells]
                found.append((symbols, faults, transfer(symbols, faults)))
            symbols, faults, costs = (list(v) for v in zip(*found, strict=True)) if found else ([], [], [])
            short, long = pa.list_(pa.int32()), pa.list_(pa.int64())
            arrays = [batch.column(n) for n in ("conv", "block", "of", "to")] + [pa.array(symbols, short), pa.array(faults, short), pa.array(costs, long)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "block", "of", "to", "symbols", "faults", "costs"])

    coded_blocks = materialize(
        blocks.select("conv", "block", "of", "to", "cells", "again").mapInArrow(coded, f"conv {conv}, block long, of string, to string, symbols array<int>, faults array<int>, costs array<long>")
    )

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = None, None
        for batch in batches:
            out = []
            for conv, block, costs in zip(*(batch.column(n).to_pylist() for n in ("conv", "block", "costs")), strict=True):
                last = held != (conv,)
                held, ends = (conv,), list(ENDS) if last else ends
                out.append((block, last, ends))
                ends = [min(costs[4 * s + e] + ends[e] for e in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "last", "ends"), r, strict=True)) for r in out], pa.schema([("block", pa.int64()), ("last", pa.bool_()), ("ends", pa.list_(pa.int64()))]))

    by_conv = coded_blocks.select("conv", "block", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    walked = coded_blocks.join(by_conv.mapInArrow(backward, "block long, last boolean, ends array<long>"), "block")

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, to = [], []
            for symbols, faults, ends, last in zip(*(batch.column(n).to_pylist() for n in ("symbols", "faults", "ends", "last")), strict=True):
                costs = costs_to_go(symbols, faults, tuple(ends))
                ways = [walk(symbols, faults, costs, s, last) for s in range(4)]
                edits.append([e for e, _ in ways])
                to.append([s for _, s in ways])
            arrays = [batch.column(n) for n in ("conv", "block", "last", "faults", "of", "to")] + [pa.array(edits, pa.list_(pa.list_(pa.string()))), pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "block", "last", "faults", "of", "to", "edits", "states"])

    ways = materialize(
        walked.mapInArrow(walks, f"conv {conv}, block long, last boolean, faults array<int>, of string, to string, edits array<array<string>>, states array<int>")
    )

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, said = None, 0, None
        for batch in batches:
            out = []
            for conv, block, states, of, to in zip(*(batch.column(n).to_pylist() for n in ("conv", "block", "states", "of", "to")), strict=True):
                if held != (conv,):
                    held, state, said = (conv,), 0, None
                out.append((block, state, said is not None and said + of not in ("su", "ua", "au")))
                state, said = states[state], to
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "start", "bad"), r, strict=True)) for r in out], pa.schema([("block", pa.int64()), ("start", pa.int32()), ("bad", pa.bool_())]))

    starts = ways.select("conv", "block", "states", "of", "to").repartition("conv").sortWithinPartitions("conv", "block")
    found = ways.join(starts.mapInArrow(forward, "block long, start int, bad boolean"), "block")
    return materialize(found.select("conv", "block", "last", "start", "bad", "faults", F.get("edits", F.col("start")).alias("edits")))


def report_split(split: DataFrame) -> DataFrame:
    """The results of conversations in several blocks."""
    conv = split.schema["conv"].dataType.simpleString()
    blocks = solved(split)
    turns = split.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("row", "role", "text", "initial"))).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ("block", "blank", "duplicate", "truncated", "illegal", "cost", "kept")
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("text", pa.string())])
            for r in batch.to_pylist():
                kept = [f"{role}:{text}" for _, _, role, text in repaired(r["edits"], [(t["role"], t["text"]) for t in r["turns"]], r["start"])]
                cost = sum(COSTS[e] + (TRUNCATED if e in "KR" and r["faults"][i] == TRUNCATE else 0) for i, edits in enumerate(r["edits"]) for e in edits)
                piece = {"conv": r["conv"], "block": r["block"], "cost": cost, "audit": "".join(r["edits"]), "kept": len(kept), "text": "\n".join(kept)}
                piece |= {n: r["faults"].count(f) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATE))}
                piece["illegal"] = illegal_steps([t["initial"] for t in r["turns"]]) + r["bad"]
                yield pa.RecordBatch.from_pylist([piece], schema)

    numbers = "blank long, duplicate long, truncated long, illegal long, cost long"
    pieces = blocks.join(turns.select("block", "turns"), "block").mapInArrow(joined, f"conv {conv}, block long, {numbers}, kept long, audit string, text string")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        held = None

        def ended() -> pa.RecordBatch:
            conv, counts, audit, sha, _ = held
            arrays = [pa.array([conv[0]], conv[1]), *(pa.array([v], t.type) for v, t in zip([*counts, "".join(audit), sha.hexdigest()], schema, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["conv", *schema.names])

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held[0][0] != r["conv"]:
                    if held is not None:
                        yield ended()
                    held = [(r["conv"], batch.schema.field("conv").type), [0] * 5, [], hashlib.sha256(), False]
                held[1] = [a + r[n] for a, n in zip(held[1], ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
                held[2].append(r["audit"])
                if r["kept"]:
                    held[3].update((("\n" if held[4] else "") + r["text"]).encode("utf-8", "surrogatepass"))
                    held[4] = True
        if held is not None:
            yield ended()

    counted = pieces.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(summed, f"conv {conv}, {numbers}, audit string, repaired_sha256 string")
    gaps = split.groupBy("conv", "turn").count().groupBy(F.col("conv").alias("_of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    return counted.join(gaps, F.col("conv").eqNullSafe(F.col("_of"))).select("conv", *(f.split()[0] for f in FOUND.split(", ")))


def dealt(rows: DataFrame, whole, out: str, block: int, block_bytes: int) -> DataFrame:
    """One table of the results of ``whole`` for conversations that a task sees entirely, and of the rows of all others."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in out.split(", ")]
    schema = f"conv {conv}, {out}, block long, row int, turn long, role string, text string, digest binary, fault int, symbol int, initial string, initial_first string, initial_last string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        fields = [f.split() for f in schema.split(", ")][1:]
        number, part, id_type, buffer, size = 0, TaskContext.get().partitionId(), None, [], 0

        def flushed() -> pa.RecordBatch:
            types = [("conv", id_type), *((n, kinds[t]) for n, t in fields)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in buffer], t) for n, t in types], [n for n, _ in types])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("_conv").type
                yield batch

        for c, held, begins, ends in blocks_of(typed(), block, block_bytes):
            if begins and ends:
                buffer += [{"conv": c} | dict(zip(names, r, strict=True)) for r in whole(held)]
            else:
                for i, (turn, role, text, digest, fault) in enumerate(held):
                    buffer.append({"conv": c, "block": (part << 32) + number, "row": i, "turn": turn, "role": role, "text": text, "digest": digest, "fault": fault, "symbol": symbol_of(role), "initial": role[:1]})
                    size += len(text)
                buffer[-len(held)]["initial_first"], buffer[-1]["initial_last"] = held[0][1][:1], held[-1][1][:1]
                number += 1
            if len(buffer) >= block or size >= block_bytes:
                yield flushed()
                buffer, size = [], 0
        if buffer:
            yield flushed()

    return materialize(ordered(bounded(rows)).mapInArrow(run, schema))


def repair_report(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What repairing the conversations of (conv_id, turn, role, text) takes: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256, one row for each conv_id in the table.

    Roles and texts that are null count as one space, so they are blank; null turns come first and don't count for gaps;
    null conv_ids are one conversation. A role whose first letter isn't s, u or a, or that is empty, can be reroled or
    deleted only. Rows of one turn go by role, then by a digest of the text; repeated rows are duplicates. An empty table
    gives an empty table. Other columns, of any name, are ignored.
    """
    both = dealt(rows.select("conv_id", "turn", "role", "text"), lambda held: [report_whole(held)], FOUND, block, block_bytes)
    names = [f.split()[0] for f in FOUND.split(", ")]
    return both.where("block IS NULL").select("conv", *names).unionByName(report_split(both.where("block IS NOT NULL"))).withColumnRenamed("conv", "conv_id")


def repair_turns(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The repaired conversations of (conv_id, turn, role, text): conv_id, block, place, edit, role, text, a row for each turn.

    ``block`` and ``place`` order a conversation's turns; edit is K for a turn kept, R for one with another role, I for one
    inserted. Nulls, ties, repeated rows, empty tables and other columns are as in ``repair_report``; a conversation
    without turns left has no rows.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def whole(held: list[tuple]) -> list[tuple]:
        faults, symbols = faults_of(held), [symbol_of(r[1]) for r in held]
        edits, _ = walk(symbols, faults, costs_to_go(symbols, faults, ENDS), 0, last=True)
        return [(i, e, role, text) for i, (_, e, role, text) in enumerate(repaired(edits, [(r[1], r[2]) for r in held], 0))]

    both = dealt(rows.select("conv_id", "turn", "role", "text"), whole, "place int, edit string, new_role string, new_text string", block, block_bytes)
    split = both.where("block IS NOT NULL")
    turns = split.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "role", "text"))).alias("turns"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                kept = list(repaired(r["edits"], [(t["role"], t["text"]) for t in r["turns"]], r["start"]))
                columns = [[r["conv"]] * len(kept), [r["block"]] * len(kept), list(range(len(kept))), [k[1] for k in kept], [k[2] for k in kept], [k[3] for k in kept]]
                types = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["conv_id", "block", "place", "edit", "role", "text"])

    schema = f"conv_id {conv}, block long, place int, edit string, role string, text string"
    done = both.where("block IS NULL").select(F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("block"), "place", "edit", F.col("new_role").alias("role"), F.col("new_text").alias("text"))
    return done.unionByName(solved(split).join(turns, "block").mapInArrow(rebuilt, schema))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of ``conv_id:turn`` decides; nulls become one space."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind"))
        .where("_kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("col")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair_report(damage(rows)).withColumnRenamed("conv_id", "_conv")
    all_ids = rows.select("conv_id").distinct()
    names = [f.split()[0] for f in FOUND.split(", ")]
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    kept = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return kept.select("conv_id", *(F.coalesce(n, F.lit(nothing.get(n, 0))).alias(n) for n in names))


SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(name, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b:
         list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: z::UBIGINT)), lambda d, k: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT)))), 4294967295::UBIGINT) % 20 AS kind
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, E' \t\n\x0b\x0c\r') AS body
  FROM damaged
), faulty AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault
  FROM placed
), bounds AS (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id),
-- costs to go from each state; the step table is (state, initial) -> state
back(conv_id, i, v) AS (
  SELECT conv_id, n + 1, [0, 10, 5, 0] FROM bounds
  UNION ALL
  SELECT conv_id, i, list_transform(range(4), lambda s: least(w[s + 1], 5 + w[[3, 3, 4, 3][s + 1]], 10 + w[[4, 4, 3, 4][s + 1]])) FROM (
    SELECT f.conv_id, f.i, list_transform(range(4), lambda s: least(
      2 + b.v[s + 1],
      CASE WHEN f.fault IN (0, 3) THEN 1 + (f.fault // 3) * 5 + b.v[[3, 3, 4, 3][s + 1]] ELSE 1000000000 END,
      CASE WHEN f.fault IN (0, 3) AND s = 0 AND f.initial = 's' THEN (f.fault // 3) * 5 + b.v[2]
           WHEN f.fault IN (0, 3) AND s IN (0, 1, 3) AND f.initial = 'u' THEN (f.fault // 3) * 5 + b.v[3]
           WHEN f.fault IN (0, 3) AND s = 2 AND f.initial = 'a' THEN (f.fault // 3) * 5 + b.v[4] ELSE 1000000000 END)) AS w
    FROM back b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)
), costs AS MATERIALIZED (SELECT * FROM back),
walk(conv_id, step, i, s, edit, piece) AS (
  SELECT conv_id, 0, 1::BIGINT, 0, '', NULL::VARCHAR FROM bounds
  UNION ALL
  SELECT conv_id, step + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
         e, CASE e WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END END
  FROM (
    SELECT w.conv_id, w.step, w.i, w.s, f.initial, f.role, f.text,
      CASE WHEN f.i IS NULL THEN 'I'
           WHEN c.v[w.s + 1] = 2 + d.v[w.s + 1] THEN 'D'
           WHEN c.v[w.s + 1] = 5 + c.v[[3, 3, 4, 3][w.s + 1]] THEN 'I'
           WHEN w.s = 0 AND f.initial = 's' AND c.v[1] = (f.fault // 3) * 5 + d.v[2] THEN 'K'
           WHEN w.s IN (0, 1, 3) AND f.initial = 'u' AND c.v[w.s + 1] = (f.fault // 3) * 5 + d.v[3] THEN 'K'
           WHEN w.s = 2 AND f.initial = 'a' AND c.v[3] = (f.fault // 3) * 5 + d.v[4] THEN 'K'
           ELSE 'R' END AS e
    FROM walk w JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i
    LEFT JOIN costs d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1
    LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
    WHERE f.i IS NOT NULL OR w.s IN (1, 2))
), audits AS (
  SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, coalesce(string_agg(piece, chr(10) ORDER BY step), '') AS repaired FROM walk GROUP BY conv_id
), steps AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM steps GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(c.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = 1
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": SQL}
