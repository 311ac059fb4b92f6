import functools
import hashlib
import random
import re

from oracle import agree
from strandlake.llm import conversations
from strandlake.llm.conversations import damage, repair_report, repair_turns

SCHEMA = "conv_id long, turn long, role string, text string, `a.b c` string, _conv string, block string"
WORD = "[^\x20\x09-\x0d]"


def brute(rows):
    """The report of one conversation's rows, in order, by trying every edit."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.findall(WORD, text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")

    def add(state, initial):  # the state is the last initial, with '' before all
        out = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))
        return out

    @functools.cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                return (0, "", ())
        else:
            _, role, text = rows[i]
            cost, audit, kept = best(i + 1, state, 0)
            ways.append((2 + cost, "D" + audit, kept))
            if faults[i] in ("", "truncated"):
                for letter, to in [("K", role), ("R", "user"), ("R", "assistant")]:
                    if to and add(state, to[0]):
                        cost, audit, kept = best(i + 1, add(state, to[0]), 0)
                        ways.append(((letter == "R") + 5 * (faults[i] == "truncated") + cost, letter + audit, ((to, text), *kept)))
        if inserted < 3:
            for to in ("user", "assistant"):
                if add(state, to[0]):
                    cost, audit, kept = best(i, add(state, to[0]), inserted + 1)
                    ways.append((5 + cost, "I" + audit, ((to, ""), *kept)))
        return min(ways) if ways else (1 << 40, "", ())

    cost, audit, kept = best(0, "", 0)
    assert legal.fullmatch("".join(r[0] for r, _ in kept))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest(),
    ), kept


def in_order(rows):
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
    given = lambda x: " " if x is None else x
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, given(v[1]), digest(given(v[1]), given(v[2]))))


def made(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Yes.", "No!", "cut", "a longer one, cut", "", " \t", None, "Ü?  ", " ", "Why? "]
    return [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def checked(spark, rows, parts, **how):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    want = {c: brute(in_order([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_report(df, **how).select("conv_id", *(f.split()[0] for f in conversations.FOUND.split(", "))).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    turns = {}
    for r in sorted(repair_turns(df, **how).collect(), key=lambda r: (r["block"], r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["edit"] in "KRI"
    assert turns == {c: list(k) for c, (_, k) in want.items() if k}


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [r for c in [*range(150), None] for r in made(rng, c, rng.randrange(1, 9))]
    checked(spark, rows, 3)
    checked(spark, rows, 3, block=2)
    checked(spark, rows, 3, block_bytes=12)


def test_one_conversation_has_nearly_all_rows(spark):
    rng = random.Random(6)
    rows = made(rng, 7, 300) + made(rng, 8, 3) + [(7, 3, "user", "the same again.")] * 200
    checked(spark, rows, 4, block=16)
    checked(spark, [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(90)] + [(1, 91, "user", "x" * 100_000)], 4, block=8, block_bytes=1000)


def test_ties_take_the_least_edits():
    def audit(*turns):
        return brute([(i, *t) for i, t in enumerate(turns)])[0][5:7]

    assert audit(("user", "a."), ("user", "b."), ("assistant", "c.")) == (2, "DKK")
    assert audit(("assistant", "a."), ("user", "b.")) == (2, "RR")
    assert audit(("user", "a.")) == (2, "D")
    rows = [(0, "user", "a."), (1, "user", "b."), (2, "assistant", "c.")]
    faults, symbols = [0, 0, 0], [1, 1, 2]
    costs = conversations.costs_to_go(symbols, faults, conversations.ENDS)
    assert "".join(conversations.walk(symbols, faults, costs, 0, True)[0]) == brute(rows)[0][6]


def test_damage_and_empty(spark, tmp_path):
    import zlib

    rng = random.Random(7)
    rows = [r for c in range(60) for r in made(rng, c, 6)] + [(None, None, "user", "Nobody.")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, damage(df).collect())) == sorted(map(key, want))
    for found in (repair_report(df.limit(0)), repair_turns(df.limit(0))):
        assert not found.count()
    spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 20], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()}
    left = [r for r in want if r[0] is not None and r[0] < 20]
    for c in range(20):
        own = in_order([r[1:] for r in left if r[0] == c])
        assert got[c] == (brute(own)[0] if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))


def test_query(spark):
    agree(conversations.op13_conversation_repair(spark, "/root/testdata/sf0.01"), conversations.ORACLES["op13_conversation_repair"], "/root/testdata/sf0.01")
