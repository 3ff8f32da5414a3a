"""Operator 13 against plain shortest paths."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cortexgrid.llm import conversations
from cortexgrid.llm.conversations import END, NEVER, Lattice, block_costs, exit_prices
from cortexgrid.llm.queries import op13_conversations

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        if h:
            out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """(cost, audit, lines) of rows (role, text, fault), by the least (cost, audit) from each row and state on."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        best[i] = {s: (0, "", ()) for s in ("", "a")} if i == len(rows) else {}
        for s in after:
            ways = [best[i][s]] if s in best[i] else []
            if i < len(rows):
                role, text, fault = rows[i]
                extra = fault == "t"
                if s in best[i + 1]:
                    c, e, lines = best[i + 1][s]
                    ways.append((c + 3, "D" + e, lines))
                if fault not in ("b", "d"):
                    for to, new in (("u", "user"), ("a", "assistant"), ("s", None)):
                        if to in after[s] and to in best[i + 1]:
                            c, e, lines = best[i + 1][to]
                            if role[:1] == to:
                                ways.append((c + extra, "K" + e, (f"{role}:{text}", *lines)))
                            if new:
                                ways.append((c + 2 + extra, "R" + e, (f"{new}:{text}", *lines)))
            if ways:
                best[i][s] = min(ways)
        for _ in range(4):
            for s in after:
                for to, new in (("u", "user:"), ("a", "assistant:")):
                    if to in after[s] and to in best[i]:
                        c, e, lines = best[i][to]
                        best[i][s] = min([(c + 2, "I" + e, (new, *lines)), *([best[i][s]] if s in best[i] else [])])
    return best[0][""]


def brute(given):
    rows, out = damage(given), []
    for conv in {r[0] for r in given}:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in own:
            bare = text.rstrip(BLANK)
            faulty.append((role, text, "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "k"))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f[2] == k for f in faulty) for k in "bdt"]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = plain_repair(faulty)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversations(spark, SF)) == brute(rows)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_odd_conversations(spark, block):
    random.seed(5)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(random.randint(1, 14)):
            role = random.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((conv, random.choice([turn, turn, 3, None]), role, random.choice(["Hi.", "So what? ", "unfinished", "", " \n", "é!", None, "long " * 2000 + "."])))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else "same.") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).repartition(3)
    assert found(conversations.conversation_digests(df, conversations.damaged(df), block)) == brute(rows)


def test_a_conversation_without_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert found(conversations.conversation_digests(df, conversations.damaged(df))) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(conversations.conversation_digests(df.limit(0), df.limit(0))) == []


def test_repaired_rows(spark):
    df = spark.createDataFrame([("x", 1, "system", "Be kind."), ("x", 2, "assistant", "Hello."), ("x", 2, "assistant", "Hello.")], "conv_id string, turn long, role string, text string")
    report, repaired = conversations.repair_conversations(df)
    assert [(r.audit, r.cost, r.duplicate) for r in report.collect()] == [("KIKD", 5, 1)]
    assert [(r.edit, r.role, r.text) for r in repaired.orderBy("place", "_cr_at").collect()] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello.")]


def test_prices_are_dual():
    random.seed(6)
    for _ in range(200):
        n = random.randint(0, 12)
        initials, faults = "".join(random.choices("suax", k=n)), "".join(random.choices("kkktbd", k=n))
        lattice = Lattice(initials, faults, END, True)
        cost = lattice.cost(0)
        assert all(lattice.price[node] <= c + lattice.price[to] for node, arcs in enumerate(lattice.arcs) for _, to, c in arcs)
        rows = [(dict(s="system", u="user", a="assistant", x="other")[c], "", f) for c, f in zip(initials, faults)]
        assert (cost, lattice.trace(0)[0]) == plain_repair(rows)[:2]


def test_blocks_price_the_whole():
    random.seed(7)
    for _ in range(60):
        n = random.randint(2, 14)
        cut = random.randint(1, n - 1)
        initials, faults = "".join(random.choices("suax", k=n)), "".join(random.choices("kkktbd", k=n))
        last = Lattice(initials[cut:], faults[cut:], END, True)
        after = [last.cost(q) for q in range(4)]
        before = exit_prices(block_costs(initials[:cut], faults[:cut]), after)
        whole = Lattice(initials, faults, END, True)
        assert before == [whole.cost(q) for q in range(4)] and NEVER not in before
