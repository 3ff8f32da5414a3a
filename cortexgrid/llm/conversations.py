"""Operator 13: repair of conversation structure by an auction algorithm for shortest paths.

A conversation's rows and four states (start, after system, after user, after assistant) span a lattice; keeping,
reroling or deleting a row goes to the next row, inserting an empty turn stays in front of it. The auction algorithm
(Bertsekas 1991) keeps a path from the entry and a price for each node: the path's last node raises its price to the best
it is offered and leaves the path, or, at that price, the path goes on to the best offer. Costs are whole numbers, so it
ends with prices for which the shortest paths are just those of tight arcs, and the least string of edits is traced along
these.

Rows of one conversation may lie in many tasks: rows are dealt by ranges of (conversation, turn) and cut into blocks of at
most BLOCK rows. Where a conversation has several blocks, each is first priced from every entry to every exit, a pass
from the last block to the first prices the exits, and each block is then traced from every entry; a pass from the first
block to the last picks the entries. Both passes read a few numbers a block, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexgrid.llm.tokens import tidy
from cortexgrid.plans import materialize

#: Rows of a block at most.
BLOCK = 128
#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A way that doesn't exist.
NEVER = 1 << 40
#: States: start, after system, after user, after assistant. Where a user or assistant turn leads, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: A conversation may end before anything is in it, or after an assistant's turn.
END = (0, NEVER, NEVER, 0)

Arc = tuple[str, int, int]


class Lattice:
    """Nodes 4 * row + state of a block's rows, and the sink; prices hold for any entry."""

    def __init__(self, initials: str, faults: str, exits: Sequence[int], last: bool):
        self.rows, self.sink = len(initials), 4 * len(initials) + 4
        self.initials, self.faults, self.exits, self.last = initials, faults, exits, last
        self.price = [0] * (self.sink + 1)
        self.arcs: list[list[Arc]] = [self._arcs(*divmod(node, 4)) for node in range(self.sink)]

    def _arcs(self, row: int, state: int) -> list[Arc]:
        """(edit, node, cost) in the order of the edits; the end comes first."""
        node = 4 * row
        if row == self.rows:
            out = [("", self.sink, self.exits[state])] if self.exits[state] < NEVER else []
            return out + [("I", node + _NEXT[state], INSERT)] if self.last else out
        fault = self.faults[row]
        out = [("D", node + 4 + state, DELETE), ("I", node + _NEXT[state], INSERT)]
        if fault not in "bd":
            extra = TRUNCATED if fault == "t" else 0
            if (kept := _KEEP.get((state, self.initials[row]))) is not None:
                out.append(("K", node + 4 + kept, extra))
            out.append(("R", node + 4 + _NEXT[state], REROLE + extra))
        return out

    def cost(self, entry: int) -> int:
        """The least cost from an entry state to the sink, which has to be reachable."""
        price, arcs, path = self.price, self.arcs, [entry]
        while path[-1] != self.sink:
            node = path[-1]
            offer, best = NEVER << 1, -1
            for _, to, cost in arcs[node]:
                if cost + price[to] < offer:
                    offer, best = cost + price[to], to
            if price[node] < offer:
                price[node] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
        return price[entry] - price[self.sink]

    def trace(self, entry: int) -> tuple[str, int]:
        """(edits, exit state): the least string of edits along tight arcs, after cost(entry)."""
        price, dead = self.price, set()
        path, edits, tried = [entry], [], [0]
        while path[-1] != self.sink:
            node = path[-1]
            for k in range(tried[-1], len(self.arcs[node])):
                edit, to, cost = self.arcs[node][k]
                if to not in dead and price[node] == cost + price[to]:
                    tried[-1] = k + 1
                    path.append(to)
                    edits.append(edit)
                    tried.append(0)
                    break
            else:
                dead.add(path.pop())
                edits.pop()
                tried.pop()
        return "".join(edits), path[-2] & 3


def block_costs(initials: str, faults: str) -> list[int]:
    """Least costs of a block that others follow, from each entry state to each exit state, 4 * entry + exit."""
    system = any(c == "s" and f not in "bd" for c, f in zip(initials, faults))
    out = [NEVER] * 16
    for leave in range(4):
        lattice = Lattice(initials, faults, [0 if q == leave else NEVER for q in range(4)], False)
        for enter in range(4):
            if leave > 1 or enter == leave or (enter == 0 and leave == 1 and system):
                out[4 * enter + leave] = lattice.cost(enter)
    return out


def exit_prices(costs: Sequence[int], after: Sequence[int]) -> list[int]:
    """What is left to pay at each entry of a block with these costs, if that is so at its exits."""
    return [min(NEVER, *(costs[4 * enter + leave] + after[leave] for leave in range(4))) for enter in range(4)]


# ---- Spark ----

_KEY = "_cr_key"


def _checked(conversations: DataFrame) -> DataFrame:
    taken = [c for c in conversations.columns if c.startswith("_cr_")]
    if taken:
        raise ValueError(f"columns exist: {', '.join(taken)}")
    key = F.when(F.col("conv_id").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return conversations.select(key.alias(_KEY), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32('conv_id:turn') % 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes [.!?], 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20
    given = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), h.alias("_cr_h")).where("_cr_h != 0")
    text = F.when(F.col("_cr_h") == 1, "").when(F.col("_cr_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_cr_h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_cr_h") == 3, 2).otherwise(1)
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_cr_copy")).drop("_cr_copy")


def faulty_rows(conversations: DataFrame) -> DataFrame:
    """(_cr_key, conv_id, place, turn, role, text, fault): place rises along (conversation, turn); fault is b, d, t or k (none)."""
    given = _checked(conversations)
    parts = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart only to deal them evenly
    dealt = given.withColumn("_cr_id", F.monotonically_increasing_id())
    order = [F.col(_KEY), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = dealt.repartitionByRange(parts, *order, "_cr_id").sortWithinPartitions(*order, "_cr_id").drop("_cr_id")
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "placed")  # written, so places stay
    same = [_KEY, "role", F.md5(F.encode("text", "UTF-8")).alias("_cr_md5")]
    first = materialize(placed.groupBy(*same).agg(F.min("place").alias("_cr_first"), F.count(F.lit(1)).alias("_cr_n")).where("_cr_n > 1").select(_KEY, "role", "_cr_md5", "_cr_first"), "first")
    seen = placed.withColumn("_cr_md5", F.md5(F.encode("text", "UTF-8"))).join(first, [_KEY, "role", "_cr_md5"], "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(F.col("place") > F.col("_cr_first"), "d")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("k")
    )
    return seen.select(_KEY, "conv_id", "place", "turn", "role", "text", fault.alias("fault"))


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_BLOCKS = f"{_KEY} string, first long, initials string, faults string"


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, first, initials, faults): rows of one conversation at consecutive places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, initials, faults = None, 0, [], []
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=[_KEY, "first", "initials", "faults"])
            out.clear()
            return made

        for batch in batches:
            for k, place, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key or place != first + len(initials) or len(initials) >= block:
                    if initials:
                        out.append((key, first, "".join(initials), "".join(faults)))
                    key, first, initials, faults = k, place, [], []
                initials.append(initial)
                faults.append(fault)
            if out:
                yield table()
        if initials:
            out.append((key, first, "".join(initials), "".join(faults)))
            yield table()

    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(_KEY, "place", known.alias("initial"), "fault").repartitionByRange(parts, "place").sortWithinPartitions("place")
    return dealt.mapInArrow(tidy(run), _BLOCKS)


def _exits(several: DataFrame, parts: int) -> DataFrame:
    """(key, first, exits, last) of each block of conversations with several."""

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [block_costs(i, f) for i, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(costs, pa.list_(pa.int64()))], names=[_KEY, "first", "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a conversation's last block is priced when it is traced: its exits are the end, its own costs include insertions there
        now, after, last = None, list(END), True
        for batch in batches:
            exits, lasts = [], []
            for key, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    now, after, last = key, list(END), True
                exits.append(after)
                lasts.append(last)
                # insertions before the end
                after = exit_prices(costs, [min(after[q], *(INSERT * n + after[w] for n, w in _inserted(q))) for q in range(4)] if last else after)
                last = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exits, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], names=[_KEY, "first", "exits", "last"])

    priced = several.mapInArrow(tidy(price), f"{_KEY} string, first long, costs array<bigint>")
    dealt = priced.repartition(parts, _KEY).sortWithinPartitions(_KEY, F.desc("first"))
    return dealt.mapInArrow(tidy(back), f"{_KEY} string, first long, exits array<bigint>, last boolean")


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    for n in range(1, 4):
        state = _NEXT[state]
        yield n, state


def _traced(blocks: DataFrame, parts: int) -> DataFrame:
    """(key, first, entry, audit, cost, illegal) of each block, with the entry that its conversation comes by."""

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, costs, leaves = [], [], []
            for initials, faults, exits, last in zip(*(c.to_pylist() for c in batch.columns[2:])):
                lattice = Lattice(initials, faults, exits or END, last is not False)
                each = []
                for enter in range(1 if exits is None else 4):
                    whole = lattice.cost(enter)
                    edits, leave = lattice.trace(enter)
                    each.append((edits, whole - (exits or END)[leave], leave))
                for out, made in zip((audits, costs, leaves), zip(*each)):
                    out.append(list(made))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(audits, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64())), pa.array(leaves, pa.list_(pa.int64()))], names=names)

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entry, before = None, 0, ""
        for batch in batches:
            out = []
            for key, first, initials, audits, costs, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, entry, before = key, 0, ""
                out.append((key, first, entry, audits[entry], costs[entry], _illegal(before + initials)))
                entry, before = leaves[entry], initials[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[_KEY, "first", "entry", "audit", "cost", "illegal"])

    names = [_KEY, "first", "initials", "audits", "costs", "leaves"]
    each = blocks.select(_KEY, "first", "initials", "faults", "exits", "last").mapInArrow(tidy(trace), f"{_KEY} string, first long, initials string, audits array<string>, costs array<bigint>, leaves array<bigint>")
    dealt = each.repartition(parts, _KEY).sortWithinPartitions(_KEY, "first")
    return dealt.mapInArrow(tidy(forth), f"{_KEY} string, first long, entry long, audit string, cost long, illegal long")


def _row_edits(traced: DataFrame) -> DataFrame:
    """(place, edits) for each row: (edit, role) of each of its turns in order; the role of a kept one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, edits = [], []
            for first, entry, audit, initials in zip(*(c.to_pylist() for c in batch.columns)):
                state, row, held = entry, 0, []
                for edit in audit:
                    if edit == "I" or edit == "R":
                        held.append({"edit": edit, "role": _ROLE[state]})
                        state = _NEXT[state]
                    elif edit == "K":
                        held.append({"edit": edit, "role": None})
                        state = _KEEP[state, initials[row]]
                    else:
                        held.append({"edit": edit, "role": None})
                    if edit != "I":
                        places.append(first + row)
                        edits.append(held)
                        row, held = row + 1, []
                if held:  # insertions at the end
                    edits[-1].extend(held)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(edits, pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())])))], names=["place", "edits"])

    return traced.mapInArrow(tidy(run), "place long, edits array<struct<edit string, role string>>")


def repair_conversations(conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of a table of conv_id, turn, role and text.

    report has a row for each conversation that has rows: conv_id, gaps (missing turns), the numbers of blank, duplicate
    and truncated rows (the first fault counts) and of illegal neighbours, the least cost and its least audit. repaired
    has conv_id, place (rising along a conversation), turn, edit, role and text of what is left: kept, reroled and
    inserted turns (empty text, turn of the row beside them). Rows are taken by turn, nulls first, then role and text; a
    null conv_id is a conversation of its own; null roles and texts read as one space; repeated rows are duplicates; very
    long texts stay in rows; an empty table gives no rows. Other columns are left out, their names may be any that
    doesn't begin with _cr_.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(faulty_rows(conversations), "rows")
    blocks = materialize(_blocks(rows, block), "blocks")
    several = blocks.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_KEY)
    exits = _exits(blocks.join(several, _KEY, "left_semi"), parts)
    traced = materialize(_traced(blocks.join(exits, [_KEY, "first"], "left"), parts), "traced")
    edits = _row_edits(traced.join(blocks, [_KEY, "first"]).select("first", "entry", "audit", "initials"))
    turns = rows.join(edits, "place").select(_KEY, "conv_id", "place", "turn", "role", "text", F.posexplode("edits").alias("_cr_at", "_cr_edit")).where("_cr_edit.edit != 'D'")
    inserted = F.col("_cr_edit.edit") == "I"
    repaired = turns.select(
        _KEY, "conv_id", "place", "_cr_at", "turn", F.col("_cr_edit.edit").alias("edit"), F.coalesce("_cr_edit.role", "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text")
    )
    count = lambda f: F.count(F.when(F.col("fault") == f, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = rows.groupBy(_KEY, "conv_id").agg(gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    parts_of = F.array_sort(F.collect_list(F.struct("first", "audit")))
    found = traced.groupBy(_KEY).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts_of, lambda x: x["audit"]), "").alias("audit"))
    report = stats.join(found, _KEY).select(_KEY, "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """(_cr_key, repaired_sha256) of each conversation's 'role:text' lines; texts stream by, none is joined to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], names=[_KEY, "repaired_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(3)):
                raw = line.as_py().encode()
                if key == now:
                    digest.update(b"\n" + raw)
                    continue
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(raw)
            if out:
                yield made()
        if digest:
            out.append((now, digest.hexdigest()))
            yield made()

    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired.select(_KEY, "place", "_cr_at", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(parts, _KEY).sortWithinPartitions(_KEY, "place", "_cr_at").mapInArrow(tidy(run), f"{_KEY} string, repaired_sha256 string")


def conversation_digests(conversations: DataFrame, repair: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conv_id of conversations, with the report on repair and the hash of what it leaves.

    A conversation that has no rows in repair has zeros, an empty audit and the hash of an empty text.
    """
    report, repaired = repair_conversations(repair, block)
    empty = hashlib.sha256(b"").hexdigest()
    every = _checked(conversations).select(_KEY, "conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        every.join(report.drop("conv_id"), _KEY, "left").join(conversation_hashes(repaired), _KEY, "left")
        .select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
    )
