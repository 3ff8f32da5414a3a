"""Operator 8: k-d tree partitioning of documents into shards of nearly equal bytes.

A node splits along its widest metadata dimension at a weighted median: the point that shares its bytes out in
proportion to the leaves on each side. All nodes of a level are split together. A split point is found by histograms:
one grouped sum of bytes over BINS bins a node, narrowed around the target until the bin there holds at most SHARE of a
leaf, or one row. The driver sees no rows, only
a node's range and bins, whose number depends on the shard count alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.operators.graph import dense_ids
from cortexgrid.plans import materialize

#: Bins of a histogram, and the part of a leaf's bytes that the bin of a split point may hold.
BINS, SHARE = 256, 1e-3
#: Most times that a histogram is narrowed; BINS ** ROUNDS is the resolution of a double, so equal rows end it.
ROUNDS = 6
#: Rows that a cell of slot numbers should have, and the fewest cells of a shard.
CELL_ROWS, LEAST_SALTS = 100_000, 8


def with_ranks(df: DataFrame, names: list[str]) -> DataFrame:
    """df with each string column replaced by its rank among the distinct values, from 1; null is 0."""
    for name in names:
        ranks = dense_ids(df.where(F.col(name).isNotNull()).select(name)).withColumnRenamed(name, "_kd_value")
        df = df.join(ranks, F.col(name) == F.col("_kd_value"), "left").withColumn(name, F.coalesce("_id", F.lit(0))).drop("_kd_value", "_id")
    return df


def kd_shards(df: DataFrame, size: str, dimensions: Mapping[str, Column], shards: int, key: Column) -> DataFrame:
    """df with shard, 0 to shards - 1.

    dimensions are numeric columns, no nulls; each is scaled by its range over df, and equal values are told apart by key, a
    bigint that should differ between rows. Rows equal in all of these go to the same shard. An empty df gives no rows.
    Names beginning with _kd are used inside.
    """
    names = [f"_kd{i}" for i in range(len(dimensions) + 1)]
    spread = (F.pmod(key, F.lit(1 << 40)) / float(1 << 40)).cast("double")
    raw = df.withColumns({f"_kd{i}": c.cast("double") for i, c in enumerate(dimensions.values())} | {names[-1]: spread})
    raw = materialize(raw.withColumn("_kdw", F.col(size).cast("double")), "dimensions")
    span = raw.agg(*(F.min(c).alias(f"low{c}") for c in names), *(F.max(c).alias(f"high{c}") for c in names)).first()
    rows = raw
    for c in names[:-1]:
        low, high = span[f"low{c}"], span[f"high{c}"]
        width = (high - low) if low is not None and high > low else 1.0
        # equal values stay next to each other, in the order of the key
        rows = rows.withColumn(c, (F.col(c) - F.lit(low or 0.0)) / F.lit(width) + F.col(names[-1]) * F.lit(1e-6))
    rows = rows.withColumn("_kdn", F.struct(F.lit(0).alias("first"), F.lit(shards).alias("leaves")))
    leaves = {0: shards}
    points: dict[int, list[tuple[int, float]]] = {}
    while any(n > 1 for n in leaves.values()):
        wide = [k for k, n in leaves.items() if n > 1]
        open_rows = rows.where(F.col("_kdn.leaves") > 1)
        ranges = {r.node: r for r in open_rows.groupBy(F.col("_kdn.first").alias("node")).agg(F.sum("_kdw").alias("bytes"), *(F.min(c).alias(f"low{c}") for c in names), *(F.max(c).alias(f"high{c}") for c in names)).collect()}
        state: dict[int, dict] = {}
        for k in wide:
            if (r := ranges.get(k)) is None:
                continue
            # rounded, as the key adds up to 1e-6 to equal widths: of these the first dimension wins
            best = max(range(len(names) - 1), key=lambda i: round(r[f"high_kd{i}"] - r[f"low_kd{i}"], 5)) if len(names) > 1 else 0
            left = leaves[k] // 2
            state[k] = {"dim": best, "low": r[f"low_kd{best}"], "high": r[f"high_kd{best}"], "want": r.bytes * left / leaves[k], "left": left, "leaf": r.bytes / leaves[k]}
        narrowing = dict(state)
        for _ in range(ROUNDS):
            if not narrowing:
                break
            picked = _by_node({k: [float(s["dim"]), s["low"], max(s["high"] - s["low"], 1e-300)] for k, s in narrowing.items()})
            value = F.element_at(F.array(*names), F.get(picked, F.lit(0)).cast("int") + 1)
            bin_ = F.floor((value - F.get(picked, F.lit(1))) / F.get(picked, F.lit(2)) * BINS)
            inside = open_rows.where((bin_ >= 0) & (bin_ <= BINS)).groupBy(F.col("_kdn.first").alias("node"), F.least(bin_, F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("_kdw").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            bins: dict[int, dict[int, float]] = {}
            single = set()
            for r in inside.collect():  # at most BINS rows a node
                bins.setdefault(r.node, {})[r.bin] = r.bytes
                if r.rows == 1:
                    single.add((r.node, r.bin))
            for k, s in narrowing.items():
                step = (s["high"] - s["low"]) / BINS
                gone = 0.0
                for b in sorted(bins.get(k, {})):
                    if gone + bins[k][b] >= s["want"]:
                        break
                    gone += bins[k][b]
                else:
                    b = BINS - 1
                s["near"] = gone + bins.get(k, {}).get(b, 0.0) - s["want"] < s["want"] - gone
                s["want"] -= gone
                s["low"], s["high"] = s["low"] + b * step, s["low"] + (b + 1) * step
                s["done"] = (k, b) in single or bins.get(k, {}).get(b, 0.0) <= SHARE * s["leaf"]
            narrowing = {k: s for k, s in narrowing.items() if not s["done"]}
        cut = _by_node({k: [float(s["dim"]), s["high"] if s["near"] else s["low"], float(s["left"])] for k, s in state.items()})
        value = F.element_at(F.array(*names), F.get(cut, F.lit(0)).cast("int") + 1)
        below, left = value < F.get(cut, F.lit(1)), F.get(cut, F.lit(2)).cast("int")
        first, n = F.col("_kdn.first"), F.col("_kdn.leaves")
        node = F.struct(F.when(below, first).otherwise(first + left).alias("first"), F.when(below, left).otherwise(n - left).alias("leaves"))
        rows = rows.withColumn("_kdn", F.when((n > 1) & cut.isNotNull(), node).otherwise(F.struct(first.alias("first"), F.when(cut.isNull(), F.lit(1)).otherwise(n).alias("leaves"))))
        rows = materialize(rows, "level")
        grown = {}
        for k, n_leaves in leaves.items():
            if n_leaves == 1 or k not in state:
                grown[k] = 1
            else:
                left_leaves = n_leaves // 2
                grown[k], grown[k + left_leaves] = left_leaves, n_leaves - left_leaves
        leaves = grown
    return rows.withColumn("shard", F.col("_kdn.first")).drop("_kdn", "_kdw", *names)


def _by_node(values: dict[int, list[float]]) -> Column:
    """Numbers by node; null for other nodes."""
    if not values:
        return F.lit(None).cast("array<double>")
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*pairs), F.col("_kdn.first"))


#: Copies of one row that a task numbers.
COPIES = 10_000


def with_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df with slot, 0, 1, ... within each shard; salted cells are numbered first, then offset, so no shard is one task."""
    salts = max(LEAST_SALTS, -(-rows // CELL_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset")), "offsets")
    number = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy(*order)) - 1
    return salted.withColumn("_number", number).join(offsets, ["shard", "_salt"]).withColumn("slot", (F.col("_offset") + F.col("_number")).cast("long")).drop("_salt", "_number", "_offset")


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) by language, source, length and doc_id.

    Size is the UTF-8 bytes of the text, null none, plus 8; text_crc32 of a null text is that of the empty one. The law
    is bytes: shards have nearly equal sizes. Nulls in any dimension are a value below all others. Rows that repeat a
    doc_id and text are dealt out like others, told apart by a number. The result doesn't depend on how the rows of docs
    lie in files or partitions. Other columns are ignored; empty docs give no rows.
    """
    binary = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(binary) + 8).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
        "lang", "source", F.xxhash64("doc_id", "text", "lang", "source").alias("row_hash"),
    )
    # equal rows differ by a number only, so a row's key doesn't depend on where it was read
    equal = given.groupBy(*given.columns).agg(F.count(F.lit(1)).alias("_copies"))
    dealt = equal.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}")))).repartition("row_hash", "_part")
    copy = F.explode(F.sequence(F.col("_part") * COPIES, F.least((F.col("_part") + 1) * COPIES, F.col("_copies")) - 1))
    meta = dealt.withColumn("_copy", copy).withColumn("key", F.xxhash64("row_hash", "_copy")).drop("_copies", "_part", "_copy", "row_hash")
    meta = with_ranks(materialize(meta, "meta"), ["lang", "source"])
    dims = {"lang": F.col("lang"), "source": F.col("source"), "length": F.log2(F.col("size")), "id": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("double")}
    placed = kd_shards(meta, "size", dims, shards, F.col("key"))
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    out = with_slots(placed, ["doc_id", "key"], most)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
