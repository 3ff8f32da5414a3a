"""Operator 6: mixing sources to target weights by entropy balancing.

Rates r of the documents minimise the relative entropy sum(size * (r log r - r + 1)) under token constraints
sum(size * r) = target, for each source or for each value of several, overlapping properties. The dual is convex with one
multiplier a constraint, rates are the exponential of their sum, and Newton's iterations take the gradient and curvature
from grouped sums of tokens. Rates are rounded into copies by their running
sum along each source, ordered by size class, so that the tokens taken stay near the target; what is still missing or
too much goes to or comes from small documents. Running sums are two-level: cells of a source, then rows in a cell, with
salted cells, so that no source's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexgrid.plans import materialize

#: No source and no document is taken more than so many times.
MOST = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that a cell of running sums should have, and the fewest salts.
CELL_ROWS, LEAST_SALTS = 100_000, 8
#: Newton's iterations, and the most that one changes a multiplier.
STEPS, SPAN = 60, 2.0


def count_words(text: str) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a column; 0 for null."""
    bare = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.array_remove(F.split(bare, r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources by code point, null last, take the weights in turn. Targets add up to share of all sizes where most allows;
    none exceeds most times its source's size: the excess goes to the others by weight until none is above.
    """
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # a source is capped if the level (target for weight 1) is at or above cap / weight; levels fall into place in that order
    order = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / heavy)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    found = level.withColumn("final", F.min(F.struct(F.when(free.isNotNull(), F.lit(0)).otherwise(F.lit(1)), F.col("cap") / F.col("weight"), F.col("i"), free)).over(every)["col4"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).cast("double").alias("target"))


def balanced_rates(cells: DataFrame, margins: dict[str, DataFrame]) -> DataFrame:
    """cells with rate, by Newton's iterations on the dual of entropy balancing.

    cells has tokens, a bigint, and a column for each name in margins; margins[name] has (name, target): the tokens that
    all cells with that value should give together. Margins may overlap (source, language, length). Values with target 0
    get rate 0; cells in no margin keep rate 1; null is a value of its own. The gradient and the curvature, tokens of
    each value and of each pair of values that meet, are grouped sums; a step is damped to SPAN. Fails where the targets
    can't all be met, or not within STEPS iterations. The driver sees one row a value and one a pair.
    """
    spark = cells.sparkSession
    wanted: list[tuple[str, object, float]] = []
    for name, table in margins.items():
        found = table.where("target is not null").select(name, "target").collect()
        wanted += sorted(((name, r[0], float(r.target)) for r in found), key=lambda x: (x[1] is not None, str(x[1])))
    if not wanted:
        return cells.withColumn("rate", F.lit(1.0))
    keyed = cells.withColumn("_mix_at", F.array().cast("array<int>")).withColumn("_mix_none", F.lit(False))
    for name in margins:
        own = [(v, i, t <= 0) for i, (n, v, t) in enumerate(wanted) if n == name]
        kind = T.StructType([T.StructField("_mix_value", cells.schema[name].dataType), T.StructField("_mix_i", T.IntegerType()), T.StructField("_mix_zero", T.BooleanType())])
        keyed = keyed.join(spark.createDataFrame(own, kind), F.col(name).eqNullSafe(F.col("_mix_value")), "left")
        keyed = keyed.withColumn("_mix_at", F.when(F.col("_mix_i").isNull(), F.col("_mix_at")).otherwise(F.array_append("_mix_at", F.col("_mix_i"))))
        keyed = keyed.withColumn("_mix_none", F.col("_mix_none") | F.coalesce("_mix_zero", F.lit(False))).drop("_mix_value", "_mix_i", "_mix_zero")
    keyed = materialize(keyed, "keyed")
    groups = keyed.where("not _mix_none and tokens > 0 and size(_mix_at) > 0").groupBy("_mix_at").agg(F.sum("tokens").alias("tokens"))
    groups = materialize(groups, "groups")
    target, m = np.array([t for _, _, t in wanted]), np.zeros(len(wanted))
    tilt = lambda m: F.exp(F.aggregate(F.transform("_mix_at", lambda i: F.get(F.lit(m.tolist()), i)), F.lit(0.0), lambda a, x: a + x))
    for _ in range(STEPS):
        # exact sums, so that the order of rows can't change the result
        tilted = groups.select("_mix_at", (F.col("tokens") * tilt(m)).cast("decimal(30,6)").alias("tokens"))
        pairs = tilted.select(F.explode("_mix_at").alias("i"), "_mix_at", "tokens").select("i", F.explode("_mix_at").alias("j"), "tokens")
        sums = sorted((r.i, r.j, float(r.tokens)) for r in pairs.groupBy("i", "j").agg(F.sum("tokens").alias("tokens")).collect())
        if not sums:
            break
        i, j, v = (np.array(x) for x in zip(*sums))
        tokens = np.zeros(len(wanted))
        tokens[i[i == j]] = v[i == j]
        gradient = np.where(tokens > 0, target - tokens, 0.0)
        if (np.abs(gradient) <= 1e-9 * target + 1e-3).all():
            break
        m = m + np.clip(_solve(i, j, v, gradient), -SPAN, SPAN)
    else:
        raise ValueError("the targets can't all be met")
    rate = F.when(F.col("_mix_none"), 0.0).when(F.size("_mix_at") == 0, 1.0).otherwise(tilt(m))
    return keyed.select(*cells.columns, rate.alias("rate"))


def _solve(i: np.ndarray, j: np.ndarray, v: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """The step s with curvature * s = gradient, by conjugate gradients; overlapping margins leave some s free."""
    diagonal = np.ones(len(gradient))
    diagonal[i[i == j]] = v[i == j]
    times = lambda x: np.bincount(i, v * x[j], len(x))
    s, r = np.zeros(len(gradient)), gradient.copy()
    z = r / diagonal
    p, rz = z.copy(), r @ z
    for _ in range(2 * len(gradient)):
        if rz <= 1e-24 * (gradient @ (gradient / diagonal)):
            break
        q = times(p)
        a = rz / (p @ q)
        s, r = s + a * p, r - a * q
        z = r / diagonal
        p, rz = z + (r @ z) / rz * p, r @ z
    return s


def _running(df: DataFrame, value: Column) -> DataFrame:
    """df (source, part, salt, size, key) with before, the sum of value, a bigint, over the source's rows in front."""
    cells = Window.partitionBy("source", "part", "salt")
    rows = cells.orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("value", value)
    inner = valued.withColumn("inner", F.coalesce(F.sum("value").over(rows), F.lit(0)))
    sums = valued.groupBy("source", "part", "salt").agg(F.sum("value").alias("cell"))
    ahead = Window.partitionBy("source").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("source", "part", "salt", F.coalesce(F.sum("cell").over(ahead), F.lit(0)).alias("outer")), "cells")
    same = inner.source.eqNullSafe(sums.source) & (inner.part == sums.part) & (inner.salt == sums.salt)
    return inner.join(sums, same).select(*(inner[c] for c in df.columns), (F.col("outer") + F.col("inner")).alias("before"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, rate, copies): copies is how often the mix takes a row.

    Size is the number of words (null text: 0). Sources, null one too, get targets by source_targets. Rows of size 0 are
    taken once. No row is taken more than most times. The result depends on the rows alone, so reruns agree; rows equal
    in doc_id, source and text share their copies evenly up to one. Other columns are ignored; empty docs give no rows.
    """
    key = F.xxhash64("doc_id", "text")
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", count_words("text").alias("size"), key.alias("key"))
    sized = materialize(sized.withColumn("part", -F.floor(F.log2(F.col("size") + 1) * 2).cast("int")), "sizes")
    counts = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    sums = materialize(sums, "sources")
    targets = materialize(source_targets(sums.select("source", "source_size"), weights, share, most), "targets")
    cells = sums.select("source", F.col("source_size").alias("tokens"))
    rates = balanced_rates(cells, {"source": targets}).select("source", F.least("rate", F.lit(float(most))).alias("rate"))
    rows = sums.agg(F.max("rows")).first()[0] or 0
    salts = max(LEAST_SALTS, -(-rows // CELL_ROWS))
    plan = targets.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    plan = materialize(plan.select(F.col("source").alias("_source"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate")), "rates")
    rated = sized.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")).join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = _running(rated, F.lit(1).cast("long")).withColumn("before", F.col("before") * F.col("rate"))
    at = lambda c: F.floor(c + 0.5 + F.lit(1e-9))
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(int(most)), at(F.col("before") + F.col("rate")) - at(F.col("before"))))
    taken = materialize(laid.withColumn("copies", whole.cast("long")).drop("before"), "copies")
    # second pass: small documents make up for what rounding left, while their running size stays within it
    short = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    short = materialize(short.withColumnRenamed("source", "_source"), "short")
    open_ = (F.col("size") > 0) & (F.col("size") <= F.abs("short")) & F.when(F.col("short") > 0, F.col("copies") < int(most)).otherwise(F.col("copies") > 0)
    again = taken.join(short, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("part", -F.col("part")).withColumn("open", open_)
    moved = _running(again, F.when(F.col("open"), F.col("size")).otherwise(0).cast("long"))
    change = F.when(F.col("open") & (F.col("before") + F.col("size") <= F.abs("short")), F.signum("short")).otherwise(0).cast("long")
    return moved.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", (F.col("copies") + change).alias("copies"))


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; a row that it takes no time is left out.

    Rows equal in doc_id, source and text are taken as often as their mean, rounded up. An empty docs gives no rows.
    Names beginning with _mix must not be in docs.
    """
    per = mix.groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("_mix_all"), F.count(F.lit(1)).alias("_mix_rows"))
    unusual = materialize(per.where("_mix_all != _mix_rows").withColumnsRenamed({"doc_id": "_mix_id", "text_hash": "_mix_text", "source": "_mix_source"}), "unusual")
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.xxhash64("text") == F.col("_mix_text")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    times = F.when(F.col("_mix_all").isNull(), 1).otherwise(F.ceil(F.col("_mix_all") / F.col("_mix_rows")))
    joined = docs.join(unusual, same, "left").withColumn("_mix_times", times.cast("int")).where("_mix_times > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)
