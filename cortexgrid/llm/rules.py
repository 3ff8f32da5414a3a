"""Operator 3: quality rules, learned decision lists. DataFrame functions only.

Features of whole texts are counted per document. Labelled documents are summed into a cube of feature bins by label and
fold, a table whose size depends on the number of features and bins alone. Sequential covering grows and prunes rules on
that cube: a rule is a conjunction of thresholds, grown by accuracy gain on two folds of three, pruned on the third, and
kept if it is precise enough there. The list comes out as one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexgrid.plans import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Features that rules test.
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats")
#: Shares of the rows with label 0 and of those with label 1 that lie below the thresholds tried for a feature.
QUANTILES = {0: [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98], 1: [0.02, 0.05, 0.1, 0.5, 0.9, 0.95, 0.98, 1.0]}
#: The grid of values: v is in bin floor(log2(1 + v * GRID_SCALE) * STEPS_OF_TWO).
GRID_SCALE, STEPS_OF_TWO = 1000.0, 32
#: Bounds of a list, parameters of learn.
MOST_RULES, MOST_CONDITIONS = 8, 3
#: A rule must drop so many of the labelled rows that it covers rightly, on either fold, and cover so many.
PRECISION, COVERED = 0.9, 3


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text has none of them.

    Words are runs of other characters than space and \\t-\\r. n_dup_lines counts \\n-separated lines with a word that
    equal an earlier line; n_repeat_words counts words that lie in a window of WINDOW words found twice or more.
    """
    bare = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(bare, SPACE), "")
    worded = F.filter(F.split(bare, "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))

    def windows(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(some)

    repeats = lambda x: F.when(F.size(x) == F.size(F.array_distinct(x)), F.lit(0)).otherwise(_repeated(x))
    counted = bound(words, lambda w: F.struct(F.size(w).alias("n"), bound(windows(w), repeats).alias("repeats")))
    return (
        docs.withColumn("_counted", counted)
        .withColumn("n_words", F.col("_counted.n").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(bare, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(bare, SYMBOLS, "")).cast("long"))
        .withColumn("n_dup_lines", bound(worded, lambda l: F.size(l) - F.size(F.array_distinct(l))).cast("long"))
        .withColumn("n_repeat_words", F.col("_counted.repeats").cast("long"))
        .drop("_counted")
    )


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Windows are sorted by hash, then place; those with an equal neighbour repeat. Their places in order, each covers
    WINDOW words less the overlap with the one before.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))

    def covered(pairs: Column) -> Column:
        h = lambda k: F.get(pairs, k)["h"]
        shared = F.filter(F.transform(pairs, lambda p, k: F.when((p["h"] == h(k - 1)) | (p["h"] == h(k + 1)), p["i"])), lambda i: i.isNotNull())
        return F.aggregate(F.sort_array(shared), start, step, lambda a: a["n"])

    return bound(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def bound(value: Column, then) -> Column:
    """then(value), with value computed once: a lambda's own argument isn't computed again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


def ratios() -> dict[str, Column]:
    """Features that rules test: lengths and shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / n,
        "f_symbols": F.col("n_symbols") / n,
        "f_dup_lines": F.col("n_dup_lines") / n,
        "f_repeats": F.col("n_repeat_words") / n,
    }


def _cuts(rows: DataFrame, label: str, features: Sequence[str]) -> dict[str, list[float]]:
    """Thresholds of each feature: bin ends at quantiles of its rows of either label.

    Values are counted by bins of a fixed grid (STEPS_OF_TWO to a doubling), so the counts, and with them the cuts, are
    exact whatever way rows are dealt, and only the grid's bins reach the driver.
    """
    grid = lambda f: F.floor(F.log2(1 + F.greatest(F.col(f), F.lit(0.0)) * GRID_SCALE) * STEPS_OF_TWO).cast("int")
    long = rows.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), grid(f).alias("bin")) for f in features))).alias("p"))
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in long.groupBy("p.f", "y", "p.bin").agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault((r.f, r.y), []).append((r.bin, r.n))
    out = {}
    for f in features:
        ends = set()
        for y, shares in QUANTILES.items():
            bins = sorted(found.get((f, y), []))
            total, upto = sum(n for _, n in bins), 0
            wanted = [q * total for q in shares]
            for b, n in bins:
                upto += n
                while wanted and upto >= wanted[0]:
                    ends.add((2.0 ** ((b + 1) / STEPS_OF_TWO) - 1) / GRID_SCALE)
                    wanted.pop(0)
        out[f] = sorted(ends)
    return out


def learn(labelled: DataFrame, label: str, key: str = "doc_id", features: Sequence[str] = FEATURES, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[tuple[Condition, ...]]:
    """An ordered list of at most most_rules conjunctions, of at most most_conditions thresholds, that cover rows with label 0.

    All labelled rows count. labelled has the features and label (0 or 1; others are ignored). The list is empty without
    enough labelled rows. Each step is a grouped sum over the cube: the driver sees counts by feature and bin alone.
    """
    rows = labelled.where(F.col(label).isin(0, 1))
    cuts = _cuts(rows, label, features)
    cells = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in features}
    fold = (F.pmod(F.xxhash64(key), F.lit(3)) == 0).cast("int")
    cube = rows.groupBy(*(cells[f].cast("int").alias(f) for f in features), fold.alias("fold"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    cube = materialize(cube, "cube")

    def holds(rule) -> Column:
        out = F.lit(True)
        for f, above, i in rule:
            out = out & (F.col(f) > i if above else F.col(f) <= i)
        return out

    def sums(rest: DataFrame, rule) -> tuple[dict, dict]:
        """Counts of (fold, label) that the rule covers, and of those by the bin of each feature."""
        long = rest.where(holds(rule)).select("fold", "label", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in features))).alias("p"))
        by: dict = {}
        for r in long.groupBy("fold", "label", "p.f", "p.bin").agg(F.sum("n").alias("n")).collect():
            by.setdefault((r.f, r.fold, r.label), {})[r.bin] = r.n
        whole = {(g, y): sum(by.get((features[0], g, y), {}).values()) for g in (0, 1) for y in (0, 1)}
        return whole, by

    rules, rest = [], cube
    while len(rules) < most_rules:
        rule: tuple = ()
        whole, by = sums(rest, rule)
        lengths = [whole]
        while len(rule) < most_conditions and whole[0, 0] and whole[0, 1]:
            p0, n0 = whole[0, 0], whole[0, 1]
            best = None
            for f in features:
                for i in range(len(cuts[f])):
                    for above in (True, False):
                        p, n = (sum(m for b, m in by.get((f, 0, y), {}).items() if (b > i) == above) for y in (0, 1))
                        if p:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if best is None or (gain, p) > best[0]:
                                best = (gain, p), (f, above, i)
            if best is None or best[0][0] <= 0:
                break
            rule = (*rule, best[1])
            whole, by = sums(rest, rule)
            lengths.append(whole)
        # prune: the shortest beginning that is best on the fold kept apart
        scored = [((w[1, 0] - w[1, 1]) / (w[1, 0] + w[1, 1]) if w[1, 0] + w[1, 1] else -1.0, -length) for length, w in enumerate(lengths) if length]
        if not scored:
            break
        length = -max(scored)[1]
        rule, w = rule[:length], lengths[length]
        p, n = w[0, 0] + w[1, 0], w[0, 1] + w[1, 1]
        if p < COVERED or p < PRECISION * (p + n) or w[1, 0] < PRECISION * (w[1, 0] + w[1, 1]):
            break
        rules.append(rule)
        rest = rest.where(~holds(rule))
    return [tuple(Condition(f, above, float(cuts[f][i])) for f, above, i in rule) for rule in rules]


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """True unless a rule of the list covers the row; the first that does decides."""
    out = None
    for rule in rules:
        test = rule[0].holds()
        for condition in rule[1:]:
            test &= condition.holds()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs.

    The list is learned from the labels of all labelled documents. A null text has no words and fails the base rules;
    without labels only these decide. Of contradictory labels of one document the largest counts. A null doc_id has no label. Repeated rows get equal verdicts. Other columns are
    ignored; empty docs give no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = materialize(with_features(given).drop("text").withColumn("base_failed", base_failed()), "features")
    rated = counted.withColumns(ratios())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("_label")).where("doc_id is not null").groupBy("doc_id").agg(F.max("_label").alias("_label"))
    rules = learn(rated.where(~F.col("base_failed")).join(known, "doc_id"), "_label")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rated.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select(*names, "kept")
