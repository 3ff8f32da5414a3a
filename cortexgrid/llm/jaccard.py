"""Operator 10: n-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set holds the hashes of its word shingles. Sets are put in size bands such that similar sets lie in the
same or in adjacent bands; a set is indexed at its own band's level and at the next one. At a level, similar sets differ
in at most H tokens. The token universe is hashed into m = H + 1 + slack segments, and each segment has a weight:
1 (its subset is a key), 2 (also its one-deletion neighbourhood) or 0 (left out). Two sets without a common key differ
by at least the weight in each segment, so with weights adding up to H + 1 or more no similar pair is missed.

Weights follow a cost model: tug-of-war sketches, summed over all documents, estimate each segment's colliding pairs;
segments with so many that one-deletion keys elsewhere cost less get 0 and as many of the quietest get 2. The slack
pays for segments that are empty in a set, which make no keys; a set with too many of them (rare) keeps those keys too.

Keys lead to candidates. Their odd sketches (the parity of tokens in each of ODD_BITS cells) differ in no more bits than
the sets do in tokens, which rules most false ones out within the join, and the rest is verified exactly on whole sets. Components need no all-pairs output: first every
set of a key is held against the key's smallest one; then, only within keys that still join different components, the
pairs across components. Every similar pair is either verified or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.llm.tokens import mix, shingle_sets, tidy
from cortexgrid.operators.components import components_of_edges
from cortexgrid.plans import drop, materialize

#: Sketch counters for each segment, and rows that a one-deletion neighbourhood costs against one colliding pair.
COUNTERS = 4
ROW_COST = 8
#: Bits of an odd sketch, a multiple of 64.
ODD_BITS = 512
#: Key rows in one Arrow batch.
BATCH = 200_000


@lru_cache(maxsize=4)
def _bands(percent: int, up_to: int = 1 << 40) -> tuple[int, ...]:
    """Smallest set size of each band."""
    out = [1]
    while out[-1] < up_to:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return tuple(out)


@lru_cache(maxsize=4096)
def _level(percent: int, level: int) -> tuple[int, int]:
    """(H, m): the most tokens that similar sets of bands level-1 and level differ in, and the number of segments."""
    bands = _bands(percent)
    largest, least = bands[level + 1] - 1, bands[max(0, level - 1)]
    h = 2 * largest * (100 - percent) // (100 + percent)
    slack = 0
    for _ in range(4):
        m = h + 1 + slack
        empty = m * math.exp(-least / m) if h else 0.0
        slack = min(h, math.ceil(empty + 2 * math.sqrt(empty)))
    return h, h + 1 + slack


def _levels(percent: int, size: int) -> tuple[int, int]:
    band = int(np.searchsorted(_bands(percent), size, "right")) - 1
    return band, band + 1


def _segments(tokens: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, token counts and key sums of the segments with tokens; then each token's segment and value."""
    values = np.sort(mix(tokens + np.uint64(level)))
    # in proportion to the value, so that sorted values have sorted segments
    segment = (((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return segment[first], np.diff(np.append(first, len(segment))), np.add.reduceat(values, first), segment, values


def _keys(level: int, segment: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return mix(sums + mix(segment.astype(np.uint64) + np.uint64(level << 32)))


def _keys_of(tokens: np.ndarray, percent: int, level: int, weights: dict[int, dict[int, int]]) -> np.ndarray:
    """All index keys of one set at one level."""
    h, m = _level(percent, level)
    number, count, sums, segment, values = _segments(tokens, level, m)
    changed = weights.get(level, {})
    if not changed and len(number) >= h + 1:
        return _keys(level, number, sums)
    v = np.ones(m, np.int64)
    for s, weight in changed.items():
        v[s] = weight
    deleted = (v[segment] == 2) & np.repeat(count >= 2, count)
    out = [_keys(level, number[v[number] > 0], sums[v[number] > 0])]
    whole = np.repeat(sums, count)
    out.append(_keys(level, segment[deleted], whole[deleted] - values[deleted]))
    if np.minimum(v[number], np.where(count >= 2, 2, 1)).sum() < h + 1:
        empty = np.setdiff1d(np.flatnonzero(v > 0), number)
        single = number[(v[number] == 2) & (count == 1)]
        bare = np.concatenate((empty, single))
        out.append(_keys(level, bare, np.zeros(len(bare), np.uint64)))
    return np.unique(np.concatenate(out))


def _odd(tokens: np.ndarray) -> list[int]:
    cells = (tokens >> np.uint64(20)) % np.uint64(ODD_BITS)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=ODD_BITS) & 1).view(np.int64).tolist()


def document_sets(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, set_hash, odd (both null without words); sketch rows.

    Sketch rows (level and segment not null) hold one task's counters for the cost model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: dict[int, np.ndarray] = {}
        docs_at: dict[int, int] = {}
        names = ["doc_id", "text_hash", "n_shingles", "set_hash", "odd", "level", "segment", "counters", "at_level"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        for batch in batches:
            sizes, digests, odd = [], [], []
            for tokens in shingle_sets(batch.column(2), words):
                sizes.append(len(tokens))
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                odd.append(_odd(tokens) if len(tokens) else None)
                if not len(tokens):
                    continue
                for level in _levels(percent, len(tokens)):
                    h, m = _level(percent, level)
                    if not h:
                        continue
                    number, _, sums, _, _ = _segments(tokens, level, m)
                    if level not in sketch:
                        sketch[level] = np.zeros((m, COUNTERS), np.int64)
                    keys = _keys(level, number, sums)
                    sketch[level][number] += 1 - 2 * ((keys[:, None] >> np.arange(COUNTERS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
                    docs_at[level] = docs_at.get(level, 0) + 1
            none = [None] * len(sizes)
            yield rows(batch.column(0), batch.column(1), sizes, digests, odd, none, none, none, none)
        for level, counters in sketch.items():
            used = np.flatnonzero(counters.any(axis=1))
            none = [None] * len(used)
            if len(used):
                yield rows(none, none, none, none, none, np.full(len(used), level), used, counters[used].tolist(), np.full(len(used), docs_at[level]))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(tidy(run), "doc_id long, text_hash long, n_shingles long, set_hash binary, odd array<long>, level int, segment int, counters array<long>, at_level long")


def segment_weights(sketches: DataFrame) -> dict[int, dict[int, int]]:
    """Level -> segment -> weight, only where it isn't 1. The number of segments depends on the longest text alone."""
    total = sketches.groupBy("level", "segment").agg(F.sum("at_level").alias("n"), *(F.sum(F.col("counters")[i]).alias(f"c{i}") for i in range(COUNTERS)))
    pairs = sum((F.col(f"c{i}").cast("double") * F.col(f"c{i}") for i in range(COUNTERS)), F.lit(0.0)) / COUNTERS
    cost = total.select("level", "segment", "n", pairs.alias("pairs"))
    usual = cost.groupBy("level").agg(F.expr("percentile(pairs, 0.5)").alias("usual"), F.max("n").alias("docs"))
    hot = cost.join(usual, "level").where(F.col("pairs") > 4 * F.col("usual") + ROW_COST * F.col("docs"))
    by_level: dict[int, list[int]] = {}
    for r in hot.select("level", "segment").collect():
        by_level.setdefault(r.level, []).append(r.segment)
    if not by_level:
        return {}
    quiet = cost.where(F.col("level").isin(list(by_level))).withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("pairs", "segment")))
    counts = {level: len(s) for level, s in by_level.items()}
    weights = {level: dict.fromkeys(s, 0) for level, s in by_level.items()}
    for r in quiet.where("rank <= 4096").collect():
        if r.segment not in weights[r.level] and counts[r.level] > 0:
            weights[r.level][r.segment] = 2
            counts[r.level] -= 1
    # no more segments may lose their weight than others gain
    return {level: w for level, w in weights.items() if counts[level] == 0}


def index_keys(docs: DataFrame, weights: dict[int, dict[int, int]], words: int = 4, percent: int = 85) -> DataFrame:
    """(key, doc_id) of each document's set at its two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "doc_id"])
        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                if doc_id is None or not len(tokens):
                    continue
                for level in _levels(percent, len(tokens)):
                    found = _keys_of(tokens, percent, level, weights)
                    keys.append(found)
                    ids.append(np.full(len(found), doc_id, np.int64))
                    held += len(found)
                if held >= BATCH:
                    yield flush()
                    ids, keys, held = [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "key long, doc_id long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """False only for pairs whose sets differ in more tokens than similar ones can; columns are named odd_a, n_a and so on."""
    bits = sum((F.bit_count(F.col(f"odd_{a}")[i].bitwiseXOR(F.col(f"odd_{b}")[i])) for i in range(ODD_BITS // 64)), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (100 - percent)


def _sketched(df: DataFrame, sketches: DataFrame, side: str, on: str) -> DataFrame:
    return df.join(sketches.select(F.col("doc_id").alias(on), F.col("n_shingles").alias(f"n_{side}"), F.col("odd").alias(f"odd_{side}")), on)


def verify_pairs(pairs: DataFrame, docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """The pairs (a, b) whose documents' whole sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            last = None
            for ta, b in zip(batch.column(2), shingle_sets(batch.column(3), words)):
                if ta != last:  # pairs come sorted by their first end
                    last, a = ta, next(shingle_sets([ta], words))
                common = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id.

    Words are separated by space and \\t-\\r, A-Z lower-cased. A set holds the distinct shingles of so many words; a
    shorter text is one shingle; without words or text the set is empty, links with nothing, and component_id is the
    row's own doc_id. component_id is the smallest doc_id reachable by links. Rows that repeat a doc_id are one node of
    the graph and stay rows of their own; rows with a null doc_id have no links and a null component_id, but for copies
    of a document with an id. Other columns of docs are ignored. An empty docs gives no rows.
    """
    found = materialize(document_sets(docs, words, percent), "sets")
    sets = found.where("level is null").select("doc_id", "text_hash", "n_shingles", "set_hash", "odd")
    weights = segment_weights(found.where("level is not null"))
    named = sets.where("set_hash is not null and doc_id is not null")
    one = named.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("rows"))
    groups = materialize(one.select("set_hash", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("rep_text"), "rows"), "groups")
    copies = named.join(groups.where("rows > 1"), "set_hash").where("doc_id != rep or text_hash != rep_text")
    copies = materialize(copies.select("doc_id", "text_hash"), "copies")
    single = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(copies, ["doc_id", "text_hash"], "left_anti")
    by_key = Window.partitionBy("key").orderBy("doc_id")
    near = index_keys(single, weights, words, percent).select(
        "key", "doc_id", F.first("doc_id").over(by_key).alias("leader"), F.lead("doc_id").over(by_key).alias("after")
    )
    # a key of one set has its leader as only row
    shared = materialize(near.where("doc_id != leader or after is not null").select("key", "doc_id", "leader"), "shared")
    members = shared.select("doc_id").distinct()
    sketches = materialize(named.join(members, "doc_id", "left_semi").select("doc_id", "n_shingles", F.col("odd")).distinct(), "sketches")
    met = shared.where("doc_id != leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = materialize(_sketched(_sketched(met, sketches, "a", "a"), sketches, "b", "b").where(_may_link("a", "b", percent)).select("a", "b").distinct(), "star")
    linked = materialize(verify_pairs(star, docs, words, percent), "linked")
    part = materialize(components_of_edges(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))), "part")
    placed = shared.join(part.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    open_keys = placed.join(mixed, "key", "left_semi").join(sketches, "doc_id")
    open_keys = materialize(open_keys, "open")
    x, y = (open_keys.select("key", F.col("doc_id").alias(i), F.col("component").alias(f"c{i}"), F.col("n_shingles").alias(f"n_{i}"), F.col("odd").alias(f"odd_{i}")) for i in "ab")
    across = x.join(y, "key").where("a < b and ca != cb").where(_may_link("a", "b", percent)).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    more = materialize(verify_pairs(materialize(across, "across"), docs, words, percent), "more")
    edges = linked.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    whole = materialize(components_of_edges(edges), "whole")
    drop(copies, shared, sketches, star, linked, part, open_keys, more)
    by_set = groups.join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    return sets.join(by_set, "set_hash", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id.

    Documents without words all stay, and rows with a null doc_id that are no copies. Of rows that repeat a doc_id one
    stays. An empty docs gives no rows. Names beginning with _jac must not be in docs.
    """
    groups = materialize(jaccard_groups(docs, words, percent), "groups")
    gone = materialize(groups.where("doc_id != component_id or doc_id is null and component_id is not null").select(F.col("doc_id").alias("_jac_gone"), F.col("text_hash").alias("_jac_text")).distinct(), "gone")
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_jac_gone")) & (F.xxhash64("text") == F.col("_jac_text")), "left_anti")
    repeats = groups.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeats.isEmpty():
        empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
        plain = empty | F.col("doc_id").isNull()
        kept = kept.where(plain).unionByName(kept.where(~plain).dropDuplicates(["doc_id"]))
    return kept
