"""Operator 11: removal of passages that repeat word for word, by compressed FM-indexes of shards.

A window is a run of WORDS words. Shards are cut by content: a window belongs to the smallest hash of its runs of GRAM
words (its anchor), so equal windows come to one shard wherever they stand. Consecutive windows of a document with one
anchor travel together as a segment. Anchors that occur once are left behind; equal segments are counted before they
move, and one of them goes on with its count. Each shard builds a compressed FM-index of its segments and streams them
through it: backward search gives the matching statistics, and intervals of WORDS words or more that the shard holds
twice are reported. Windows are judged by 64-bit hashes of their words.

A shard with many different segments of one anchor is cut further by a second anchor (another order of the runs), so a
hot run of words isn't one task. A task builds one index after another, each of some SHARD_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexgrid.llm import tokens
from cortexgrid.llm.fmindex import FmIndex
from cortexgrid.llm.tokens import mix, tidy
from cortexgrid.plans import drop, materialize

#: Words of an anchor's run; windows of a segment at most.
GRAM, MOST_WINDOWS = 12, 29
#: Words of the segments that share an index, and different segments of an anchor beyond which it is cut further.
SHARD_WORDS, HOT_SEGMENTS = 1_000_000, 10_000
#: Fixed factor of the polynomial hash, odd, so that it has an inverse among 64-bit numbers.
_FACTOR = 0xD1342543DE82EF95
_SECOND = np.uint64(0x9FB21C651E98DF25)


class _Runs:
    """Hashes of any run of the given words, from sums of powers."""

    def __init__(self, words: np.ndarray):
        power = np.cumprod(np.full(len(words) + 1, _FACTOR, np.uint64))
        self.back = np.cumprod(np.full(len(words) + 1, pow(_FACTOR, -1, 1 << 64), np.uint64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1])))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size, np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _cut(anchors: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs of equal anchors, MOST_WINDOWS long at most; together: not the first of its document."""
    new = ~together
    new[1:] |= anchors[1:] != anchors[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(anchors)) - np.repeat(first, np.diff(np.append(first, len(anchors))))
    first = np.flatnonzero(place % MOST_WINDOWS == 0)
    return first, np.diff(np.append(first, len(anchors)))


def _segments(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, content, times) of each segment of documents that follow each other.

    times is 2 where a segment may hold a window twice, else 1.
    """
    n_windows = np.maximum(np.diff(bounds) - width + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 6
    gram = min(GRAM, width)
    runs = _Runs(words)
    grams = runs.of(np.arange(len(words) - gram + 1), gram)
    own = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    place = at + bounds[own]
    anchors = _sliding_least(grams, width - gram + 1)[place]
    first, size = _cut(anchors, at > 0)
    near = np.zeros(len(grams) + MOST_WINDOWS, bool)
    for step in range(1, min(MOST_WINDOWS, len(grams))):
        near[: len(grams) - step] |= grams[step:] == grams[:-step]
    seen = np.concatenate(([0], np.cumsum(near)))
    start = place[first]
    twice = seen[start + size] > seen[start]
    return own[first], at[first], size, anchors[first], runs.of(start, size + width - 1), 1 + twice


def _word_hashes(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, words, bounds) of so many texts at once."""
    for held, starts in tokens.chunks(texts):
        data = np.frombuffer(b"\n".join(held), np.uint8)
        words, at, _ = tokens.hash_words(data, tokens._BLANK[data])
        yield len(held), words, np.append(np.searchsorted(at, starts), len(words))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def segment_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, start, windows, anchor, content, times) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, words, bounds in _word_hashes(batch.column(2)):
                own, start, size, anchor, content, times = _segments(words, bounds, width)
                rows = pa.array(own + done)
                done += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(size, pa.int32()),
                     pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(times, pa.int32())],
                    names=["doc_id", "text_hash", "start", "windows", "anchor", "content", "times"],
                )

    return _keyed(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, start int, windows int, anchor long, content long, times int")


def _with_row(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """docs joined with side by (_ss_id, _ss_text); side has one row for each and is hashed, as rows of docs are large."""
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_ss_id")) & (F.xxhash64("text") == F.col("_ss_text"))
    return docs.join(side.hint("shuffle_hash"), same, how)


def _by_row(found: DataFrame, *columns: str) -> DataFrame:
    """One row a document with the set of what was found in it."""
    sets = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*columns)).alias("_ss_found"))
    return sets.withColumnsRenamed({"doc_id": "_ss_id", "text_hash": "_ss_text"})


def segment_words(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(shard, anchor, content, skipped, windows, times, words) of the wanted segments, the hot ones cut by a second anchor.

    skipped is the number of windows of the segment before those of the row; words holds hashes, 8 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = min(GRAM, width)
        for batch in batches:
            offset = 0
            for n, words, bounds in _word_hashes(batch.column(0)):
                out: list[tuple] = []
                for low, found in zip(bounds.tolist(), batch.column(1).slice(offset, n).to_pylist()):
                    for one in found:
                        start, size, anchor = low + one["start"], one["windows"], one["anchor"]
                        cuts = [(anchor, 0, size)]
                        if one["hot"]:
                            part = words[start : start + size + width - 1]
                            other = mix(_Runs(part).of(np.arange(len(part) - gram + 1), gram) ^ _SECOND)
                            least = _sliding_least(other, width - gram + 1)
                            keys = mix(least + np.uint64(anchor % (1 << 64))).view(np.int64)
                            cuts = [(int(keys[i]), i, k) for i, k in zip(*(x.tolist() for x in _cut(least, np.arange(size) > 0)))]
                        for shard, i, k in cuts:
                            out.append((shard, anchor, one["content"], i, k, one["times"], words[start + i : start + i + k + width - 1].tobytes()))
                offset += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["shard", "anchor", "content", "skipped", "windows", "times", "words"]
    both = _with_row(docs.select("doc_id", "text"), _by_row(wanted, "start", "windows", "anchor", "content", "times", "hot"), "inner")
    return both.select("text", "_ss_found").mapInArrow(tidy(run), "shard long, anchor long, content long, skipped int, windows int, times int, words binary")


def _search(rows: pa.Table, width: int) -> pa.RecordBatch:
    """(anchor, content, repeats) of segments that hold a window which the shard has twice; repeats has a bit a window."""
    raw = rows.column("words").combine_chunks()
    sizes = np.array([len(x) for x in raw.to_pylist()], np.int64) // 8
    words = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
    index = FmIndex(words, sizes, rows.column("times").to_numpy(), width + MOST_WINDOWS - 1)
    long = index.matching(words, sizes) >= width
    piece = np.repeat(np.arange(len(sizes)), sizes)[long]
    place = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[long]
    repeats = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(repeats, piece, np.int64(1) << (place + rows.column("skipped").to_numpy()[piece]))
    kept = np.flatnonzero(repeats)
    return pa.RecordBatch.from_arrays([rows.column("anchor").take(kept).combine_chunks(), rows.column("content").take(kept).combine_chunks(), pa.array(repeats[kept])], names=["anchor", "content", "repeats"])


def search_shards(segments: DataFrame, width: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(anchor, content, repeats) of the segments that repeat, by an FM-index for some shard_words words of whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def tables(last: bool) -> Iterator[pa.RecordBatch]:
            """All whole shards held; the last one stays unless it is whole too."""
            rows = pa.Table.from_batches(held)
            shard = rows.column("shard").to_numpy()
            end = len(shard) if last else int(np.searchsorted(shard, shard[-1], "left"))
            held[:] = [] if last else rows.slice(end).to_batches()
            rows, shard = rows.slice(0, end), shard[:end]
            # rows of repeated documents come more than once
            three = [rows.column(name).to_numpy() for name in ("anchor", "content", "skipped")]
            again = np.logical_and.reduce([x[1:] == x[:-1] for x in (shard, *three)])
            rows = rows.take(np.flatnonzero(np.concatenate(([True], ~again)))) if end else rows
            if rows.num_rows:
                yield _search(rows, width)

        for batch in batches:
            held.append(batch)
            size += batch.column(6).nbytes // 8
            if size >= shard_words:
                yield from tables(False)
                size = sum(x.column(6).nbytes // 8 for x in held)
        if held:
            yield from tables(True)

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(parts, "shard").sortWithinPartitions("shard", "anchor", "content", "skipped")
    return dealt.mapInArrow(tidy(run), "anchor long, content long, repeats long")


def repeated_windows(docs: DataFrame, words: int = 35, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, start, repeats): windows start + i of a text, i a bit set in repeats, whose words also start elsewhere.

    Elsewhere is any other place of any row, repeated rows included. text_hash is xxhash64 of the text. Null and short
    texts have no windows.
    """
    if words > 255:
        raise ValueError("at most 255 words")
    segments = materialize(segment_table(docs, words), "segments")
    often = segments.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    found = materialize(segments.join(often, "anchor", "left_semi"), "found")
    drop(segments)
    nulls_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start", "windows")
    distinct = materialize(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(nulls_last).alias("at")), "distinct")
    hot = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_segments).select("anchor", F.lit(True).alias("hot"))
    wanted = distinct.join(hot, "anchor", "left").select(
        "at.doc_id", "at.text_hash", "at.start", "at.windows", "anchor", "content", F.least("n", F.lit(2)).cast("int").alias("times"), F.coalesce("hot", F.lit(False)).alias("hot")
    )
    searched = search_shards(segment_words(docs, wanted, words), words, shard_words)
    repeats = materialize(searched.groupBy("anchor", "content").agg(F.bit_or("repeats").alias("repeats")), "repeats")
    return found.join(repeats, ["anchor", "content"]).select("doc_id", "text_hash", "start", "repeats")


def remove_repeats(docs: DataFrame, words: int = 35, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """docs with text as its kept words joined by one space, and the columns n_words and n_removed (long).

    Words are [^\\x20\\x09-\\x0D]+. Each word goes that is covered by a window of so many words whose sequence also starts
    anywhere else in docs, the same text included; all windows are judged on docs as given, so no occurrence stays.
    Null texts count as empty, and come out empty; texts shorter than a window only have their blanks joined; repeated
    rows stay rows, and repeat each other; a very long text is one row of one task. An empty docs gives no rows. Other
    columns pass through; names beginning with _ss_, n_words and n_removed must be new.
    """
    if taken := [c for c in docs.columns if c.startswith("_ss_") or c in ("n_words", "n_removed")]:
        raise ValueError(f"columns exist: {', '.join(taken)}")
    found = repeated_windows(docs, words, shard_words, hot_segments)
    joined = _with_row(docs, _by_row(found, "start", "repeats"), "left").drop("_ss_id", "_ss_text")
    text, spans, names = joined.columns.index("text"), joined.columns.index("_ss_found"), [*docs.columns, "n_words", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for raw, repeats in zip(batch.column(text), batch.column(spans).to_pylist()):
                given = (raw.as_py() or "").encode().split()
                n_words.append(len(given))
                if repeats:
                    edge = np.zeros(len(given) + 1, np.int64)
                    for x in repeats:
                        starts = x["start"] + np.array([i for i in range(MOST_WINDOWS) if x["repeats"] >> i & 1])
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + words, -1)
                    given = [given[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(given))
                kept.append(b" ".join(given).decode())
            columns = [pa.array(kept) if i == text else c for i, c in enumerate(batch.columns) if i != spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    schema = docs.withColumn("text", F.lit("")).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(tidy(run), schema)


def digest(text: str | Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
