"""Operator 12: alignment of two tokenizers' tokens over the bytes of each document.

The bytes are a space and the text. Offsets where a token of both ends cut the tokens into groups. What a byte range of a
document knows is a fragment: a list of groups of which the first (open prefix) and the last (open suffix) may go on in
its neighbours, and those between are closed. Two neighbouring fragments compose by joining the left one's last group
with the right one's first; that is associative, and one empty group is its neutral element. Texts of CHUNK_BYTES or more
are cut into byte ranges, each encoded in a task of its own (with the bytes around it up to the next sure boundaries),
and their fragments are composed as a tree, FAN at a time, by shuffles on the document and the range's number.

Sure boundaries, in front of a single space that follows something else than white space, are token ends of both
tokenizers whatever stands around them. What stands between two, a unit, is encoded and cut into groups once for a table
of units that each task keeps; a document composes the fragments of its units.

Memory: a task holds CHUNK_BYTES of text per document, a table of UNITS_KEPT units, and the pair counts it looks up if
there are at most PAIRS_SENT; more of them are joined by Spark instead.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexgrid.llm.bpe import WORD_PATTERN, Vocabulary
from cortexgrid.llm.tokens import tidy
from cortexgrid.plans import materialize

#: Bytes from which a document is cut into ranges, and fragments composed at once.
CHUNK_BYTES, FAN = 1 << 14, 4
#: Units that a worker keeps; emptied when full. Longer units aren't kept.
UNITS_KEPT, LONG_UNIT = 150_000, 256
#: Texts whose new units are encoded at once.
TEXTS_AT_ONCE = 256
#: Links of a group beyond which its distinct pairs are counted without listing each link.
BIG_GROUP = 1 << 14
#: Pair counts that are broadcast at most (17 bytes each); beyond, they are joined.
PAIRS_SENT = 2_000_000

#: The white space of the byte-level vocabulary's word pattern, and the sign that pieces have for a space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_SIGN = "\u2581"
_UNIT = re.compile(f" [^ ]*(?:(?<=[{WHITE}]) [^ ]*)*")

Arrays = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pair_type(pairs: int) -> type:
    """What holds the numbers of so many pairs."""
    return np.uint32 if pairs <= 1 << 32 else np.int64


class Sides:
    """Both tokenizers of a worker: ids and bytes of their tokens."""

    def __init__(self, bytes_json: str, pieces_model: str):
        import sentencepiece
        import tiktoken

        with open(bytes_json, encoding="utf-8") as f:
            spec = json.load(f)
        ids = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError(f"{bytes_json} isn't a byte-level vocabulary with ids in the order of its merges")
        vocabulary = Vocabulary(bytes_json)
        ranks = {vocabulary.token[i]: i for i in vocabulary.plain}
        self.bytes_a = vocabulary.token
        self.encode_a = tiktoken.Encoding("bytes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
        space = pieces.piece_to_id(SPACE_SIGN)
        # an empty text has no tokens, but a last space is one
        self.encode_b = lambda texts: [ids or [space] for ids in pieces.encode(texts, num_threads=1)]
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.bytes_b = [bytes((int(name[3:5], 16),)) if pieces.is_byte(i) else name.replace(SPACE_SIGN, " ").encode() for i, name in enumerate(names)]
        if any(SPACE_SIGN in name.lstrip(SPACE_SIGN) for name in names):
            raise ValueError(f"{pieces_model} has pieces that go on beyond a space")
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids in decimal digits, each with the sign that follows it
        self.signs_a = [b"%d%s" % (i, s) for i in range(len(self.bytes_a)) for s in (b",", b"|")]
        self.signs_b = [b"%d%s" % (i, s) for i in range(len(self.bytes_b)) for s in (b",", b";")]
        self.pair_type = pair_type(len(self.bytes_a) * len(self.bytes_b))
        self.units: dict[str, tuple] = {}

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each unit (a space and what follows it)."""
        return list(map(self.encode_a, units)), self.encode_b([u[1:] for u in units])


_loaded: dict[tuple[str, str], Sides] = {}


def _sides(bytes_json: str, pieces_model: str) -> Sides:
    if (bytes_json, pieces_model) not in _loaded:
        _loaded[bytes_json, pieces_model] = Sides(bytes_json, pieces_model)
    return _loaded[bytes_json, pieces_model]


# ---- fragments: (ids of A, ids of B, A tokens of each group, B tokens of each group) ----

EMPTY: Arrays = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32))


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Arrays:
    """The fragment of tokens of a byte range, by the offsets where they end (rising)."""
    cuts = ends_b[np.isin(ends_b, ends_a, assume_unique=False)]
    sizes = [np.diff(np.concatenate(([0], np.searchsorted(ends, cuts, "right"), [len(ends)]))) for ends in (ends_a, ends_b)]
    return a.astype(np.int32), b.astype(np.int32), sizes[0].astype(np.int32), sizes[1].astype(np.int32)


def compose(left: Arrays, right: Arrays) -> Arrays:
    """The fragment of two neighbouring byte ranges."""
    sizes = [np.concatenate((x[:-1], [x[-1] + y[0]], y[1:])).astype(np.int32) for x, y in zip(left[2:], right[2:])]
    return np.concatenate((left[0], right[0])), np.concatenate((left[1], right[1])), *sizes


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): every A-B pair of a group, as id of A times n_b plus id of B, and how often; pairs may come again."""
    many = of_a.astype(np.int64) * of_b
    start_a, start_b = _starts(of_a), _starts(of_b)
    small = np.flatnonzero((many > 0) & (many <= BIG_GROUP))
    n = many[small]
    group = np.repeat(small, n)
    place = np.arange(n.sum()) - np.repeat(_starts(n), n)
    pairs = [a[start_a[group] + place // of_b[group]].astype(np.int64) * n_b + b[start_b[group] + place % of_b[group]]]
    times = [np.ones(len(pairs[0]), np.int64)]
    for g in np.flatnonzero(many > BIG_GROUP).tolist():
        (x, often_x), (y, often_y) = (np.unique(ids[s[g] : s[g] + k[g]], return_counts=True) for ids, s, k in ((a, start_a, of_a), (b, start_b, of_b)))
        pairs.append((x.astype(np.int64)[:, None] * n_b + y).ravel())
        times.append((often_x[:, None] * often_y).ravel())
    return np.concatenate(pairs), np.concatenate(times)


def group_text(sides: Sides, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
    """Groups as 'a1,a2|b1;a3|b2,b3;' (closed groups: neither side of one is empty)."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[np.cumsum(of_a) - 1] = True
    last_b[np.cumsum(of_b) - 1] = True
    signs = np.empty(len(a) + len(b), object)
    at_a = np.arange(len(a)) + np.repeat(_starts(of_b), of_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(of_a), of_b)
    signs[at_a] = list(map(sides.signs_a.__getitem__, (2 * a + last_a).tolist()))
    signs[at_b] = list(map(sides.signs_b.__getitem__, (2 * b + last_b).tolist()))
    return b"".join(signs.tolist())


# ---- units ----


def _new_units(sides: Sides, fresh: list[str]) -> dict[str, tuple]:
    """For each unit (tokens and groups packed in one number, group text, links, counted links); None if bytes differ."""
    a, b = sides.tokens(fresh)
    many_a, many_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    a, b = (np.fromiter((i for one in x for i in one), np.int64, n.sum()) for x, n in ((a, many_a), (b, many_b)))
    raw = [u.encode() for u in fresh]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    first, first_a, first_b = _starts(size), _starts(many_a), _starts(many_b)
    whole, joined = b"".join(raw), b"".join(map(sides.bytes_b.__getitem__, b.tolist()))
    right = np.zeros(len(fresh), bool)
    bytes_a, bytes_b = (np.bincount(np.repeat(np.arange(len(fresh)), n), s[ids], len(fresh)) for n, s, ids in ((many_a, sides.size_a, a), (many_b, sides.size_b, b)))
    if joined == whole and (bytes_a == size).all() and (bytes_b == size).all():
        right[:] = True
    else:  # one by one
        places = np.concatenate(([0], np.cumsum(bytes_b))).astype(np.int64)
        for i, one in enumerate(raw):
            right[i] = bytes_a[i] == len(one) and joined[places[i] : places[i + 1]] == one
    keep_a, keep_b = np.repeat(right, many_a), np.repeat(right, many_b)
    a, b = a[keep_a], b[keep_b]
    many_a, many_b, size = many_a[right], many_b[right], size[right]
    first_a, first_b = _starts(many_a), _starts(many_b)
    ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    # units end in a common cut, so nothing is left open
    _, _, of_a, of_b = fragment(a, ends_a, b, ends_b)
    of_a, of_b = of_a[:-1], of_b[:-1]
    groups = np.diff(np.concatenate(([0], np.searchsorted(np.cumsum(of_a), first_a + many_a, "left") + 1))) if len(size) else size
    first_group = _starts(groups)
    out: dict[str, tuple] = dict.fromkeys(fresh, None)
    if not len(size):
        return out
    text = group_text(sides, a, b, of_a, of_b).split(b";")[:-1]
    n_b = len(sides.size_b)
    many = of_a.astype(np.int64) * of_b
    big = many > BIG_GROUP
    pairs, _ = links(a, b, np.where(big, 0, of_a), np.where(big, 0, of_b), n_b) if not big.any() else (None, None)
    n_links = np.add.reduceat(many, first_group)
    end_links = np.cumsum(n_links)
    lists = zip([u for u, x in zip(fresh, right) if x], first_group.tolist(), groups.tolist(), many_a.tolist(), many_b.tolist(), n_links.tolist(), end_links.tolist(), first_a.tolist(), first_b.tolist())
    packed = None if pairs is None else pairs.tobytes()
    for unit, g, n, n_a_, n_b_, k, end, i, j in lists:
        counted = None
        if packed is not None:
            own = packed[8 * (end - k) : 8 * end]
        else:
            found, times = links(a[i : i + n_a_], b[j : j + n_b_], of_a[g : g + n], of_b[g : g + n], n_b)
            own, counted = b"", (found, times)
        out[unit] = (n_a_ | n_b_ << 32 | n << 64 | k << 96, b";".join(text[g : g + n]), own, counted)
    return out


def _mask(value: int, place: int) -> int:
    return value >> 32 * place & 0xFFFFFFFF


def _distinct(pairs: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(pairs, return_counts=True)
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


Summary = tuple[int, int, int, int, str, bytes, bytes]
NOTHING: Summary = (0, 0, 0, 0, "", b"", b"")


def _written(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _summaries(sides: Sides, texts: list[str | None], digest: bool) -> list[Summary]:
    """Numbers of tokens, groups and links, groups, distinct pairs and their times, of whole texts."""
    split = [_UNIT.findall(" " + t) if t and SPACE_SIGN not in t else [] for t in texts]
    if len(sides.units) > UNITS_KEPT:
        sides.units.clear()
    known = sides.units
    fresh = list(set().union(*split).difference(known))
    known.update(_new_units(sides, fresh))
    out = []
    for units in split:
        found = list(map(known.__getitem__, units))
        if not found or None in found:
            out.append(NOTHING)
            continue
        total = 0
        for one in found:
            total += one[0]
        pairs = np.frombuffer(b"".join([one[2] for one in found]), np.int64)
        times = None
        if counted := [one[3] for one in found if one[3] is not None]:
            times = np.concatenate([np.ones(len(pairs), np.int64), *(t for _, t in counted)])
            pairs = np.concatenate([pairs, *(p for p, _ in counted)])
        pairs, times = _distinct(pairs, times)
        out.append((_mask(total, 0), _mask(total, 1), _mask(total, 2), int(times.sum()), _written(b";".join([one[1] for one in found]), digest), pairs.astype(sides.pair_type).tobytes(), times.astype(np.uint32).tobytes()))
    for unit in fresh:
        if len(unit) > LONG_UNIT:
            del known[unit]
    return out


def summary_of(sides: Sides, whole: Arrays, digest: bool) -> Summary:
    """The same of the fragment of a whole text, whose last group is empty."""
    a, b, of_a, of_b = whole
    of_a, of_b = of_a[:-1], of_b[:-1]
    pairs, times = links(a, b, of_a, of_b, len(sides.size_b))
    pairs, times = _distinct(pairs, times)
    text = group_text(sides, a.astype(np.int64), b.astype(np.int64), of_a, of_b)[:-1]
    return len(a), len(b), len(of_a), int(times.sum()), _written(text, digest), pairs.astype(sides.pair_type).tobytes(), times.astype(np.uint32).tobytes()


# ---- ranges of long texts ----


def _sure(raw: bytes, at: int) -> bool:
    """True if bytes from at on start a unit."""
    if at == 0:
        return True
    if raw[at : at + 1] != b" ":
        return False
    before = raw[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]
    return not re.match(f"[{WHITE}{SPACE_SIGN}]", before)


def ranges(text: str, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int, str]]:
    """(from, to, start, piece): byte ranges of a space and the text, and the units that hold each, from offset start on.

    A range is chunk bytes long, or longer if no unit starts within it.
    """
    raw = (" " + text).encode()
    low, start = 0, 0
    while low < len(raw):
        high = low + chunk
        while high < len(raw):
            after = high  # the last unit that starts at or before high
            while not _sure(raw, after):
                after = raw.rfind(b" ", 0, after)
            if after > start:
                break
            high += chunk
        else:
            high = after = len(raw)
        end = high
        while end < len(raw) and not _sure(raw, end):
            end = raw.find(b" ", end + 1)
            end = len(raw) if end < 0 else end
        yield low, high, start, raw[start:end].decode()
        low, start = high, after


def range_fragment(sides: Sides, low: int, high: int, start: int, piece: str) -> Arrays | None:
    """Fragment of the tokens that end in a range; None if the tokens' bytes aren't the piece's."""
    if SPACE_SIGN in piece:
        return None
    (a,), (b,) = sides.tokens([piece])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    if b"".join(map(sides.bytes_b.__getitem__, b.tolist())) != piece.encode():
        return None
    ends_a, ends_b = start + np.cumsum(sides.size_a[a]), start + np.cumsum(sides.size_b[b])
    in_a, in_b = ((ends > low) & (ends <= high) for ends in (ends_a, ends_b))
    return fragment(a[in_a], ends_a[in_a], b[in_b], ends_b[in_b])


_PARTS = ["a", "b", "of_a", "of_b"]


def _fragments(pieces: DataFrame, bytes_json: str, pieces_model: str) -> DataFrame:
    """pieces with their fragments in place of the texts; a fragment of null parts stands for bytes that differ."""
    keys = ["doc_id", "text_hash", "part"]
    names = [*keys, *_PARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(bytes_json, pieces_model)
        for batch in batches:
            made = [range_fragment(sides, *(c[i].as_py() for c in batch.columns[3:])) for i in range(batch.num_rows)]
            parts = [pa.array([None if x is None else x[k].tobytes() for x in made], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], names=names)

    return pieces.mapInArrow(tidy(run), "doc_id long, text_hash long, part long, a binary, b binary, of_a binary, of_b binary")


def _composed(fragments: DataFrame, parts: int) -> DataFrame:
    """One fragment for FAN neighbouring ones."""
    names = ["doc_id", "text_hash", "part", *_PARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def joined() -> pa.RecordBatch:
            whole = None if None in held else reduce(compose, [tuple(np.frombuffer(x, np.int32) for x in one) for one in held])
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in now] + [pa.array([None if whole is None else x.tobytes()], pa.binary()) for x in whole or [None] * 4], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["doc_id"], row["text_hash"], row["part"] // FAN)
                if key != now:
                    if held:
                        yield joined()
                    now, held = key, []
                held.append(None if row["a"] is None else tuple(row[x] for x in _PARTS))
        if held:
            yield joined()

    dealt = fragments.repartition(parts, "doc_id", "text_hash", F.floor(F.col("part") / FAN)).sortWithinPartitions("doc_id", "text_hash", "part")
    return dealt.mapInArrow(tidy(run), fragments.schema)


_SUMMARY = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
_SUMMARY_TYPES = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]


def _batch_of(doc_id: pa.Array, rows: list[Summary]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in _SUMMARY.split(", ")]
    return pa.RecordBatch.from_arrays([doc_id, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_SUMMARY_TYPES))], names=["doc_id", *names])


def aligned_documents(docs: DataFrame, bytes_json: str, pieces_model: str, digest: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) for each row of docs; see align_tokenizers."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(bytes_json, pieces_model)
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    some = batch.slice(i, TEXTS_AT_ONCE)
                    yield _batch_of(some.column(0), _summaries(sides, some.column(1).to_pylist(), digest))
        finally:
            sides.units.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(zip(*((i, *x) for i, x in enumerate(ranges(text, chunk)))))
                columns = [[doc_id] * len(found[0]), [text_hash] * len(found[0]), *found]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "text_hash", "part", "low", "high", "start", "piece"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(bytes_json, pieces_model)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [batch.column(k)[i].as_py() for k in range(1, 5)]
                row = NOTHING if parts[0] is None else summary_of(sides, tuple(np.frombuffer(x, np.int32) for x in parts), digest)
                yield _batch_of(batch.column(0).slice(i, 1), [row])

    schema = f"doc_id long, {_SUMMARY}"
    whole = given.where(size < chunk).select("doc_id", "text").mapInArrow(tidy(short), schema)
    # long texts: equal rows go through once and are given back as often as they were there
    long = given.where(size >= chunk)
    most = long.agg(F.max(size)).first()[0]
    if most is None:
        return whole
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(long.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "long")
    pieces = rows.select("doc_id", "text_hash", "text").mapInArrow(tidy(cut), "doc_id long, text_hash long, part long, low long, high long, start long, piece string")
    found = _fragments(pieces.repartition(parts, "doc_id", "text_hash", "part"), bytes_json, pieces_model)
    left = most // chunk + 1
    while left > 1:
        found, left = _composed(found, parts), (left + FAN - 1) // FAN
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    copies = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "copies")
    made = found.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return whole.unionByName(made.select("doc_id", *_PARTS).mapInArrow(tidy(finish), schema))


def pair_counts(aligned: DataFrame, kind: type) -> DataFrame:
    """(pair, n): in how many rows each pair is linked; summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged(new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            x, n = np.unique(np.concatenate(new), return_counts=True)
            x = x.astype(np.int64)
            found, at = np.unique(np.concatenate((pairs, x)), return_inverse=True)
            return found, np.bincount(at, np.concatenate((counts, n)), len(found)).astype(np.int64)

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_py(), kind))
                size += len(held[-1])
                if size >= 2_000_000:
                    pairs, counts = merged(held)
                    held, size = [], 0
            if len(pairs) >= 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held:
            pairs, counts = merged(held)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _looked_up(aligned: DataFrame, counts: DataFrame, kind: type) -> DataFrame:
    """Counts of at most PAIRS_SENT pairs, sent to each worker."""
    table = counts.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    pairs, n, best = (table.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast((pairs.astype(kind), n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            n_best, total = [], []
            for raw, often in zip(batch.column("pairs"), batch.column("times")):
                at = np.searchsorted(pairs, np.frombuffer(raw.as_py(), kind))
                times = np.frombuffer(often.as_py(), np.uint32).astype(np.int64)
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * n[at]).sum()))
            rest = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([rest[c] if c in rest else batch.column(c) for c in _RESULT], names=_RESULT)

    return aligned.mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _joined(aligned: DataFrame, counts: DataFrame, kind: type) -> DataFrame:
    """The same for any number of pairs: a row a pair and document, joined on the pair; a pair of many rows is split by AQE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, often in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = np.frombuffer(raw, kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(np.frombuffer(often, np.uint32).astype(np.int64))], names=["row", "pair", "times"])

    each = aligned.select("row", "pairs", "times").mapInArrow(tidy(run), "row long, pair long, times long").join(counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.join(sums, "row", "left").select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in ("n_best", "count_sum") else c for c in _RESULT))


def align_tokenizers(docs: DataFrame, bytes_json: str, pieces_model: str, digest: bool = False, chunk: int = CHUNK_BYTES, pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for each of docs.

    A is the byte-level vocabulary file, B the sentencepiece model. n_a and n_b count tokens; a link is a pair of token
    occurrences within one group; a pair of ids counts the rows that link it; n_best are links whose count is the highest of
    their A id's, ties included; count_sum adds the counts of all links. groups is 'a1,a2|b1;a3|b2,b3', or its SHA-256 with
    digest. Null and empty texts, and texts whose tokens don't give back their bytes, have zeros and an empty groups.
    Repeated rows stay and count each; a doc_id may be null or come again; other columns are left out; an empty docs gives
    no rows.
    """
    found = aligned_documents(docs, bytes_json, pieces_model, digest, chunk)
    aligned = materialize(found.withColumn("row", F.monotonically_increasing_id()), "aligned")  # written, so the numbers stay
    n_a, n_b = len(Vocabulary(bytes_json).token), _pieces(pieces_model)
    kind = pair_type(n_a * n_b)
    pairs = materialize(pair_counts(aligned, kind), "pairs")
    first = F.floor(F.col("pair") / F.lit(n_b)).alias("a")
    top = pairs.groupBy(first).agg(F.max("n").alias("top"))
    counts = pairs.withColumn("a", first).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return _looked_up(aligned, counts, kind) if pairs.count() <= pairs_sent else _joined(aligned, materialize(counts, "counts"), kind)


def _pieces(pieces_model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_model).get_piece_size()
