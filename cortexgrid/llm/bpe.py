"""Operator 1: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Every chunk of documents is split into words; its distinct words go into a trie of bytes. A depth-first walk keeps, for
each prefix on the path, the last token of that prefix's encoding. The state of a longer prefix follows from earlier
ones: the last token t is the one suffix for which (last token of what precedes t, t) is a pair that no merge crosses.
A prefix that many words share is so encoded once, and the cost is linear in the trie, also for very long words.

Work is one narrow pass: no shuffle, nothing collected, a lost task is just run again. Memory is bounded by the chunk
(CHUNK_CHARS), the largest text, and a word table that is emptied at WORDS_KEPT entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexgrid.llm.tokens import tidy

#: Characters of text whose distinct words share one trie.
CHUNK_CHARS = 2_000_000
#: Entries of a worker's table of encoded words, and of its table of tested token pairs.
WORDS_KEPT = 600_000
PAIRS_KEPT = 500_000
#: Words over so many bytes are encoded but not kept.
LONG_WORD = 64

#: Fixed value: the word pattern of the published byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 60
one_byte = [bytes((b,)) for b in range(256)]


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a token string stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes of each token of a vocabulary file; decodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self._read()
        del self.spec

    def _read(self) -> None:
        byte = _byte_of_char()
        vocab = self.spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.token: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            if text not in self.special:
                self.token[i] = bytes(byte[c] for c in text)
        self.plain = [i for text, i in vocab.items() if text not in self.special]
        for text, i in self.special.items():
            self.token[i] = text.encode()

    def forget(self) -> None:
        pass

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary stand for nothing."""
        token, n = self.token, len(self.token)
        ids = np.frombuffer(packed, "<u4")
        ids = (ids if not ids.size or ids.max() < n else ids[ids < n]).tolist()
        return b"".join(map(token.__getitem__, ids)).decode("utf-8", "replace")


class TrieEncoder(Vocabulary):
    """Encodes words of one vocabulary file; lives in a Python worker."""

    def _read(self) -> None:
        super()._read()
        vocab = self.spec["model"]["vocab"]
        self.ids = {self.token[i]: i for i in self.plain}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(self.spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(vocab[a + b], (*pair, r))
        self.starts = {raw[:n] for raw in self.ids for n in range(1, len(raw) + 1)}
        self.suffixes: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one end of token while it is being built, each with the rank of the merge that ends it."""
        if (token, side) not in self.edges:
            out, now, until = [], token, NEVER
            while True:
                out.append((now, until))
                if now not in self.parts:
                    break
                until, now = self.parts[now][2], self.parts[now][side]
            self.edges[token, side] = out
        return self.edges[token, side]

    def _adjacent(self, p: int, t: int) -> bool:
        """True if the bytes of p and t together encode to p, t: no merge joins their facing ends before both are whole."""
        key = p << 20 | t
        if (known := self.pairs.get(key)) is None:
            rank = self.rank.get
            known = not any((r := rank((x, y), NEVER)) < ends and r <= stops for x, ends in self._edge(p, 1) for y, stops in self._edge(t, 0))
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _suffix_tokens(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """Tokens (and their lengths) that tail ends with, longest first; kept, as tails are parts of tokens."""
        ends = tuple((self.ids[x], len(x)) for i in range(len(tail)) if (x := tail[i:]) in self.ids)
        self.suffixes[tail] = ends
        return ends

    def _encode_new(self, words: list[str]) -> dict[str, bytes]:
        """Encodings (packed ids) of distinct words, by a depth-first walk over their trie.

        The trie is held as its sorted leaves: the node where a word branches off is its common prefix with the word
        before it, and last and tails are the states along the path from the root to the present node.
        """
        out: dict[str, bytes] = {}
        token, adjacent, starts, suffixes, pairs = self.token, self._adjacent, self.starts, self.suffixes, self.pairs
        last, tails = [0], [b""]
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            depth = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], tails[depth + 1 :]
            # tail: the longest suffix of the prefix that begins some token
            tail = tails[depth]
            for b in raw[depth:]:
                depth += 1
                tail += one_byte[b]
                while tail not in starts:
                    tail = tail[1:]
                tails.append(tail)
                if (ends := suffixes.get(tail)) is None:
                    ends = self._suffix_tokens(tail)
                for t, length in ends:
                    if length == depth:
                        break
                    p = last[depth - length]
                    if (good := pairs.get(p << 20 | t)) is None:
                        good = adjacent(p, t)
                    if good:
                        break
                last.append(t)
            found = []
            while depth:
                found.append(last[depth])
                depth -= len(token[last[depth]])
            out[word] = pack(f"<{len(found)}I", *reversed(found))
            before = raw
        return out

    def forget(self) -> None:
        """Leave only what comes from the vocabulary file."""
        for table in (self.known, self.pairs, self.suffixes, self.edges):
            table.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        split: list[list[str]] = []
        for text in texts:
            if self.special_split and any(s in text for s in self.special):
                parts = self.special_split.split(text)
                split.append([w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))])
            else:
                split.append(self.words(text))
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known = self.known
        for text, i in self.special.items():
            known[text] = pack("<I", i)
        fresh = set().union(*split).difference(known)
        known.update(self._encode_new(list(fresh)))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in fresh:
            if len(word) > LONG_WORD:
                del known[word]
        return out


_loaded: dict[tuple[type, str], Vocabulary] = {}


def _load(kind: type, path: str):
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _added(df: DataFrame, column: str, fields: list[tuple[T.StructField, pa.DataType]], kind: type, path: str, fn: Callable[[Vocabulary, list], list[list]]) -> DataFrame:
    """df with more columns computed over chunks of rows; fn takes the vocabulary and column's values and gives lists.

    A worker keeps the vocabulary for its next task, but not the words that this one has met.
    """
    for field, _ in fields:
        if field.name in df.columns:
            raise ValueError(f"column {field.name} exists")
    schema = T.StructType([*df.schema.fields, *(field for field, _ in fields)])
    at = df.columns.index(column)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column(at)
        start, held = 0, 0
        for i in range(batch.num_rows):
            held += len(values[i].as_py() or ())
            if held >= CHUNK_CHARS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _load(kind, path)
        try:
            for batch in batches:
                for part in parts(batch):
                    made = [pa.array(values, of) for values, (_, of) in zip(fn(coder, part.column(at).to_pylist()), fields)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(field.name for field, _ in fields)])
        finally:
            coder.forget()

    return df.mapInArrow(tidy(run), schema)


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "bpe_ids") -> DataFrame:
    """df with a binary column of packed ids (little-endian unsigned 32-bit), see ids_array.

    The ids are those of the tokenizers library without special tokens added, truncation or padding; a special token's
    string within a text is that token. Null texts count as empty and give empty ids; repeated rows stay; an empty df
    gives no rows; the name given by ids must be new, all other columns pass through unchanged.
    """
    return _added(df, text, [_id_field(ids)], TrieEncoder, tokenizer, lambda coder, texts: [coder.encode([x or "" for x in texts])])


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "bpe_ids", text: str = "decoded") -> DataFrame:
    """df with the text of a packed id column, special tokens included. Null ids give an empty text."""
    return _added(df, ids, [_text_field(text)], Vocabulary, tokenizer, lambda coder, packed: [[coder.decode(x or b"") for x in packed]])


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "bpe_ids", decoded: str = "decoded") -> DataFrame:
    """bpe_encode and bpe_decode of its ids in one pass, so that a task takes one worker and not two."""

    def both(coder: TrieEncoder, texts: list) -> list[list]:
        packed = coder.encode([x or "" for x in texts])
        return [packed, list(map(coder.decode, packed))]

    return _added(df, text, [_id_field(ids), _text_field(decoded)], TrieEncoder, tokenizer, both)


def _id_field(name: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(name, T.BinaryType(), False), pa.binary()


def _text_field(name: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(name, T.StringType(), False), pa.string()


def n_ids(packed: Column | str) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def ids_array(packed: Column | str) -> Column:
    """array<bigint> of a packed id column."""
    text = F.hex(packed)
    one = lambda i: F.conv(F.concat(*(F.substring(text, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4))), 16, 10).cast("long")
    return F.when(F.octet_length(packed) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n_ids(packed).cast("int") - 1), one))
