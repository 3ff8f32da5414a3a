"""Operator 12 against both libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest

from cortexgrid.llm import alignment
from cortexgrid.llm.bpe import Vocabulary
from cortexgrid.llm.queries import pieces_path, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def key(row):
    return row[0] is None, row


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    a.encode_special_tokens = True
    bytes_a = Vocabulary(tokenizer_path()).token

    def bytes_b(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def both(text):
        """Ids and ends of both, or None."""
        out = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, bytes_a.__getitem__), (b.encode(text), bytes_b)):
            raw = [of(i) for i in ids]
            if not text or b"".join(raw) != (" " + text).encode():
                return None
            out.append((ids, np.cumsum([len(x) for x in raw]).tolist()))
        return out

    return both


def plain_groups(ids_a, ends_a, ids_b, ends_b):
    ordered = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in range(len(ordered) + 1)]
    where, place = {}, 0
    for end in range(1, max(ends_a[-1], ends_b[-1]) + 1):
        where[end] = place
        if place < len(ordered) and end == ordered[place]:
            place += 1
    for ids, ends, side in ((ids_a, ends_a, 0), (ids_b, ends_b, 1)):
        for i, end in zip(ids, ends):
            groups[where[end]][side].append(i)
    return groups[:-1]


def brute(rows, both):
    docs, corpus = [], Counter()
    for i, text in rows:
        found = both(text) if text else None
        if found:
            groups = plain_groups(*found[0], *found[1])
            pairs = Counter((x, y) for g, h in groups for x in g for y in h)
            corpus.update(pairs.keys())
            docs.append((i, len(found[0][0]), len(found[1][0]), groups, pairs))
        else:
            docs.append((i, 0, 0, [], Counter()))
    top = defaultdict(int)
    for (x, _), n in corpus.items():
        top[x] = max(top[x], n)
    out = []
    for i, n_a, n_b, groups, pairs in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for p, n in pairs.items() if corpus[p] == top[p[0]])
        out.append((i, n_a, n_b, len(groups), sum(pairs.values()), best, sum(n * corpus[p] for p, n in pairs.items()), text))
    return sorted(out, key=key)


def hashed(rows):
    return [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in rows]


def found(docs, **options):
    return sorted((tuple(r) for r in alignment.align_tokenizers(docs, tokenizer_path(), pieces_path(), **options).select(COLUMNS).collect()), key=key)


ROWS = [
    (1, "Hello  world\n\n foo\n bar  baz"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "<|endoftext|> <s> <0x41> x"), (6, "<|endoftext|> <s> <0x41> x"),
    (None, "naïve 日本語 \U0001f600\x00 \x1c!\x1c? a\xa0b \xa0 c"), (8, "x" * 5000), (9, "ab " * 3000), (9, "ab " * 3000), (10, " \t\n " * 400 + "z"),
    (11, "".join(chr(0x400 + i % 200) + ("　 " if i % 7 == 0 else "") for i in range(3000))), (12, "  two  spaces   three "), (13, "end ▁"),
    (14, "q" * 30000 + " " + "r" * 100), (15, "12345678901234567890 3.14159 " * 40),
]


@pytest.mark.parametrize("options", [{}, {"chunk": 64}, {"chunk": 700, "pairs_sent": 0}])
def test_odd_texts(spark, libraries, options):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("row", alignment.F.lit("x")).repartition(3)
    assert found(docs, **options) == brute(ROWS, libraries)


def test_given_table(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], libraries)
    assert found(docs, digest=True) == hashed(want)
    assert found(docs, chunk=900) == want


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def same(x, y):
    return all(np.array_equal(a, b) for a, b in zip(x, y))


def test_fragments_compose_in_any_order(libraries):
    text = "Unaligned tokenizations of café, 12345 and whitespace   runs\n\nmeet; bytes \U0001f980 too. " * 5
    (a, ends_a), (b, ends_b) = ([np.array(x) for x in side] for side in libraries(text))
    whole = alignment.fragment(a, ends_a, b, ends_b)
    assert [len(g) for g, _ in plain_groups(a.tolist(), ends_a.tolist(), b.tolist(), ends_b.tolist())] == whole[2][:-1].tolist()
    random.seed(4)
    for _ in range(50):
        at = sorted({0, int(ends_a[-1]), *(random.randrange(int(ends_a[-1])) for _ in range(random.randint(0, 30)))})
        parts = []
        for low, high in zip(at, at[1:]):
            x, y = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
            parts.append(alignment.fragment(a[x], ends_a[x], b[y], ends_b[y]))
        assert same(reduce(alignment.compose, parts, alignment.EMPTY), whole)
        while len(parts) > 1:  # neighbours at random
            i = random.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.compose(parts[i], parts[i + 1])]
        assert same(alignment.compose(parts[0], alignment.EMPTY), whole)


def test_big_groups_are_counted(monkeypatch):
    rng = np.random.default_rng(3)
    of_a, of_b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    a, b = rng.integers(0, 5, of_a.sum()), rng.integers(0, 5, of_b.sum())
    listed = alignment._distinct(*alignment.links(a, b, of_a, of_b, 5))
    monkeypatch.setattr(alignment, "BIG_GROUP", 3)
    assert same(alignment._distinct(*alignment.links(a, b, of_a, of_b, 5)), listed)
    assert listed[1].sum() == (of_a * of_b).sum()


def test_ranges_cover_the_bytes():
    for text in ("word " * 50, "x" * 300, " " * 90 + "y", "a\xa0 b c " * 20):
        for chunk in (1, 7, 64):
            raw, before = (" " + text).encode(), 0
            for low, high, start, piece in alignment.ranges(text, chunk):
                assert low == before and start <= low < high and raw[start : start + len(piece.encode())] == piece.encode()
                assert start + len(piece.encode()) >= high and high - low >= min(chunk, len(raw) - low)
                before = high
            assert before == len(raw)
