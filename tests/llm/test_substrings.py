"""Operator 11 and its index against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexgrid.llm import substrings
from cortexgrid.llm.fmindex import FmIndex, WaveletMatrix, code_lengths

SF = "/root/testdata/sf0.001"


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(1)
    for _ in range(40):
        _, s = np.unique(rng.zipf(1.5, int(rng.integers(1, 300))) % int(rng.integers(1, 30)), return_inverse=True)
        tree = WaveletMatrix(s, s.max() + 1)
        symbols, at = rng.integers(0, s.max() + 1, 100), rng.integers(0, len(s) + 1, (2, 100))
        assert (tree.counts(symbols, at) == [[np.sum(s[:a] == c) for c, a in zip(symbols, row)] for row in at]).all()


def test_codes_are_compressed():
    counts = np.array([2**k for k in range(10)])
    bits = (code_lengths(counts) * counts).sum()
    p = counts / counts.sum()
    assert bits <= (1 - (p * np.log2(p)).sum()) * counts.sum()
    assert (2.0 ** -code_lengths(counts)).sum() == 1


@pytest.mark.parametrize("times", [1, 2])
def test_matching_statistics(times):
    rng = np.random.default_rng(times)
    for _ in range(60):
        sizes = rng.integers(1, 30, int(rng.integers(1, 10)))
        words = rng.integers(0, int(rng.integers(1, 5)), sizes.sum()).astype(np.uint64)
        weight = rng.integers(1, 4, len(sizes))
        pieces = [words[e - n : e].tolist() for n, e in zip(sizes, np.cumsum(sizes))]
        query = rng.integers(0, 5, 25).astype(np.uint64)
        for given, lengths in ((words, sizes), (query, np.array([25]))):
            got = FmIndex(words, sizes, weight, 32).matching(given, lengths, times)
            for n, e in zip(lengths, np.cumsum(lengths)):
                for i in range(e - n, e):
                    def there(size, i=i):
                        run = given[i : i + size].tolist()
                        return sum(min(2, w) * sum(p[j : j + size] == run for j in range(len(p) - size + 1)) for p, w in zip(pieces, weight))

                    assert got[i] == max([0, *(k for k in range(1, e - i + 1) if there(k) >= times)])


def brute(rows, width):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def key(row):
    return row[0] is None, row


def found(docs, width, **options):
    return sorted((tuple(r) for r in substrings.remove_repeats(docs, width, **options).select("doc_id", "n_words", "n_removed", "text").collect()), key=key)


@pytest.mark.parametrize("options", [{}, {"hot_segments": 0, "shard_words": 60}])
@pytest.mark.parametrize("width", [3, 12, 35])
def test_repeats_are_removed(spark, options, width):
    random.seed(2)
    rows = [(random.choice([1, 2, 3, None]), " ".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for _ in range(50)]
    rows += [(7, "x " * 300), (7, "x " * 36), (8, None), (9, ""), (9, " \n\t"), (10, "y " * 35), (11, "x " * 29 + "z " * 9), (12, "long" * 20_000 + " \x0b" + "é " * 34)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, width, **options) == sorted(brute(rows, width), key=key)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found(docs, 35) == sorted(brute([tuple(r) for r in docs.collect()], 35), key=key)


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 6)], "start string, text string, anchor int").withColumn("doc_id", F.lit(4))
    rows = substrings.remove_repeats(docs, 3).collect()
    assert sorted((r.start, r.text, r.anchor, r.doc_id, r.n_removed) for r in rows) == [("1", "", 5, 4, 3), ("1", "", 6, 4, 3)]
    assert substrings.remove_repeats(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs.withColumn("n_words", F.lit(1)))
