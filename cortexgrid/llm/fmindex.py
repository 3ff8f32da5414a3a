"""A compressed full-text index of word sequences, for one shard in a Python worker.

The Burrows-Wheeler transform of the pieces, over words as symbols, is held in a wavelet matrix whose codes have the
lengths of a Huffman code (Claude, Navarro and Ordonez 2015), so it takes about the transform's entropy in bits. Backward
search narrows an interval of suffixes by one word; matching statistics fall back to the parent interval when that fails
(Ohlebusch, Gog and Kuegel 2010), found in the array of common prefixes. All pieces of a batch take a step together.

Suffixes are sorted by their first DEPTH words or more, which is right for matches of up to DEPTH words.
"""

from __future__ import annotations

import heapq

import numpy as np

_ONE, _LOW = np.uint64(1), np.uint64(63)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's Huffman code; one symbol alone has one bit. Every count is at least 1."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above = np.zeros(2 * len(counts) - 1, np.int64)
    for node in range(len(counts), len(above)):
        a = heapq.heappop(heap)
        b = heap[0]
        above[a[1]] = above[b[1]] = node
        heapq.heapreplace(heap, (a[0] + b[0], node))
    depth = np.zeros(len(above), np.int64)
    for node in range(len(above) - 2, -1, -1):
        depth[node] = depth[above[node]] + 1
    return depth[: len(counts)]


class WaveletMatrix:
    """Sequence of symbols 0 .. k - 1, each of which occurs; counts symbols in prefixes.

    Level l has bit l of the code of every place whose code is longer than l. Zeros go before ones to the next level, in
    order, and codes are dealt so that those which end come last there: they are cut off and no place before them moves.
    """

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        lengths = code_lengths(np.bincount(sequence, minlength=n_symbols))
        self.lengths, self.codes = lengths, np.zeros(n_symbols, np.int64)
        # nodes of a level by the order of their places; the last ones become symbols
        nodes, waiting = np.zeros(1, np.int64), np.argsort(lengths, kind="stable")
        for level in range(1, int(lengths.max()) + 1):
            nodes = np.concatenate((nodes, nodes + (1 << (level - 1))))
            ends = int(np.searchsorted(lengths[waiting], level, "right"))
            here, waiting = waiting[:ends], waiting[ends:]
            self.codes[here] = nodes[len(nodes) - ends :]
            nodes = nodes[: len(nodes) - ends]
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = sequence
        for level in range(int(lengths.max())):
            bits = (self.codes[now] >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(now) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:], dtype=np.int32)
            self.levels.append((words, before, len(now) - int(bits.sum())))
            now = np.concatenate((now[~bits], now[bits]))
            now = now[: np.count_nonzero(lengths[now] > level + 1)]
        self.first = np.zeros(n_symbols, np.int64)
        self.first = self._place(np.arange(n_symbols), np.zeros((1, n_symbols), np.int64))[0]

    def _place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places before each at lead, by the symbol's code; one column a symbol."""
        out, rest = at.copy(), np.arange(len(symbols))
        lengths, codes = self.lengths[symbols], self.codes[symbols]
        for level, (words, before, zeros) in enumerate(self.levels):
            if level:
                going = lengths > level
                if not going.all():
                    rest, at, lengths, codes = rest[going], at[:, going], lengths[going], codes[going]
                    if not len(rest):
                        break
            word = at >> 6
            inside = words[word] & ((_ONE << (at.astype(np.uint64) & _LOW)) - _ONE)
            ones = before[word] + np.bitwise_count(inside)
            at = np.where(codes >> level & 1, zeros + ones, at - ones)
            out[:, rest] = at
        return out

    def counts(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place at; at has one column a symbol and any number of rows."""
        return self._place(symbols, at) - self.first[symbols]


class FmIndex:
    """Index of pieces, each a run of the unsigned 64-bit words joined in words; sizes are their lengths.

    times says how often each piece counts. depth is the most words that a match has to be right for.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, times: np.ndarray, depth: int):
        self.alphabet, coded = np.unique(words, return_inverse=True)
        n = len(words) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)  # 0 ends a piece
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = coded + 1
        ranks, width = [text.astype(np.int32)], 1
        while width < depth:
            r = ranks[-1].astype(np.int64)
            key = r * (int(r.max()) + 2)
            key[:-width] += r[width:] + 1
            order = np.argsort(key)
            new = np.ones(n, np.int32)
            new[0] = 0
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            ranks.append(rank)
            width *= 2
        self.depth = width
        order = np.argsort(ranks[-1], kind="stable")
        common = np.zeros(n + 1, np.int16)  # words that a suffix shares with the one before it
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            near = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[near] = ranks[k][a[near]] == ranks[k][b[near]]
            if k == len(ranks) - 1:  # whole depth in common: nothing is left to compare
                common[1:-1][same] = width
                rest = np.flatnonzero(~same)
                a, b = a[rest], b[rest]
                continue
            common[1:-1][rest[same]] += 1 << k
            a, b = a + (same << k), b + (same << k)
        self.shared = [common]
        while (1 << len(self.shared)) <= n + 1:
            last, step = self.shared[-1], 1 << (len(self.shared) - 1)
            self.shared.append(np.minimum(last[:-step], last[step:]))
        self.n = n
        start = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.start = np.cumsum(start) - start
        self.tree = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        weight = np.repeat(np.minimum(times, 2), sizes + 1) * inside
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))

    def _parents(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, words) of the smallest interval that holds more than [low, high)."""
        words = np.maximum(self.shared[0][low], self.shared[0][high])
        low, high = low.copy(), high.copy()
        for k in range(len(self.shared) - 1, -1, -1):
            step, table = 1 << k, self.shared[k]
            # entries low - step + 1 .. low, and high .. high + step - 1
            can = np.flatnonzero(low + 1 >= step)
            go = can[table[low[can] - step + 1] >= words[can]]
            low[go] -= step
            can = np.flatnonzero(high + step <= self.n + 1)
            go = can[table[high[can]] >= words[can]]
            high[go] += step
        # without common words all suffixes remain
        low[words == 0], high[words == 0] = 0, self.n
        return low, high, words

    def matching(self, words: np.ndarray, sizes: np.ndarray, times: int = 2) -> np.ndarray:
        """For each place of the given pieces, the words from there on that the index has at least so many times (1 or 2).

        Pieces may hold words that the index doesn't have. Found right for up to depth words.
        """
        out = np.zeros(len(words), np.int16)
        if not self.n or not len(words):
            return out
        symbol = np.searchsorted(self.alphabet, words)
        known = symbol < len(self.alphabet)
        known[known] = self.alphabet[symbol[known]] == words[known]
        symbol = np.where(known, symbol + 1, 0)
        order = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[order], np.cumsum(sizes)[order]
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for step in range(int(sizes[0])):
            active = int(np.searchsorted(-sizes, -step, "left"))
            at = ends[:active] - 1 - step
            todo = np.arange(active)
            while len(todo):
                c = symbol[at[todo]]
                found = self.start[c] + self.tree.counts(c, np.stack((low[todo], high[todo])))
                good = (self.weight[found[1]] - self.weight[found[0]] >= times) & (c > 0)
                hit = todo[good]
                low[hit], high[hit] = found[:, good]
                length[hit] += 1
                todo = todo[~good]
                none = todo[length[todo] == 0]
                low[none], high[none] = 0, self.n
                todo = todo[length[todo] > 0]
                if len(todo):
                    low[todo], high[todo], length[todo] = self._parents(low[todo], high[todo])
            out[at] = length[:active]
        return out
