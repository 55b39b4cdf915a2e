"""A bidirectional FM-index over a delimited vocabulary, searched for words that differ in one code point.

The text is a delimiter, then each word with a delimiter after it, words in code-point order; the index is that of the text and of its reverse.
A match is a pair of intervals of suffix ranks, one in each, that are kept in step, so it can be extended at either
end. The suffixes that begin with a delimiter come first and in the order of the words, so the rank of a whole
delimited word is its number. Everything runs on arrays of queries of one length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Text between two rows of counts.
BLOCK = 32
#: Queries that are searched together.
TOGETHER = 4096


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of text (small integers) in order, by doubling the length that they are ranked by."""
    n, bits = len(text), max(1, int(text.max()).bit_length() + 1)
    span = max(1, 62 // bits)
    padded = np.zeros(n + span, dtype=np.int64)
    padded[:n] = text + 1
    key = np.zeros(n, dtype=np.int64)
    for k in range(span):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, dtype=np.int64)
        steps[0] = 0
        steps[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + after
        span *= 2


class _Side:
    """Counts of symbols before any place of one text's transform."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        transform = text[order - 1]  # the text is followed by itself
        n = len(text)
        self.symbols = symbols
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.padded = np.full((n // BLOCK + 1) * BLOCK, symbols, dtype=np.int16)
        self.padded[:n] = transform
        rows = np.bincount(np.arange(len(self.padded)) // BLOCK * (symbols + 1) + self.padded, minlength=(n // BLOCK + 1) * (symbols + 1)).reshape(-1, symbols + 1)[:, :symbols]
        before = np.zeros_like(rows)
        before[1:] = np.cumsum(rows[:-1], axis=0)
        #: less[b, c]: symbols under c in the blocks before b
        self.less = np.zeros((len(rows), symbols + 1), dtype=np.int32)
        self.less[:, 1:] = np.cumsum(before, axis=1)

    def _block(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block, inside = rows // BLOCK, rows % BLOCK
        own = self.padded.reshape(-1, BLOCK)[block]
        return block, np.where(np.arange(BLOCK) < inside[:, None], own, self.symbols)

    def counts(self, rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols under c, and equal to c, before each row."""
        block, own = self._block(rows)
        under = self.less[block, c] + (own < c[:, None]).sum(axis=1)
        equal = self.less[block, c + 1] - self.less[block, c] + (own == c[:, None]).sum(axis=1)
        return under, equal

    def all_counts(self, rows: np.ndarray) -> np.ndarray:
        """[row, c]: symbols under c before each row, for every c up to the number of symbols."""
        block, own = self._block(rows)
        width = self.symbols + 1
        inside = np.bincount((np.arange(len(rows))[:, None] * width + own).ravel(), minlength=len(rows) * width).reshape(-1, width)[:, : self.symbols]
        out = self.less[block].astype(np.int64)
        out[:, 1:] += np.cumsum(inside, axis=1)
        return out


@dataclass
class Matches:
    """Nonempty matches: query's number, interval of width `wide` from `here` in the index of the text and from `there` in that of its reverse."""

    query: np.ndarray
    here: np.ndarray
    there: np.ndarray
    wide: np.ndarray

    def at(self, kept: np.ndarray) -> Matches:
        return Matches(self.query[kept], self.here[kept], self.there[kept], self.wide[kept])

    @staticmethod
    def joined(parts: list[Matches]) -> Matches:
        return Matches(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("query", "here", "there", "wide")))


class BidirectionalIndex:
    def __init__(self, words: list[str]):
        """words: distinct, not empty, in code-point order."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.alphabet = np.unique(codes)
        self.symbols = len(self.alphabet) + 1
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.zeros(len(codes) + len(words) + 1, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[0] = False
        inside[np.cumsum(lengths + 1)] = False
        text[inside] = np.searchsorted(self.alphabet, codes) + 1
        self.size = len(text)
        self.left, self.right = _Side(text, self.symbols), _Side(text[::-1], self.symbols)

    def coded(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length; a code point that the vocabulary lacks is -1."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == codes, place + 1, -1)

    def everything(self, n: int) -> Matches:
        zero = np.zeros(n, dtype=np.int64)
        return Matches(np.arange(n), zero, zero.copy(), np.full(n, self.size))

    def extended(self, found: Matches, c: np.ndarray, leftwards: bool) -> Matches:
        """Each match with one more symbol at its left or right end."""
        known = c >= 0
        if not known.all():
            found, c = found.at(known), c[known]
        side = self.left if leftwards else self.right
        own, other = (found.here, found.there) if leftwards else (found.there, found.here)
        under_a, equal_a = side.counts(own, c)
        under_b, equal_b = side.counts(own + found.wide, c)
        wide = (equal_b - equal_a).astype(np.int64)
        kept = wide > 0
        own = (side.first[c] + equal_a)[kept]
        other = (other + under_b - under_a)[kept]
        return Matches(found.query[kept], own if leftwards else other, other if leftwards else own, wide[kept])

    def branched(self, found: Matches, leftwards: bool) -> tuple[Matches, np.ndarray]:
        """Each match with every code point (no delimiter) that can follow at that end, and which one."""
        side = self.left if leftwards else self.right
        own, other = (found.here, found.there) if leftwards else (found.there, found.here)
        under_a, under_b = side.all_counts(own), side.all_counts(own + found.wide)
        equal_a = np.diff(under_a, axis=1)
        wide = np.diff(under_b, axis=1) - equal_a
        wide[:, 0] = 0
        at, c = np.nonzero(wide)
        own = side.first[c] + equal_a[at, c]
        other = other[at] + under_b[at, c] - under_a[at, c]
        return Matches(found.query[at], own if leftwards else other, other if leftwards else own, wide[at, c]), c

    def near(self, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, vocabulary number) of the vocabulary's words that differ in one code point from each of words, which have one length of 2 or more.

        first_half: those whose first half is the query's. Otherwise those whose other half is the query's (some are of both kinds).
        The halves are the first length // 2 code points and the rest.
        """
        pairs = [self._near(words[i : i + TOGETHER], first_half, i) for i in range(0, len(words), TOGETHER)]
        return tuple(np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))

    def _near(self, words: list[str], first_half: bool, base: int) -> tuple[np.ndarray, np.ndarray]:
        coded, length = self.coded(words), len(words[0])
        half, end = length // 2, np.zeros(len(words), dtype=np.int64)
        exact = self.everything(len(words))
        # the half that is matched exactly, from the middle outwards, then the delimiter beyond it
        for j in range(half - 1, -1, -1) if first_half else range(half, length):
            exact = self.extended(exact, coded[exact.query, j], leftwards=first_half)
        exact = self.extended(exact, end[exact.query], leftwards=first_half)
        # the other half, from the middle outwards
        rest = range(half, length) if first_half else range(half - 1, -1, -1)
        one: list[Matches] = []
        for j in rest:
            ways, c = self.branched(exact, leftwards=not first_half)
            wanted = coded[ways.query, j]
            before = Matches.joined([*one, ways])  # a code point that the query lacks stands before its next one
            one = [self.extended(before, coded[before.query, j], leftwards=not first_half), ways.at(c != wanted), exact]
            exact = ways.at(c == wanted)
        ways, _ = self.branched(exact, leftwards=not first_half)
        whole = Matches.joined([*one, ways])
        whole = self.extended(whole, end[whole.query], leftwards=not first_half)
        pairs = np.unique(np.stack([whole.query + base, whole.here - 1], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]
