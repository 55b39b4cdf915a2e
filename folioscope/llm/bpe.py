"""Operator 9: byte-pair encoding and decoding with forced boundaries.

The vocabulary file gives the merges; nothing is trained. Two neighbouring byte symbols that stand inside
no vocabulary token can never be merged across, so every such place is a certain cut: the
fragments between cuts are encoded independently and their ids are concatenated. Spaces and the
pre-tokenizer's borders are cuts of the same kind. Results of white-space separated chunks are kept in
a cache of bounded size in each task.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import in_task, shipped, table

END = "</w>"
#: Chunks that a task's cache holds in each of its two generations, and the longest chunk that it takes in.
CACHED, LONGEST = 100_000, 100
#: White space of the tokenizer file's patterns: Unicode's White_Space (Python's str.split() also takes U+001C to U+001F).
GAP = r"[\t-\r\x20\x85\p{Z}]"
CHUNKS = regex.compile(rf"(?:(?!{GAP}).)+", regex.S)
PRETOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|(?:(?!{GAP})[^\p{{L}}\p{{N}}])+", regex.S)
ODD_GAPS = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself for printable Latin-1, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Cache(dict):
    """chunk -> its encoding (never empty) or size, in two generations: the older one goes when the newer one is full."""

    def __init__(self, make: Callable[[str], tuple]):
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> tuple:
        found = self.old.get(chunk) or self.make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.inner, self.last = ([self.ids[x + end] for x in self.symbols] for end in ("", END))
        bare = (t.removesuffix(END) for t in self.ids)
        joined = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        place = {x: i for i, x in enumerate(self.symbols)}
        self.joined = {place[a] << 8 | place[b] for a, b in joined if a in place and b in place}
        self.splitter = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache, self.sizes = Cache(self.chunk), Cache(self._size)

    def fragments(self, word: str) -> list[list[int]]:
        """Ids of a pre-token's bytes, cut wherever no vocabulary token can span; the last one carries the word end."""
        raw, joined = word.encode(), self.joined
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        cuts = [i for i in range(1, len(raw)) if (raw[i - 1] << 8 | raw[i]) not in joined]
        if not cuts:
            return [ids]
        return [ids[i:j] for i, j in zip([0, *cuts], [*cuts, len(ids)])]

    def merged(self, s: list[int]) -> list[int]:
        """Lowest-ranked pair first, leftmost first, until no pair has a rank. s is used up."""
        if len(s) > 200:
            return self._merged_long(s)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(s, s[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            s[i] = new = self.made[best]
            del s[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(s[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | s[i + 1], none)
        return s

    def _merged_long(self, s: list[int]) -> list[int]:
        rank, n = self.rank, len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(s, s[1:])) if p in rank]
        heapq.heapify(heap)
        alive = list(s)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if alive[i] < 0 or j >= n or alive[i] << 32 | alive[j] != pair:
                continue
            alive[i], alive[j] = self.made[best], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := alive[i] << 32 | alive[after[i]]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if before[i] >= 0 and (p := alive[before[i]] << 32 | alive[i]) in rank:
                heapq.heappush(heap, (rank[p], before[i], p))
        return [x for x in alive if x >= 0]

    def _shown(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([self.names[i] for i in ids]).encode()

    def _word(self, word: str) -> tuple[int, bytes, bytes]:
        return self._shown([t for f in self.fragments(word) for t in self.merged(f)])

    def chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        """Number of tokens, the ids as decimals, and the decoded tokens, the last two with spaces between."""
        words = [chunk] if chunk.isalpha() else PRETOKENS.findall(chunk)
        if len(words) == 1:
            return self._word(words[0])
        found = [self.cache[w] if len(w) < len(chunk) else self._word(w) for w in words]
        return sum([x[0] for x in found]), b" ".join([x[1] for x in found]), b" ".join([x[2] for x in found])

    def _size(self, chunk: str) -> int:
        words = [chunk] if chunk.isalpha() else PRETOKENS.findall(chunk)
        if len(words) > 1:
            return sum([self.sizes[w] for w in words])
        return sum([len(self.merged(f)) for f in self.fragments(words[0])])

    def parts(self, text: str | None) -> Iterator[tuple[bool, list[str]]]:
        """A text cut at special tokens: (True, [token]), or (False, the chunks between white space)."""
        for i, part in enumerate(self.splitter.split(text or "") if self.splitter else [text or ""]):
            if i % 2:
                yield True, [part]
                continue
            # characters are lower-cased one by one, so a final sigma stays an ordinary one
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            yield False, CHUNKS.findall(part) if ODD_GAPS.search(part) else part.split()

    def pieces(self, text: str | None) -> list[tuple[int, bytes, bytes]]:
        """The encoded chunks of a text in order. Special tokens' strings in a text become their ids."""
        out = []
        for special, chunks in self.parts(text):
            out += [self._shown([self.special[chunks[0]]])] if special else map(self.cache.__getitem__, chunks)
        return out

    def count(self, text: str | None) -> int:
        """Number of tokens of a text, from a cache that holds numbers only."""
        return sum([1 if special else sum(map(self.sizes.__getitem__, chunks)) for special, chunks in self.parts(text)])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens with one space between, as the file names no decoder; an unknown id gives nothing."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row; a null or empty text has no tokens.
    Whole texts are encoded; repeated rows stay; other columns are not read. An empty table gives no rows. The file at path is sent to the tasks."""
    kind, file = docs.schema[id_col].dataType.simpleString(), shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(in_task(file))
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                found = own.pieces(text.as_py())
                counts, numbers, names = zip(*found) if found else ((), (), ())
                n.append(sum(counts))
                ids.append(sha256(b" ".join(numbers)).hexdigest())
                decoded.append(sha256(b" ".join(names)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row, for training; a null text has no ids, an empty table gives no rows."""
    kind, file = docs.schema[id_col].dataType.simpleString(), shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(in_task(file))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # ids take more room than texts
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text, an empty table no rows."""
    kind, file = rows.schema[id_col].dataType.simpleString(), shipped(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(in_task(file))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op9_bpe_codec": op9_bpe_codec}
ORACLE: dict[str, str] = {}
