"""Operator 10: language-model scores by a probabilistic suffix tree over words.

The tree's nodes are contexts of one to DEPTH words. A context that occurs LEAST times is a candidate and is retained by a
divergence test: the evidence, in nats, that its next words are not distributed as after its suffix. A retained context holds
discounted probabilities of the next words that passed the test; what is left goes to its suffix's distribution over
the others, so every state's distribution sums to one. The root is the smoothed unigram distribution over all words.
A token is scored from the longest retained suffix of what precedes it.

All counts cover all training documents, and thresholds are the same at every size, so the tree grows with the corpus. It is a
set of Spark tables. Level by level, runs of words whose two shorter parts are frequent (by a bitmap of bounded size) are first counted as
packed short hashes, only to see which can be frequent; those alone are counted exactly, as pairs of their context and suffix,
of which a run's own hash is made, joined with both on the level below and tested. Scoring looks up the LOOKUP most frequent contexts, entries and
words in the tasks and asks the others' tables for any other, with the same result: what a context or an entry adds to its token's gain
does not depend on what else is found, so a question is a key and a document, and questions travel as packed blocks. Words and runs of words are
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import wordhash
from folioscope.llm.common import bitmap, in_bitmap, materialize, noted_cuts, release, spread_if_few, table

DEPTH = 3
#: Occurrences that a context and an entry (context and next word) must have, at every size of the corpus.
LEAST = 3
#: Nats: an entry's gain over the suffix's distribution, and a context's in all.
ENTRY_GAIN, CONTEXT_GAIN, DISCOUNT = 3.0, 8.0, 0.75
#: Contexts and entries, and words, that tasks look up themselves; the rest is joined.
LOOKUP, WORDS = 1_000_000, 300_000
#: Bits of the bitmaps of frequent runs and of those beyond LOOKUP: 32 for each within these bounds (8 MB at most).
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 26, 32
#: A key beyond LOOKUP sets a bit for each of these rotations of its hash, while that leaves most bits unset.
ROTATIONS = (0, 21, 42)
#: A frequent run sets a bit for its hash and one for its hash turned by so many bits: the MOST_BITS from there on are known of a packed hash too.
TURN = 12
#: Hash of the end token, and the mark of a run that would begin before its document.
END, NONE = np.uint64(0x5851F42D4C957F2D), np.uint64(0)
#: Rows that a task holds before it sums them.
HELD = 3_000_000
#: Questions that a task holds before it packs them, and sums of documents before it puts them together.
ASKED = 1 << 20
CONTEXT, ENTRY, WORD = range(3)
#: Tokens for each bucket that packed hashes are dealt to (by their leading bits); in a bucket 32 more bits tell them apart.
BUCKET_TOKENS, BUCKET_BITS = 1 << 20, (6, 16)


@dataclass
class Known:
    """Sorted keys with their values, and the bitmap of the keys that are not among them (None if these are all)."""

    keys: np.ndarray
    value: np.ndarray
    others: tuple[tuple[np.ndarray, int], tuple[int, ...]] | None
    own: tuple[np.ndarray, int] = field(init=False)
    place: tuple[np.ndarray, int] = field(init=False)

    def __post_init__(self) -> None:
        bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * len(self.keys)).bit_length()))
        at = self.keys >> np.uint64(64 - bits)  # ascending, as the keys are
        word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        words, edge = np.zeros(1 << (bits - 6), np.uint64), np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        if len(edge):
            words[word[edge]] = np.bitwise_or.reduceat(mask, edge)
        self.own = words, bits
        bits = max(1, len(self.keys).bit_length())
        starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        self.place = np.searchsorted(self.keys, starts).astype(np.int32), bits  # where the keys with these leading bits begin
        self.keys = np.append(self.keys, ~NONE)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Value of each wanted key, not a number where it is not known."""
        out = np.full(len(wanted), np.nan)
        at = np.flatnonzero(in_bitmap(self.own, wanted))
        if len(at):
            at = at[wanted[at] != NONE]
            own = wanted[at]
            place = self.place[0][own >> np.uint64(64 - self.place[1])]
            while len(at):
                key = self.keys[place]
                hit = np.flatnonzero((key == own) & (place < len(self.value)))
                out[at[hit]] = self.value[place[hit]]
                on = np.flatnonzero(key < own)
                at, own, place = at[on], own[on], place[on] + 1
        return out

    def maybe(self, wanted: np.ndarray) -> np.ndarray:
        """Keys that may be among the others."""
        out = np.full(len(wanted), self.others is not None) & (wanted != NONE)
        for rotation in self.others[1] if self.others else ():
            at = np.flatnonzero(out)
            out[at] = in_bitmap(self.others[0], _turned(wanted[at], rotation))
        return out


@dataclass
class Tree:
    """words(h, n), contexts(key, value, n) and entries(key, value, added, n): a context's value is log10 of the factor of its suffix's
    distribution, an entry's log10 of its probability over the root's; added: over what it would have without the entry, which is
    its context's factor times its probability after the suffix."""

    words: DataFrame
    contexts: DataFrame
    entries: DataFrame
    tokens: int
    vocabulary: int


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, token hashes, first token of each document) of slices of a text column; every document has an end token."""
    for words in wordhash.hashed(column, fold=wordhash.WHITE):
        yield words.lo, words.hi, np.insert(words.hash, words.first[1:], END), words.first + np.arange(len(words.first))


def joined_run(context: np.ndarray, suffix: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the runs of depth + 1 tokens whose first and last depth tokens have these hashes."""
    return wordhash.mixed(context * np.uint64(wordhash.BASE) + suffix + np.uint64(depth))


def runs(h: np.ndarray, first: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the runs of 1 to longest tokens that end at each token, NONE where the document does not reach back so far."""
    at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = [h]
    for k in range(1, longest):
        run = np.zeros_like(h)
        run[1:] = joined_run(out[-1][:-1], out[-1][1:], k)
        run[at < k] = NONE
        out.append(run)
    return out


def before(run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The run that ends one token earlier, NONE at the start of a document."""
    out = np.empty_like(run)
    out[1:] = run[:-1]
    out[first[:-1]] = NONE
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, n in _summed((h,) for batch in batches for _, _, h, _ in tokens(batch.column(0))):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by) if by else h


def _turned_column(by: int) -> Column:
    return F.shiftleft("key", by).bitwiseOR(F.shiftrightunsigned("key", 64 - by)) if by else F.col("key")


def _bits(rows: DataFrame, rotations: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """One bitmap of all keys, each with a bit for each rotation."""
    parts = (bitmap(rows.select(_turned_column(by).alias("h")), LEAST_BITS, MOST_BITS, BITS_EACH) for by in rotations)
    words, bits = next(parts)
    for more, _ in parts:
        words |= more
    return words, bits


def _passes(frequent: tuple[np.ndarray, int], h: np.ndarray) -> np.ndarray:
    own = in_bitmap(frequent, h)
    own[own] = in_bitmap(frequent, _turned(h[own], TURN))
    return own


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte, so that bytes that seldom differ compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _count_runs(batches: Iterator[pa.RecordBatch], depth: int, frequent, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of depth + 1 tokens whose two shorter parts pass the bitmap, packed: (bucket, low, n) with the ascending hashes of a bucket
    as differences, byte by byte, and counts of 255 at most."""

    def met() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, _, h, first in tokens(batch.column(0)):
                run = runs(h, first, depth + 1)
                passed = _passes(frequent.value, run[depth - 1])
                own = (run[depth] != NONE) & passed & np.r_[False, passed[:-1]]
                yield (run[depth][own],)

    for key, n in _summed(met()):
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        low = ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        step = np.diff(low, prepend=np.uint32(0))
        step[edge] = low[edge]
        counts = np.minimum(n, 255).astype(np.uint8)
        ends = np.r_[edge[1:], len(key)]
        packed = [_planes(step[a:b]) for a, b in zip(edge.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(packed, pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(edge.tolist(), ends.tolist())], pa.binary())], ["bucket", "low", "n"])


def _frequent(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Packed counts sorted by bucket -> the hashes (leading bits only) that occur `least` times."""

    def out(bucket: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        low = np.concatenate([np.cumsum(_unplaned(x, np.uint32), dtype=np.uint32) for x, _ in held])
        value, back = np.unique(low, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([np.frombuffer(c, np.uint8) for _, c in held]))
        key = (np.uint64(bucket) << np.uint64(64 - bits)) | (value[n >= least].astype(np.uint64) << np.uint64(32 - bits))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    last, held = -1, []
    for batch in batches:
        for bucket, low, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != last and held:
                yield out(last, held)
                held = []
            last = bucket
            held.append((low, n))
    if held:
        yield out(last, held)


def _parts(batches: Iterator[pa.RecordBatch], depth: int, frequent) -> Iterator[pa.RecordBatch]:
    """(context, suffix, n): counts of the runs of depth + 1 tokens that pass the bitmap."""

    def met() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, _, h, first in tokens(batch.column(0)):
                run = runs(h, first, depth + 1)
                own = np.flatnonzero((run[depth] != NONE) & _passes(frequent.value, run[depth]))
                yield run[depth][own], before(run[depth - 1], first)[own], run[depth - 1][own]

    for _, context, suffix, n in _summed(met()):
        yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(n)], ["context", "suffix", "n"])


def _summed(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (key, what belongs to the key) -> the same in the order of keys with a count, summed in the task as far as HELD rows reach."""
    held: list[tuple[np.ndarray | None, ...]] = []  # the count last, none for rows that are still single
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*(part[:-1] for part in held))]
        edges = lambda key: np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        if len(columns) == 1 and all(part[-1] is None for part in held):  # sorting without an order is several times cheaper
            key = np.sort(columns[0])
            edge = edges(key)
            return key[edge], np.diff(edge, append=len(key))
        n = np.concatenate([np.ones(len(part[0]), np.int64) if part[-1] is None else part[-1] for part in held])
        order = np.argsort(columns[0])
        key = columns[0][order]
        edge = edges(key)
        return (key[edge], *(c[order[edge]] for c in columns[1:]), np.add.reduceat(n[order], edge))

    for part in parts:
        held.append((*part, None))
        size += len(part[0])
        if size > HELD:
            held[:] = [joined()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield held.pop()
                size = 0
    if size:
        yield joined()


def _with_key(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(context, suffix, n, ...) -> (key, context, n, ...)."""
    for batch in batches:
        context, suffix = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(joined_run(context, suffix, depth).view(np.int64)), batch.column(0), *batch.columns[2:]], ["key", "context", *batch.schema.names[2:]])


def fit(docs: DataFrame, text_col: str = "text") -> Tree:
    """Suffix tree of all given documents; null texts count as empty, repeated rows count as often as they occur."""
    with noted_cuts() as cuts:
        tree = _fitted(docs.select(text_col))
    kept = (tree.words, tree.contexts, tree.entries)
    release(*(c for c in cuts if all(c is not k for k in kept)))
    return tree


def _fitted(texts: DataFrame) -> Tree:
    spark = texts.sparkSession
    words = materialize(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    vocabulary, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = lambda rows: spark.sparkContext.broadcast(_bits(rows, (0, TURN)))
    below = words.where(F.col("n") >= LEAST).withColumn("p", (F.col("n") + 0.5) / F.lit(total + 0.5 * (vocabulary + 1))).withColumn("base", F.col("p"))
    frequent = spread(below)
    bits, least = _bucket_bits(total), LEAST
    contexts, entries = [], []
    for depth in range(1, DEPTH + 1):
        packed = texts.mapInArrow(lambda it, depth=depth, frequent=frequent: _count_runs(it, depth, frequent, bits), "bucket int, low binary, n binary")
        likely = materialize(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _frequent(it, bits, least), "key long"))
        frequent.destroy()
        frequent = spread(likely)
        release(likely)
        counted = texts.mapInArrow(lambda it, depth=depth, frequent=frequent: _parts(it, depth, frequent), "context long, suffix long, n long").groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        met = counted.join(below.select(F.col("key").alias("context"), F.col("n").alias("total")), "context").join(below.select(F.col("key").alias("suffix"), F.col("p").alias("less"), "base"), "suffix")
        met = materialize(met.select("context", "suffix", "n", "total", "less", "base").mapInArrow(lambda it, depth=depth: _with_key(it, depth), "key long, context long, n long, total long, less double, base double"))
        gain = F.when(F.col("n") / F.col("total") > F.col("less"), F.col("n") * F.log(F.col("n") / F.col("total") / F.col("less"))).otherwise(0.0)
        met = met.withColumn("gain", gain).withColumn("own", (F.col("n") - DISCOUNT) / F.col("total"))
        strong = met.where(F.col("gain") > ENTRY_GAIN).groupBy("context").agg(F.sum("gain").alias("gain"), F.sum("own").alias("mass"), F.sum("less").alias("lower"), F.max("total").alias("n"))
        rest = F.greatest(1 - F.col("mass"), F.lit(1e-12)) / F.greatest(1 - F.col("lower"), F.lit(1e-12))
        kept = materialize(strong.where(F.col("gain") > CONTEXT_GAIN).select("context", rest.alias("rest"), "n"))
        stands = (F.col("gain") > ENTRY_GAIN) & F.col("rest").isNotNull()
        p = F.when(stands, F.col("own")).when(F.col("rest").isNotNull(), F.col("rest") * F.col("less")).otherwise(F.col("less"))
        below = met.join(spread_if_few(kept.select("context", "rest")), "context", "left").select("key", "n", p.alias("p"), "base", stands.alias("stands"), F.log10(F.col("own") / F.col("rest") / F.col("less")).alias("added"))
        contexts.append(kept.select(F.col("context").alias("key"), F.log10("rest").alias("value"), "n"))
        entries.append(below.where("stands").select("key", F.log10(F.col("p") / F.col("base")).alias("value"), "added", "n"))
    frequent.destroy()
    return Tree(words, _union(contexts), _union(entries), total, vocabulary)


def _bucket_bits(total: int) -> int:
    return min(BUCKET_BITS[1], max(BUCKET_BITS[0], (total // BUCKET_TOKENS).bit_length()))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return materialize(whole)


def _looked_up(rows: DataFrame, value: Column, most: int, screened: bool = True) -> tuple[Known, DataFrame]:
    """The most frequent of rows(key, n, ...) with their value, and the other rows."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["keys"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).collect()), reverse=True)
    reached = [s for (s, _), total in zip(sizes, np.cumsum([k for _, k in sizes])) if total <= most]
    least = reached[-1] if reached else 1 << 62
    top = rows.where(step >= least).select("key", value.alias("value")).toArrow()  # so many rows at most
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    others = rows.where(step < least)
    return Known(key[order], top.column("value").to_numpy()[order], _screen(others) if screened and len(reached) < len(sizes) else None), others


def _screen(others: DataFrame) -> tuple[tuple[np.ndarray, int], tuple[int, ...]]:
    """Bitmap of the others, and the rotations of a hash that have a bit in it."""
    rotations = ROTATIONS if others.count() * len(ROTATIONS) <= 1 << MOST_BITS else ROTATIONS[:1]
    return _bits(others, rotations), rotations


def gains(contexts: Known, entries: Known, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """log10 P(token | longest state) - log10 P(token | root) of each token as far as it is known here, and what the others may change:
    (2 * depth, or one more for an entry; tokens; their keys; what an entry would replace of the gain).

    From the longest context down, as an entry makes all shorter ones of its token irrelevant, known or not. Only retained contexts have entries."""
    run = runs(h, first, DEPTH + 1)
    gain, left, asked = np.zeros(len(h)), np.arange(len(h)), []
    for depth in range(DEPTH, 0, -1):
        context, entry = before(run[depth - 1], first)[left], run[depth][left]
        rest = contexts.find(context)
        unknown = np.isnan(rest)
        may = np.zeros(len(left), bool)
        may[unknown] = contexts.maybe(context[unknown])
        held = np.flatnonzero(~unknown | may)
        own = np.full(len(left), np.nan)
        own[held] = entries.find(entry[held])
        ended = ~np.isnan(own)
        may &= ~ended
        asked.append((2 * depth, left[may], context[may], np.zeros(0)))
        held = held[~ended[held]]
        held = held[entries.maybe(entry[held])]
        asked.append((2 * depth + 1, left[held], entry[held], gain[left[held]]))
        gain[left] += np.where(ended, own, np.where(unknown, 0, rest))
        left = left[~ended]
    return gain, [(at, token, key, gain[token] - deeper if at % 2 else np.zeros(len(token))) for at, token, key, deeper in asked if len(token)]


def _blocks(kind: int, key: np.ndarray, own: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket of this kind, its ascending keys as differences, what belongs to each of them)."""
    order = np.argsort(key)
    key, own = key[order], own[order]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(key)])
    step = np.diff(key, prepend=NONE)
    step[edge] = key[edge]
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)]):
        yield int(bucket[a]) << 2 | kind, _planes(step[a:b]), _planes(own[a:b])


BLOCK = "bucket int, row long, keys binary, own binary"


def _tree_blocks(batches: Iterator[pa.RecordBatch], kind: int, bits: int) -> Iterator[pa.RecordBatch]:
    """key, value -> blocks with row -1."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        key, value = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        held.clear()
        bucket, keys, own = zip(*_blocks(kind, key.view(np.uint64), value, bits))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), -1)), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], ["bucket", "row", "keys", "own"])

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > ASKED:
            yield out()
            size = 0
    if held:
        yield out()


ROW = "row long, held_out boolean, n_tokens long, known long, value double, gain double, bucket int, keys binary, own binary"


def _score(batches: Iterator[pa.RecordBatch], shared, unseen: float, bits: int) -> Iterator[pa.RecordBatch]:
    """id, text, held_out -> documents (no bucket) with their sums as far as they are known here, and blocks of questions: keys that may be
    among the others, each with its document, counted from the block's row. Words that are not known here count as unseen."""
    words, contexts, entries = shared.value
    row = base = TaskContext.get().partitionId() << 40
    types = {"bool": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    names = {name: types.get(kind, pa.int64()) for name, kind in (f.split() for f in ROW.replace("boolean", "bool").split(", "))}
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

    def out(n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in (names | {"id": id_type}).items()], [*names, "id"])

    def questions(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(held):
            if parts:
                bucket, keys, own = zip(*_blocks(kind, *(np.concatenate(c) for c in zip(*parts)), bits))
                parts.clear()
                yield out(len(bucket), id_type, row=pa.array(np.full(len(bucket), base)), bucket=pa.array(bucket, pa.int32()), keys=pa.array(keys, pa.binary()), own=pa.array(own, pa.binary()))

    size, id_type = 0, None
    for batch in batches:
        id_type = batch.column(0).type
        for lo, hi, h, first in tokens(batch.column(1)):
            value = words.find(h)
            rare = np.isnan(value)
            gain, asked = gains(contexts, entries, h, first)
            sums = [np.add.reduceat(x, first[:-1]) for x in (np.where(rare, unseen, value), gain, (~rare).astype(np.int64))]
            yield out(hi - lo, id_type, row=pa.array(row + np.arange(hi - lo)), id=batch.column(0).slice(lo, hi - lo), held_out=batch.column(2).slice(lo, hi - lo), n_tokens=pa.array(np.diff(first)), known=pa.array(sums[2]), value=pa.array(sums[0]), gain=pa.array(sums[1]))
            doc = np.repeat(np.arange(row - base, row - base + hi - lo, dtype=np.uint32), np.diff(first))
            for kind, key, where in [(WORD, h[rare], np.flatnonzero(rare)), *((ENTRY if at % 2 else CONTEXT, key, token) for at, token, key, _ in asked)]:
                if len(key):
                    held[kind].append((key, doc[where]))
                    size += len(key)
            row += hi - lo
            if size > ASKED:
                yield from questions(id_type)
                size, base = 0, row
    if size:
        yield from questions(id_type)


FOUND = "row long, doc binary, known binary, value binary, gain binary"
SUMS = (np.int64, np.float64, np.float64)


def _together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Documents with sums -> the same, each document once."""
    doc, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return doc, *(np.bincount(back, weights=np.concatenate([x[k + 1] for x in parts])).astype(t) for k, t in enumerate(SUMS))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket, the tree's before the questions -> what the keys that are found add to their documents, packed."""
    last, tree, key, value, held, size = -1, [], None, None, {}, 0

    def out() -> pa.RecordBatch:
        packed = [[_planes(x) for x in _together(parts)] for parts in held.values()]
        rows = pa.array(list(held), pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([rows, *(pa.array(c, pa.binary()) for c in zip(*packed))], [f.split()[0] for f in FOUND.split(", ")])

    for batch in batches:
        for bucket, row, keys, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if bucket != last:
                last, tree, key = bucket, [], None
            keys = np.cumsum(_unplaned(keys, np.uint64), dtype=np.uint64)
            if row < 0:
                tree.append((keys, _unplaned(own, np.float64)))
                continue
            if not tree:
                continue
            if key is None:
                key, value = (np.concatenate(c) for c in zip(*tree))
                order = np.argsort(key)
                key, value = key[order], value[order]
            place = np.minimum(np.searchsorted(key, keys), len(key) - 1)
            hit = np.flatnonzero(key[place] == keys)
            doc, added, none = _unplaned(own, np.uint32)[hit], value[place[hit]], np.zeros(len(hit))
            if len(hit):
                part = (doc, none + 1, added, none) if bucket & 3 == WORD else (doc, none, none, added)
                held.setdefault(row, []).append(_together([part]))
                size += len(held[row][-1][0])
            if size > ASKED:
                yield out()
                size = 0
    if held:
        yield out()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums sorted by row -> row, known, value, gain of each document."""

    def out(row: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, *sums = _together(parts)
        return pa.RecordBatch.from_arrays([pa.array(row + doc.astype(np.int64)), *map(pa.array, sums)], ["row", "known", "value", "gain"])

    last, held = -1, []
    for batch in batches:
        for row, *packed in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if row != last and held:
                yield out(last, held)
                held = []
            last = row
            held.append(tuple(_unplaned(x, t) for x, t in zip(packed, (np.uint32, *SUMS))))
    if held:
        yield out(last, held)


def scored(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", held_out: str = "held_out") -> DataFrame:
    """One row per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words and one end; a null or empty text is its end alone. Repeated rows stay; the
    other columns are not read. With no training text every token has the same probability. An empty table gives an empty result.
    """
    whole = tree.tokens + 0.5 * (tree.vocabulary + 1)
    unseen, bits = float(np.log10(0.5 / whole)), _bucket_bits(tree.tokens)
    words, other_words = _looked_up(tree.words, F.log10((F.col("n") + 0.5) / F.lit(whole)), WORDS, screened=False)  # every other word is asked for
    contexts, other_contexts = _looked_up(tree.contexts, F.col("value"), LOOKUP)
    entries, other_entries = _looked_up(tree.entries, F.col("value"), LOOKUP)
    shared = docs.sparkSession.sparkContext.broadcast((words, contexts, entries))  # LOOKUP keys and a bitmap each
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(docs.select(id_col, text_col, held_out).mapInArrow(lambda it: _score(it, shared, unseen, bits), f"{ROW}, id {id_type}"))
    shared.destroy()
    documents = rows.where("bucket is null")
    blocks = rows.where("bucket is not null").select("bucket", "row", "keys", "own")
    for kind, others in ((CONTEXT, other_contexts.select("key", "value")), (ENTRY, other_entries.select("key", "added")), (WORD, other_words.select("key", F.log10(2 * F.col("n") + 1)))):  # over an unseen word's
        blocks = blocks.union(others.mapInArrow(lambda it, kind=kind: _tree_blocks(it, kind, bits), BLOCK))
    found = blocks.repartition("bucket").sortWithinPartitions("bucket", "row").mapInArrow(_found, FOUND)
    found = found.repartition("row").sortWithinPartitions("row").mapInArrow(_added, "row long, known long, value double, gain double")
    totals = documents.select("row", "known", "value", "gain").union(found)
    totals = totals.groupBy("row").agg(F.sum("known").alias("n_known"), F.sum("value").alias("base_score"), F.sum("gain").alias("gain"))
    documents = documents.select("row", F.col("id").alias(id_col), "held_out", "n_tokens")
    return documents.join(totals, "row").select(id_col, "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold.alias("held_out"))
    return scored(docs, fit(docs.where("not held_out")))


QUERIES = {"op10_suffix_tree_scores": op10_suffix_tree_scores}
ORACLE: dict[str, str] = {}
