"""Operator 4: SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are compared in buckets that agree on two of four 16-bit blocks: with at most two
differing bits at least two blocks agree, so no link is lost. Inside a bucket the fingerprints are
stored as bit planes (lane i of plane j is bit j of fingerprint i). Distances of 64 lanes a word are
updated together with carry-save counters, and a block of 64 lanes is abandoned as soon as every lane that counts
is beyond the radius. A bucket of more than BUCKET fingerprints is not compared pairwise: its members
meet in the neighbourhoods of all fingerprints at distance one, which is exact for radius two, linear in the bucket
and done where the members are, so no task gathers a larger bucket.

simhash_similarity.py compares in the same way under another contract: five words, a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import group_runs, materialize, table, text_bytes
from folioscope.llm.components import connected_components, forest

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Largest bucket that is compared pair by pair, and the largest whose pairs are laid out side by side.
BUCKET, SMALL = 16_384, 64
LANES = 1 << 16
#: Blocks that are all beyond the radius leave after so many planes.
ABANDON = 4
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE = np.arange(8, dtype=np.int64) * 256
PIECE = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles (repeats count); 0 for a text without words or a null text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    total = len(words) - shingle + 1
    counts = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, total, PIECE):
        part = words[at : at + PIECE + shingle - 1]
        n = len(part) - shingle + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(shingle)))), repeat(SEED)), dtype=np.uint64, count=n)
        seen = np.bincount((hashes.view(np.uint8).reshape(n, 8) + BYTE).ravel(), minlength=2048).reshape(8, 256)
        counts += seen @ BITS
    return int(np.packbits(counts * 2 > total, axis=1, bitorder="little").ravel().view(np.uint64)[0])


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: row j packs bit j of all values, 64 lanes a word."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if pad := -len(values) % 64:
        bits = np.vstack([bits, np.zeros((pad, 64), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(plane: Callable[[int, np.ndarray], np.ndarray], use: list[int], beyond: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose distance is at most radius, as unpacked bits of each block.

    beyond has a word for each block of 64 lanes, with the lanes set that do not count; plane(j, blocks) gives the differing
    bits of plane j in those blocks. The counters start at 2^k - radius - 1, so a lane overflows exactly when its distance
    passes the radius. A block leaves when all its lanes are set.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - radius - 1
    live = np.flatnonzero(beyond != ALL)
    over = beyond[live]
    counter = [np.full(len(live), ALL if start >> i & 1 else 0, dtype=np.uint64) for i in range(width)]
    for step, j in enumerate(use):
        carry = plane(j, live)
        for c in counter:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if step % ABANDON == ABANDON - 1:
            stay = over != ALL
            if not stay.all():
                beyond[live] = over
                live, over, counter = live[stay], over[stay], [c[stay] for c in counter]
                if not len(live):
                    break
    beyond[live] = over
    return np.unpackbits((~beyond).view(np.uint8), bitorder="little").astype(bool)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs a[i], b[i] differ in at most radius bits; the lanes are pairs."""
    if not len(a):
        return np.zeros(0, bool)
    rows = planes(a ^ b)
    beyond = np.zeros(rows.shape[1], np.uint64)
    if pad := -len(a) % 64:
        beyond[-1] = ALL << np.uint64(64 - pad)
    return within(lambda j, live: rows[j][live], list(range(64)), beyond, radius)[: len(a)]


class Lanes:
    """Fingerprints of one bucket as bit planes, to be met by one query or by 64 at a time."""

    def __init__(self, f: np.ndarray):
        self.f, self.n, self.rows = f, len(f), planes(f)
        vary = int(np.bitwise_or.reduce(f ^ f[0])) if len(f) else 0
        self.use = [j for j in range(64) if vary >> j & 1]

    def met(self, queries: np.ndarray, out: np.ndarray, radius: int) -> np.ndarray:
        """(queries, lanes) that are at most radius apart; out are the lanes that do not count. The queries are of the bucket."""
        blocks = self.rows.shape[1]
        wide = np.ones((len(queries), blocks * 64), dtype=bool)
        wide[:, : self.n] = out
        beyond = np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()
        bits = [np.where((queries >> np.uint64(j)) & np.uint64(1), ALL, np.uint64(0)) for j in range(64)]
        found = within(lambda j, live: self.rows[j][live % blocks] ^ bits[j][live // blocks], self.use, beyond, radius)
        return found.reshape(len(queries), blocks * 64)[:, : self.n]


def _bucket_stars(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, least member of its group) of one bucket of distinct fingerprints; each pair is compared once."""
    n, lanes = len(f), Lanes(f)
    label, place = np.arange(n), np.arange(n)
    for at in range(0, n, 64):
        own = place[at : at + 64]
        hit = lanes.met(f[own], place[None, :] <= own[:, None], radius)
        for i in np.flatnonzero(hit.any(axis=1)):
            other = np.append(label[hit[i]], label[at + i])
            if (other != other[0]).any():
                label[np.isin(label, other)] = other.min()
    return place, label


def offset_pairs(starts: np.ndarray, sizes: np.ndarray, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs inside the buckets of at most small members, LANES at a time."""
    for d in range(1, small):
        own = np.flatnonzero((sizes > d) & (sizes <= small))
        if not len(own):
            return
        counts = sizes[own] - d
        first = np.repeat(starts[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        for at in range(0, len(first), LANES):
            yield first[at : at + LANES], first[at : at + LANES] + d


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, small: int) -> Iterator[pa.RecordBatch]:
    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for block in group_runs(batches, "key"):
        key, f = block["key"], block["fp"].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found: list[tuple[int, int]] = []
        for i, j in offset_pairs(starts, sizes, small):
            hit = pairs_within(f[i], f[j], radius)
            found += zip(f[i[hit]].view(np.int64).tolist(), f[j[hit]].view(np.int64).tolist())
        if found:
            stars = forest(found)
            yield out(np.array(list(stars.keys()), np.int64), np.array(list(stars.values()), np.int64))
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            g = f[s : s + n]
            member, label = _bucket_stars(g, radius)
            own = member != label
            if own.any():
                yield out(g[member[own]], g[label[own]])


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints(fp long) -> (u, v): links that span every group of fingerprints at most RADIUS bits apart."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(4), 2))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    heavy = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > BUCKET))
    small = SMALL
    dealt = keyed.join(heavy, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    light = dealt.mapInArrow(lambda it: _bucket_links(it, RADIUS, small), "u long, v long")
    # members of a heavy bucket that share a neighbour at distance one are at most two bits apart; a neighbour has 65 such members at most
    around = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = keyed.join(heavy, "key", "left_semi").select("fp").distinct().select(F.explode(around).alias("u"), F.col("fp").alias("v"))
    met = met.groupBy("u").agg(F.collect_set("v").alias("near"))
    return light.union(met.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u <> v"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row; repeated rows are repeated."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, fp long, component_id).

    Links join fingerprints that differ in at most RADIUS bits; component_id is the smallest id
    reachable. A null or empty text has fingerprint zero and is linked like any other. Repeated rows
    and equal ids stay as rows. A null id takes part, but is never a component_id unless the whole
    component has no other. An empty table gives an empty result. Other columns are not read, so
    clashing names do no harm.
    """
    prints = materialize(simhash(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    moved = connected_components(near_links(classes.select("fp")))
    rooted = classes.join(moved.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    linked = rooted.where("component is not null")
    roots = linked.select(F.col("component").alias("root")).distinct()
    least = rooted.join(roots, "root", "left_semi").groupBy("root").agg(F.min("least").alias("reached"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLE: dict[str, str] = {}
