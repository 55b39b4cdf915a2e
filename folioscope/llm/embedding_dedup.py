"""Operator 6: embedding near-duplicates by product quantisation.

Unit vectors are put into inverted lists by their nearest coarse centroid; what remains is coded by subspace. The number of
lists follows the number of vectors: beyond what a bounded sample can train, each list is divided by a second quantiser of the
residuals. A vector is compared in its own list and in the PROBES nearest of those lists whose border is near enough (its
probes): a neighbour within the radius lies beyond a border only if the border is that near. Inside a list,
table-lookup distances from the exact query to the coded vectors discard all but those within the radius
plus the coded vector's own quantisation error, which loses nothing; the rest are compared
by exact cosine in double precision. So only probing can miss a link, and probes=None probes every list that may hold one.
Equal vectors are one class with a count. Long lists are split into blocks, so a task holds one block and streams its
visitors; links are counted where they are found and only spanning links are sent on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, table
from folioscope.llm.components import connected_components

COSINE = 0.95
#: The index is fitted on at most SAMPLE vectors (those with the smallest hash) and SAMPLE_BYTES, in one task; all vectors are indexed.
SAMPLE, SAMPLE_BYTES, ROUNDS = 16_384, 64_000_000, 8
#: Vectors for each list that the number of lists aims at, sampled vectors for each centroid, lists that are probed besides the own.
PER_LIST, PER_CENTROID, PROBES = 256, 8, 8
SUBSPACES, CODES = 8, 32
#: Borders are near enough within so many standard deviations of a random neighbour's shift across a border; up to 16 dimensions that loses nothing.
DEVIATIONS = 4
BLOCK, BLOCK_BYTES, VISITORS = 4096, 16_000_000, 256


@dataclass
class Index:
    coarse: np.ndarray
    fine: np.ndarray  # of the residuals; a single zero if the coarse lists are not divided
    codebooks: np.ndarray  # (SUBSPACES, codes, width)
    dim: int

    def centre(self, cells: np.ndarray) -> np.ndarray:
        return self.coarse[cells // len(self.fine)] + self.fine[cells % len(self.fine)]

    def residual_parts(self, residual: np.ndarray) -> np.ndarray:
        m, _, width = self.codebooks.shape
        padded = np.zeros((len(residual), m * width))
        padded[:, : self.dim] = residual
        return padded.reshape(len(residual), m, width)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """(n, SUBSPACES, codes) squared distances of each residual part to each code."""
        parts = self.residual_parts(residual)
        return np.stack([((p[:, None, :] - book[None]) ** 2).sum(-1) for p, book in zip(parts.transpose(1, 0, 2), self.codebooks)], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(-2 * part @ centres.T + (centres**2).sum(1)).argmin(1) for part in np.array_split(x, max(1, len(x) * len(centres) // 4_000_000))])


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(x: np.ndarray, total: int, seed: int = 3) -> Index:
    """Index from sampled unit vectors; the number of lists follows the number of all vectors."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    wanted, most = max(1, total // PER_LIST), max(1, min(len(x) // PER_CENTROID, 32_000_000 // (8 * dim)))
    coarse = _means(x, min(wanted, most), rng)
    residual = x - coarse[_nearest(x, coarse)]
    fine = np.zeros((1, dim))
    if wanted > len(coarse):
        fine = _means(residual, min(ceil(wanted / len(coarse)), most), rng)
        residual = residual - fine[_nearest(residual, fine)]
    m = min(SUBSPACES, dim)
    width = -(-dim // m)
    padded = np.zeros((len(x), m * width))
    padded[:, :dim] = residual
    books = [_means(np.ascontiguousarray(padded[:, i * width : (i + 1) * width]), CODES, rng) for i in range(m)]
    return Index(coarse, fine, np.stack(books), dim)


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded to dim, and their lengths; scaled first, so that norms neither overflow nor vanish."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True)), size


def probes(x: np.ndarray, index: Index, radius: float, most: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own list of each vector, and the other lists near enough to hold a neighbour within the radius: the nearest most, or all for None."""
    k, parts = len(index.fine), len(index.coarse)
    reach = radius if most is None else min(radius, DEVIATIONS * radius / sqrt(index.dim))
    square = -2 * x @ index.coarse.T + (index.coarse**2).sum(1)
    tried = parts if most is None or k == 1 else min(parts, 4 * most)
    top = np.argpartition(square, tried - 1, axis=1)[:, :tried] if tried < parts else np.broadcast_to(np.arange(parts), square.shape)
    far = np.take_along_axis(square, top, 1)[:, :, None] - 2 * (x @ index.fine.T)[:, None, :] + 2 * (index.coarse @ index.fine.T)[top] + (index.fine**2).sum(1)
    cells, far = (top[:, :, None] * k + np.arange(k)).reshape(len(x), -1), far.reshape(len(x), -1)
    if most is not None and most + 1 < far.shape[1]:
        near = np.argpartition(far, most, axis=1)[:, : most + 1]
        cells, far = np.take_along_axis(cells, near, 1), np.take_along_axis(far, near, 1)
    own = np.lexsort((cells, far), axis=1)[:, 0]
    row = np.arange(len(x))
    home = cells[row, own]
    centre = index.centre(home)
    apart = np.sqrt(np.maximum(((index.centre(cells.ravel()).reshape(*cells.shape, -1) - centre[:, None]) ** 2).sum(-1), 0))
    border = (far - far[row, own][:, None]) <= 2 * reach * apart + 1e-12
    border[row, own] = False
    return home, [c[b] for c, b in zip(cells, border)]


def _assign(batches: Iterator[pa.RecordBatch], shared, radius: float, most: int | None) -> Iterator[pa.RecordBatch]:
    index = shared.value
    lists = len(index.coarse) * len(index.fine)
    tried = lists if most is None or len(index.fine) == 1 else min(lists, 4 * most * len(index.fine))
    step = max(1, min(2000, 8_000_000 // max(tried, (tried if most is None else most + 1) * index.dim)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            home, other = probes(unit(part.column(1), index.dim)[0], index, radius, most)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int64()), pa.array(other, pa.list_(pa.int64()))], ["cid", "embedding", "n", "home", "visits"])


class _Rows:
    """Vectors of one block: members, or some of its visitors."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.cid, self.n, self.home = (batch.column(c).to_numpy() for c in ("cid", "n", "home"))
        self.x, self.size = unit(batch.column("embedding"), dim)
        visits = batch.column("visits")
        count = visits.value_lengths().to_numpy(zero_copy_only=False)
        self.visits = np.full((len(count), max(1, int(count.max(initial=0)))), -1, dtype=np.int64)
        self.visits[np.arange(self.visits.shape[1]) < count[:, None]] = visits.flatten().to_numpy(zero_copy_only=False)


class _Block:
    """A block of one list: coded members, their link counts and the groups they are in so far."""

    def __init__(self, cell: int, index: Index, radius: float, cosine: float):
        self.cell, self.index, self.radius, self.cosine = cell, index, radius, cosine
        self.parts: list[_Rows] = []
        self.ready = False

    def prepare(self) -> None:
        self.ready = True
        joined = lambda name: np.concatenate([getattr(p, name) for p in self.parts])
        self.cid, self.n, self.x, self.size = joined("cid"), joined("n"), joined("x"), joined("size")
        widest = max(p.visits.shape[1] for p in self.parts)
        self.visits = np.concatenate([np.pad(p.visits, ((0, 0), (0, widest - p.visits.shape[1])), constant_values=-1) for p in self.parts])
        self.parts = []
        self.centre = self.index.centre(np.array([self.cell]))
        residual = self.x - self.centre
        self.codes = np.concatenate([self.index.tables(residual[at : at + VISITORS]).argmin(-1) for at in range(0, len(residual), VISITORS)])
        books = np.stack([b[self.codes[:, i]] for i, b in enumerate(self.index.codebooks)], axis=1)
        self.error = np.sqrt(((self.index.residual_parts(residual) - books) ** 2).sum((1, 2)))
        self.links = np.zeros(len(self.cid), dtype=np.int64)
        self.label = np.arange(len(self.cid))
        place = np.arange(len(self.cid))
        for at in range(0, len(place), VISITORS):
            q = place[at : at + VISITORS]
            i, j = self.near(self.x[q], self.size[q], place[None, :] > q[:, None])
            np.add.at(self.links, q[i], self.n[j])
            np.add.at(self.links, j, self.n[q[i]])
            for k, hits in self._by_query(i, j):
                self._join(np.append(hits, q[k]))

    def near(self, q: np.ndarray, sizes: np.ndarray, allowed: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs with the cosine or more among the allowed ones, in order of the queries."""
        table = self.index.tables(q - self.centre)
        distance = sum(table[:, i][:, self.codes[:, i]] for i in range(table.shape[1]))
        i, j = np.nonzero((np.sqrt(distance) <= self.radius + self.error + 1e-9) & allowed & (sizes[:, None] == self.size))
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 50_000):
            s = slice(at, at + 50_000)
            keep[s] = np.einsum("ij,ij->i", q[i[s]], self.x[j[s]]) >= self.cosine
        return i[keep], j[keep]

    @staticmethod
    def _by_query(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for a, hits in zip(begin, np.split(j, begin[1:])):
            yield int(i[a]), hits

    def _join(self, hits: np.ndarray) -> None:
        found = self.label[hits]
        if (found != found[0]).any():
            self.label[np.isin(self.label, found)] = found.min()

    def visit(self, rows: _Rows, at: int) -> pa.RecordBatch:
        s = slice(at, at + VISITORS)
        i, j = self.near(rows.x[s], rows.size[s], True)
        home = rows.home[s][i]
        # a link that both ends can find is counted in the list of the smaller number
        own = ~((home < self.cell) & (self.visits[j] == home[:, None]).any(axis=1))
        i, j = i[own], j[own]
        np.add.at(self.links, j, rows.n[s][i])
        counts, first = np.zeros(len(rows.cid[s]), dtype=np.int64), np.zeros(len(rows.cid[s]), dtype=np.int64)
        np.add.at(counts, i, self.n[j])
        for k, hits in self._by_query(i, j):
            first[k] = hits[0]
            self._join(hits)
        met = np.flatnonzero(counts)
        return _found(rows.cid[s][met], counts[met], self.cid[first[met]])

    def finish(self) -> pa.RecordBatch:
        if not self.ready:
            self.prepare()
        met = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        return _found(self.cid[met], self.links[met], self.cid[self.label[met]])


def _found(cid: np.ndarray, links: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cid, links, near)], ["cid", "links", "near"])


def _compare(batches: Iterator[pa.RecordBatch], shared, radius: float, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of list, block and kind (0 member, 1 visitor) -> (cid, links found, a cid it is connected with)."""
    index = shared.value
    now: tuple | None = None
    block: _Block | None = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "kind")], axis=1)
        begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
        for a, b in zip(begin, np.r_[begin[1:], len(key)].astype(int)):
            cell, part, kind = key[a].tolist()
            if now != (cell, part):
                if block is not None:
                    yield block.finish()
                now, block = (cell, part), None
            if kind == 0:
                block = block or _Block(cell, index, radius, cosine)
                block.parts.append(_Rows(batch.slice(a, b - a), index.dim))
            elif block is not None:
                if not block.ready:
                    block.prepare()
                for at in range(a, b, VISITORS):
                    rows = _Rows(batch.slice(at, min(VISITORS, b - at)), index.dim)
                    yield block.visit(rows, 0)
    if block is not None:
        yield block.finish()


VALID = "size({0}) > 0 and forall({0}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({0}, x -> x <> 0)"


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int | None = PROBES) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    n_links: other vectors linked directly (copies included). Null, empty and zero vectors and those with
    null or non-finite components link with nothing, vectors of different lengths neither; each is its own
    component. probes: how many lists besides its own a vector is compared in; None loses no link. Repeated ids stay as rows; a null id is never a component_id unless it stands alone. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    radius = sqrt(2 - 2 * cosine)
    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")).withColumn("ok", F.coalesce(F.expr(VALID.format("embedding")), F.lit(False)))
    classes = source.where("ok").groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "embedding", "n", "least"))
    total, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return rows.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    take = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    # a share of the hashes that holds enough vectors, so that the first of them are found among about as many as are taken
    rank = F.pmod(F.xxhash64("embedding"), F.lit(1 << 31))
    share = int(min(1.0, 1.5 * take / total) * (1 << 31)) + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = np.concatenate([unit(batch.column(0), dim)[0] for batch in batches])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample, total))], pa.binary())], ["index"])

    sample = classes.where(rank < share).orderBy(rank, "cid").limit(take).select("embedding")
    shared = spark.sparkContext.broadcast(pickle.loads(sample.mapInArrow(train, "index binary").first()["index"]))  # bounded by the sample
    vector = classes.schema["embedding"].dataType.simpleString()
    placed = materialize(classes.select("cid", "embedding", "n").mapInArrow(lambda it: _assign(it, shared, radius, probes), f"cid long, embedding {vector}, n long, home long, visits array<long>"))
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    lengths = materialize(placed.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    own = placed.join(lengths, "home").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    columns = ["cell", "block", "kind", "cid", "embedding", "n", "home", "visits"]
    members = own.select(F.col("home").alias("cell"), F.col("own").alias("block"), F.lit(0).alias("kind"), "cid", "embedding", "n", "home", "visits")
    none = F.array().cast("array<long>").alias("visits")
    inside = own.where("own + 1 < blocks").select(F.col("home").alias("cell"), F.explode(F.expr("sequence(own + 1, blocks - 1)")).alias("block"), F.lit(1).alias("kind"), "cid", "embedding", "n", "home", none)
    calls = placed.select("cid", "embedding", "n", "home", F.explode("visits").alias("cell"))
    across = calls.join(lengths.select(F.col("home").alias("cell"), "blocks"), "cell").select("cell", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("kind"), "cid", "embedding", "n", "home", none)
    work = members.unionByName(inside).unionByName(across).select(columns)
    dealt = work.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = materialize(dealt.mapInArrow(lambda it: _compare(it, shared, radius, cosine), "cid long, links long, near long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    moved = connected_components(found.select("cid", "near")).withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "least", "n", "embedding").join(moved, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    rooted = materialize(rooted)
    # summed in the tasks first; the roots' own rows are met by their unique cid
    linked = rooted.where("component is not null")
    roots = linked.select(F.col("component").alias("cid")).distinct()
    own = rooted.join(roots, "cid", "left_semi").select(F.col("cid").alias("root"), "least")
    least = linked.select("root", "least").union(own).groupBy("root").agg(F.min("least").alias("reached"))
    named = rooted.join(least, "root", "left").select(F.col("embedding").alias("_vector"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("reached", "least").alias("reached"))
    joined = source.join(named, F.col("ok") & (F.col("embedding") == F.col("_vector")), "left")
    component = F.coalesce("reached", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op6_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_pq_near_dedup": op6_pq_near_dedup}
ORACLE: dict[str, str] = {}
