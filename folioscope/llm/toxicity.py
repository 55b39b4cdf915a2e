"""Operator 8: toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its leading bytes, so inflected and
compounded insults share weights. Filters of several widths run over segments of SEGMENT words; each
filter is max-pooled in a segment, and a document is described by the maximum over its segments (is
there any?) and by their mean (how dense?). All weights start at random and are learnt from the labels by
the network alone, from every labelled document. One task makes a first model of a bounded sample (at most SAMPLE
labelled documents of each class, those with the smallest hash, while they fit in SAMPLE_CHARS, reweighted to the
true class shares), which gives all tasks the same start. Then all labelled documents are dealt by their hash into
shards of about SAMPLE_CHARS; in each of ROUNDS rounds every shard goes on from the shared model, and what the shards
learnt is averaged, a word's vector over the shards that have it. Only models go through the driver. Scoring reads whole texts.
Thresholds for rejecting are calibrated by language on a fifth of the documents before the last round, which learns from that
fifth too.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import wordhash
from folioscope.llm.common import exchanges_end, materialize, spread_if_few, table

#: Labelled documents of each class that the first model may take, and the characters that it, and about a shard, may take in all.
SAMPLE, SAMPLE_CHARS = 2000, 8_000_000
#: Passes of the shards over all labelled documents, after the first model.
ROUNDS = 2
BUCKETS, PREFIXES = 22, (4, 5, 6, 7, 8)
DIM, FILTERS, WIDTHS = 12, 6, (1, 2, 3)
SEGMENT = 48
STEP = SEGMENT - max(WIDTHS) + 1
#: Training passes over the sample EPOCHS times, and as often as UPDATES steps of BATCH texts take.
EPOCHS, UPDATES, BATCH, RATE, DECAY, SPREAD = 4, 400, 32, 0.01, 1e-4, 0.03
#: A hashed bucket has an embedding if so many labelled documents hold it; at most ROWS buckets do, those that most hold.
LEAST_DOCS, ROWS = 4, 60_000
CALIBRATE, THRESHOLDS = 20, (0.35, 0.75)
#: Pieces that a model is averaged in, each in a task, and segments that are looked at together.
BLOCKS, LOOK = 16, 4096


@dataclass
class Model:
    """Embedded buckets (sorted; bucket known[i] has row i + 1, row 0 is for the others), filters, output weights."""

    known: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    threshold: dict[str, float] = field(default_factory=dict)

    @cached_property
    def row(self) -> np.ndarray:
        rows = np.zeros(1 << BUCKETS, dtype=np.uint16 if len(self.known) < 65_535 else np.int32)
        rows[self.known] = np.arange(1, len(self.known) + 1)
        return rows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "row"}


def buckets(words: wordhash.Words) -> np.ndarray:
    """(words, 1 + prefixes) hashed buckets; 0 for a prefix that the word is too short for."""
    found = [words.hash, *words.prefix]
    return np.stack([(h >> np.uint64(64 - BUCKETS)).astype(np.int32) for h in found], axis=1)


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each segment and the document it belongs to. Segments overlap, so that no window of words is cut."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - (SEGMENT - STEP)) // STEP))
    doc = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + step * STEP, doc


def laid_out(rows: np.ndarray, first: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(segments, SEGMENT, features) embedding rows; places after a document's end hold row 0."""
    at = start[:, None] + np.arange(SEGMENT)
    inside = at < first[doc + 1][:, None]
    out = np.zeros((len(start), SEGMENT, rows.shape[1]), dtype=rows.dtype)
    out[inside] = rows[at[inside]]
    return out


def convolve(model: Model, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per filter width: pooled (segments, FILTERS) activations after the rectifier, and where the maximum was."""
    pooled, where = [], []
    for width, w, b in zip(WIDTHS, model.filters, model.bias):
        reach = SEGMENT - width + 1
        y = sum(x[:, o : o + reach] @ w[o] for o in range(width))
        best = y.argmax(axis=1)
        pooled.append(np.maximum(np.take_along_axis(y, best[:, None], 1)[:, 0] + b, 0))
        where.append(best)
    return pooled, where


def described(pooled: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' features: maximum and mean of their segments."""
    p = np.concatenate(pooled, axis=1)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[begin, len(doc)])
    return np.concatenate([np.maximum.reduceat(p, begin, axis=0), np.add.reduceat(p, begin, axis=0) / n[:, None]], axis=1), p


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """Score of each text; a null or empty one is scored as a text without known words."""
    out = np.zeros(len(column))
    for words in wordhash.hashed(column, PREFIXES):
        rows = model.row[buckets(words)]
        start, doc = segments(words.first)
        parts = []
        for at in range(0, len(start), 512):
            x = model.embedding[laid_out(rows, words.first, start[at : at + 512], doc[at : at + 512])].sum(axis=2)
            parts.append(np.concatenate(convolve(model, x)[0], axis=1))
        features, _ = described([np.concatenate(parts)], doc)
        out[words.lo : words.hi] = 1 / (1 + np.exp(-np.clip(features @ model.weight + model.offset, -30, 30)))
    return out


def hashed_rows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts: (words, 1 + prefixes) hashed buckets, and where each text begins in them."""
    for words in wordhash.hashed(pa.array(texts, pa.string()), PREFIXES):
        yield buckets(words), words.first


def docs_by_bucket(texts: list[str], docs: np.ndarray) -> None:
    """Add to docs how many of the texts hold each bucket."""
    for held, first in hashed_rows(texts):
        for lo, hi in zip(first, first[1:]):
            docs[np.unique(held[lo:hi])] += 1


def begun(known: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """Random weights."""
    m = Model(known, np.zeros((len(known) + 1, DIM), np.float32), [], [], np.zeros(0, np.float32), 0.0)
    m.embedding[1:] = rng.normal(0, SPREAD, (len(known), DIM))
    for width in WIDTHS:
        m.filters.append(rng.normal(0, (width * DIM) ** -0.5, (width, DIM, FILTERS)).astype(np.float32))
        m.bias.append(np.zeros(FILTERS, np.float32))
    size = FILTERS * len(WIDTHS)
    m.weight = np.full(2 * size, 1.0 / size, np.float32)
    m.offset = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    return m


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 11, known: np.ndarray | None = None) -> Model:
    """A model from random weights. known: the buckets that have an embedding, by default those of these texts."""
    rng = np.random.default_rng(seed)
    if known is None:
        docs = np.zeros(1 << BUCKETS, np.uint32)
        docs_by_bucket(texts, docs)
        known = np.flatnonzero(docs >= LEAST_DOCS)
        known = np.sort(known[np.argsort(-docs[known].astype(int), kind="stable")[:ROWS]])
        known = known[known > 0]
    share = float((weight * toxic).sum() / max(weight.sum(), 1e-9)) if len(toxic) else 0.0
    m = begun(known, share, rng)
    taught(m, texts, toxic, weight, max(EPOCHS, -(-UPDATES * BATCH // max(1, len(texts)))), rng)
    return m


def taught(m: Model, texts: list[str], toxic: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adam on the weighted log loss, in place; gradients reach only the places that a maximum came from."""
    rows, n = [np.zeros((0, 1 + len(PREFIXES)), m.row.dtype)], []
    for held, begin in hashed_rows(texts):
        rows.append(m.row[held])
        n += np.diff(begin).tolist()
    rows, n = np.concatenate(rows), np.array(n, dtype=np.int64)
    first = np.r_[0, np.cumsum(n)]
    size = FILTERS * len(WIDTHS)
    params = [m.embedding, *m.filters, *m.bias, m.weight]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    offset = np.array([m.offset], np.float32)
    offset_moments = [np.zeros(1, np.float32), np.zeros(1, np.float32)]
    order = np.arange(len(n))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            own = np.r_[0, np.cumsum(n[chosen])]
            part = np.concatenate([rows[first[d] : first[d + 1]] for d in chosen])
            start, doc = segments(own)
            ids = laid_out(part, own, start, doc)
            looks = [convolve(m, m.embedding[ids[s : s + LOOK]].sum(axis=2)) for s in range(0, len(ids), LOOK)]
            pooled, where = ([np.concatenate(y) for y in zip(*(look[k] for look in looks))] for k in (0, 1))
            features, p = described(pooled, doc)
            z = features @ m.weight + offset[0]
            slope = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[chosen]) / len(chosen)
            g_weight = features.T @ slope + DECAY * m.weight
            g_top, g_mean = slope[:, None] * m.weight[:size], slope[:, None] * m.weight[size:]
            parts = np.bincount(doc, minlength=len(chosen))
            is_top = p == features[doc, :size]
            g_pool = (g_mean / parts[:, None])[doc] + is_top * g_top[doc]
            g_pool *= p > 0
            grads = [np.zeros((0, DIM), np.float32), *(np.zeros_like(w) for w in m.filters), *(np.zeros_like(b) for b in m.bias), g_weight.astype(np.float32)]
            touched, backs = [], []
            for k, width in enumerate(WIDTHS):
                g = g_pool[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                grads[1 + len(WIDTHS) + k] += g.sum(axis=0)
                for j in range(FILTERS):
                    live = np.flatnonzero(g[:, j])
                    for o in range(width):
                        hit = ids[live, where[k][live, j] + o]
                        grads[1 + k][o, :, j] += g[live, j] @ m.embedding[hit].sum(axis=1)
                        back = g[live, j][:, None] * m.filters[k][o, :, j]
                        touched.append(hit)
                        backs.append(back)
            # only the rows of the embedding that were touched
            use, at_row = np.unique(np.concatenate([h.T.ravel() for h in touched]), return_inverse=True) if touched else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            grads[0] = np.zeros((len(use), DIM), np.float32)
            if touched:
                np.add.at(grads[0], at_row, np.concatenate([np.tile(b, (h.shape[1], 1)) for h, b in zip(touched, backs)]))
            grads[0][use == 0] = 0
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, (w, g) in enumerate(zip(params, grads)):
                sel = use if i == 0 else slice(None)
                first_moment[i][sel] = 0.9 * first_moment[i][sel] + 0.1 * g
                second_moment[i][sel] = 0.999 * second_moment[i][sel] + 0.001 * g**2
                w[sel] -= rate * first_moment[i][sel] / (np.sqrt(second_moment[i][sel]) + 1e-6)
            g0 = slope.sum()
            offset_moments[0] = 0.9 * offset_moments[0] + 0.1 * g0
            offset_moments[1] = 0.999 * offset_moments[1] + 0.001 * g0**2
            offset -= rate * offset_moments[0] / (np.sqrt(offset_moments[1]) + 1e-6)
    m.offset = float(offset[0])


def threshold_steps() -> np.ndarray:
    return np.arange(THRESHOLDS[0], THRESHOLDS[1] + 0.01, 0.05)


def calibrated(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray, lang: list[str | None]) -> dict[str, float]:
    """Threshold of each language with enough held documents of both classes: the one of best F1, within THRESHOLDS."""
    found = {}
    names = np.array([x or "" for x in lang], dtype=object)
    for name in sorted(set(names)):
        own = names == name
        y, s, w = toxic[own], score[own], weight[own]
        if not name or min((w * y).sum(), (w * (1 - y)).sum()) < CALIBRATE:
            continue
        steps = threshold_steps()
        f1 = [2 * (w * y * (s >= t)).sum() / max((w * (y + (s >= t))).sum(), 1e-9) for t in steps]
        best = np.flatnonzero(np.isclose(f1, max(f1)))
        found[name] = float(steps[best[len(best) // 2]])
    return found


def learning(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", learn: str = "true") -> tuple[DataFrame, dict[int, int]]:
    """All labelled documents (rank, id, toxic, text, lang, n: characters), and how many ids each class has.

    Labels that contradict each other for one id count as toxic; null labels and null ids are no labels. Of documents that
    repeat an id the one with the smallest text hash is taken, so the rows are the same in every run. rank is the hash of the id.
    """
    known = labels.where(f"`{id_col}` is not null and toxic in (0, 1)").groupBy(id_col).agg(F.max("toxic").alias("toxic")).where(learn)
    known = materialize(known.select(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 31)).alias("rank"), F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), lang.alias("lang")).alias("own"))
    met = texts.join(spread_if_few(known), "id").where("own.text is not null")
    one = met.groupBy("rank", "id", "toxic").agg(F.min("own").alias("own"))
    return materialize(one.select("rank", "id", "toxic", "own.text", "own.lang", F.length("own.text").alias("n"))), sizes


def sampled(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The bounded sample (rank, id, text, lang, toxic, weight) of what learning() gives, at most SAMPLE rows of each class and SAMPLE_CHARS characters.

    Documents are taken by the hash of their id, as long as they fit in what is left of SAMPLE_CHARS. weight restores the classes' true shares.
    """
    # a share of the hashes that holds enough rows, so that the top rows are found among about SAMPLE
    share = {y: int(min(1.0, 1.5 * SAMPLE / n) * (1 << 31)) + 1 for y, n in sizes.items()}
    keys = rows.select("rank", "id", "toxic", "n")
    first = [keys.where((F.col("toxic") == y) & (F.col("rank") < share[y])).orderBy("rank", "id").limit(SAMPLE) for y in sorted(share)]
    chosen = first[0].union(first[-1]) if len(first) == 2 else first[0] if first else keys
    taken, used, count = [], 0, {0: 0, 1: 0}
    for r in chosen.orderBy("rank", "id").collect():  # at most 2 * SAMPLE rows
        if used + r["n"] <= SAMPLE_CHARS:
            used += r["n"]
            count[r["toxic"]] += 1
            taken.append((r["id"],))
    weight = F.when(F.col("toxic") == 1, sizes.get(1, 0) / max(1, count[1])).otherwise(sizes.get(0, 0) / max(1, count[0]))
    fit_in = rows.sparkSession.createDataFrame(taken, rows.select("id").schema)
    return rows.join(F.broadcast(fit_in), "id", "left_semi").select("rank", "id", "text", "lang", "toxic", weight.alias("weight"))


def labelled(docs: DataFrame, labels: DataFrame, **cols) -> DataFrame:
    """The sample that the first model is made of."""
    return sampled(*learning(docs, labels, **cols))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (bucket, documents that hold it), summed by task."""
    docs = np.zeros(1 << BUCKETS, np.uint32)
    for batch in batches:
        docs_by_bucket(batch.column(0).to_pylist(), docs)
    held = np.flatnonzero(docs)
    for at in range(0, len(held), 1 << 16):
        part = held[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(docs[part].astype(np.int64))], ["bucket", "n"])


def vocabulary(rows: DataFrame) -> np.ndarray:
    """The buckets of all labelled documents that get an embedding, ROWS at most."""
    counts = rows.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_DOCS} and bucket > 0")
    return np.sort(counts.orderBy(F.desc("n"), "bucket").limit(ROWS).toArrow().column("bucket").to_numpy().astype(np.int64))


def _parts(m: Model) -> list[np.ndarray]:
    """A model's numbers: the embedding's rows in BLOCKS pieces, then all others as one row."""
    others = np.concatenate([*(w.ravel() for w in m.filters), *m.bias, m.weight, [m.offset]])
    return [*np.array_split(m.embedding, BLOCKS), others[None].astype(np.float32)]


def _assembled(m: Model, parts: list[np.ndarray]) -> Model:
    """A model of m's form with these numbers."""
    at, others = 0, parts[-1][0]
    filters, bias = [], []
    for like, out in [*((w, filters) for w in m.filters), *((w, bias) for w in m.bias)]:
        out.append(others[at : at + like.size].reshape(like.shape))
        at += like.size
    return Model(m.known, np.concatenate(parts[:-1]), filters, bias, others[at : at + m.weight.size], float(others[-1]), m.threshold)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shard, width, change), by shard -> for each block the mean change of its rows over the shards that changed them."""
    total: dict[int, np.ndarray] = {}
    times: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, width, change in zip(batch.column("block").to_pylist(), batch.column("width").to_pylist(), batch.column("change")):
            own = np.frombuffer(change.as_py(), np.float32).reshape(-1, width)
            if block not in total:
                total[block], times[block] = np.zeros(own.shape), np.zeros(len(own), np.int64)
            total[block] += own
            times[block] += own.any(axis=1)
    means = {b: (t / np.maximum(times[b], 1)[:, None]).astype(np.float32).tobytes() for b, t in total.items()}
    yield pa.RecordBatch.from_arrays([pa.array(list(means), pa.int32()), pa.array(list(means.values()), pa.binary())], ["block", "change"])


def went_on(dealt: DataFrame, model: Model, number: int) -> Model:
    """One round: every shard of dealt (shard, rank, id, text, toxic) goes on from the model, their changes are averaged."""
    spark = dealt.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learnt(shard: int, texts: list[str], toxic: list[int]) -> pa.RecordBatch:
            m = pickle.loads(pickle.dumps(shared.value))
            taught(m, texts, np.array(toxic, dtype=float), np.ones(len(texts)), 1, np.random.default_rng([number, shard]))
            changes = [b - a for a, b in zip(_parts(shared.value), _parts(m))]
            columns = [pa.array(range(len(changes)), pa.int32()), pa.array([shard] * len(changes), pa.int64()), pa.array([c.shape[1] for c in changes], pa.int32()), pa.array([c.tobytes() for c in changes], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "shard", "width", "change"])

        at, texts, toxic = None, [], []
        for batch in batches:
            for shard, text, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "text", "toxic"))):
                if shard != at and texts:
                    yield learnt(at, texts, toxic)
                    texts, toxic = [], []
                at = shard
                texts.append(text)
                toxic.append(y)
        if texts:
            yield learnt(at, texts, toxic)

    changes = dealt.mapInArrow(run, "block int, shard long, width int, change binary")
    with exchanges_end(spark):
        found = changes.repartition(BLOCKS, "block").sortWithinPartitions("block", "shard").mapInArrow(_added, "block int, change binary").collect()
    shared.destroy()
    parts = _parts(model)
    for r in found:
        parts[r["block"]] = parts[r["block"]] + np.frombuffer(r["change"], np.float32).reshape(parts[r["block"]].shape)
    return _assembled(model, parts)


def held_thresholds(held: DataFrame, model: Model) -> dict[str, float]:
    """calibrated() over all rows of held (text, toxic, lang), which are counted by language, class and step."""
    shared = held.sparkSession.sparkContext.broadcast(model)
    steps = threshold_steps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.searchsorted(steps, scores(shared.value, batch.column(0)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(above)], ["toxic", "lang", "above"])

    counts = held.select("text", "toxic", "lang").mapInArrow(run, "toxic int, lang string, above int").where("lang <> ''").groupBy("lang", "toxic", "above").agg(F.count("*").alias("n"))
    # languages with enough documents of both classes only
    enough = counts.groupBy("lang").agg(*(F.sum(F.when(F.col("toxic") == y, F.col("n"))).alias(f"n{y}") for y in (0, 1))).where(f"n0 >= {CALIBRATE} and n1 >= {CALIBRATE}")
    rows = counts.join(enough, "lang", "left_semi").collect()
    shared.destroy()
    score = np.array([steps[r["above"] - 1] if r["above"] else 0.0 for r in rows])
    return calibrated(score, np.array([r["toxic"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float), [r["lang"] for r in rows])


def _fit_task(known: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        for batch in batches:
            for column in ("text", "toxic", "weight"):
                held[column] += batch.column(column).to_pylist()
        weight = np.array(held["weight"], dtype=float)
        model = train(held["text"], np.array(held["toxic"], dtype=float), weight / max(weight.mean(), 1e-9) if len(weight) else weight, known=known)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: str = "true", thresholds: bool = True, **cols) -> Model:
    """Model from all labelled rows for which `learn` (SQL over the id column) holds, and, if asked for, thresholds.

    With thresholds a fifth of the documents is held back until they are calibrated on it; the last round learns from all. Without any labelled row the model scores
    every text alike, at 0.001.
    """
    rows, sizes = learning(docs, labels, learn=learn, **cols)
    known = vocabulary(rows)
    fifth = F.pmod(F.xxhash64("rank"), F.lit(5)) == 4
    early = rows.where(~fifth) if thresholds else rows
    sample = sampled(early, sizes)
    found = sample.coalesce(1).sortWithinPartitions("rank", "id").mapInArrow(_fit_task(known), "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else train([], np.zeros(0), np.zeros(0))
    shards = -(-(rows.agg(F.sum("n")).first()[0] or 0) // SAMPLE_CHARS) or 1
    for number in range(ROUNDS):
        last = number == ROUNDS - 1
        if last and thresholds:
            model.threshold = held_thresholds(rows.where(fifth), model)
        own = (rows if last else early).select((F.col("rank") % shards).alias("shard"), "rank", "id", "text", "toxic")
        model = went_on(own.repartition(shards, "shard").sortWithinPartitions("shard", "rank", "id"), model, number)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row. Only the text is read.

    Repeated rows and ids stay as rows; equal texts have equal scores. A null or empty text is scored as a text without
    known words. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2^BUCKETS places, ROWS embeddings
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose score stays under their language's threshold (0.5 without one), their columns as they came.

    Each row is judged by its own text: repeated rows stay or go together, a null or empty text scores as one without known
    words, null and unknown languages and tables without lang_col take 0.5. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            limit = np.array([m.threshold.get(x, 0.5) for x in langs])
            yield batch.filter(pa.array(scores(m, batch.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, learn="crc32(cast(doc_id as string)) % 5 <> 0", thresholds=False)
    found = scored(docs, model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity_cnn": op8_toxicity_cnn}
ORACLE: dict[str, str] = {}
