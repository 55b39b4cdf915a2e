"""Operator 3: benchmark decontamination by a prefix-filtered set join.

Every item window (WINDOW consecutive words, or the whole of a shorter item) is a set of word
shingles. Shingles are ordered by how rare they are in all documents. A window that is wholly
contained holds each of its shingles, so its necessary prefix is its rarest one: only that shingle is
joined with the documents. The place of the shingle in the window bounds where the window can
start, the window's length bounds what must follow, and the words themselves are compared over the
item-sized window. Documents send only the few positions whose shingle hash passes a bitmap of
bounded size; the join itself is a shuffle join on the hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import wordhash
from folioscope.llm.common import bitmap, in_bitmap, materialize, table, text_bytes

WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap that screens document positions: 64 for each shingle within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 16, 27
COUNTS = 500_000


def _windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """item id, text -> item id, window words, number of words, its shingles' hashes in order."""
    for batch in batches:
        ids, words, sizes, grams = [], [], [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            own = wordhash.split(text)
            if not own:
                continue
            hashes = next(wordhash.hashed(pa.array([b" ".join(own).decode()]))).hash
            size = min(window, len(own))
            for at in range(len(own) - size + 1):
                ids.append(i)
                words.append(b" ".join(own[at : at + size]).decode())
                sizes.append(size)
                grams.append(wordhash.shingles(hashes[at : at + size], min(shingle, size)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(words, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["item", "words", "size", "grams"])


def _passing(words: wordhash.Words, length: int, screen: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in slice, word index, hash) of the shingles that the bitmap lets through."""
    grams = wordhash.shingles(words.hash, length)
    hit = np.flatnonzero(in_bitmap(screen, grams))
    doc = np.searchsorted(words.first, hit, "right") - 1
    inside = hit + length <= words.first[doc + 1]
    return doc[inside], hit[inside], grams[hit[inside]]


def _count(batches: Iterator[pa.RecordBatch], lengths: list[int], screen) -> Iterator[pa.RecordBatch]:
    seen: Counter[int] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["h", "n"])

    for batch in batches:
        for words in wordhash.hashed(batch.column(0)):
            for length in lengths:
                grams, n = np.unique(_passing(words, length, screen.value)[2].view(np.int64), return_counts=True)
                for h, k in zip(grams.tolist(), n.tolist()):
                    seen[h] += k
        if len(seen) > COUNTS:
            yield out()
            seen.clear()
    yield out()


MET = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("context", pa.list_(pa.string()))]))


def _meet(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int], screen) -> Iterator[pa.RecordBatch]:
    """id, text, digest -> row number, id, digest, number of words, positions that pass with the words around them."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        counts, met = [], []
        for words in wordhash.hashed(batch.column(1)):
            found: list[list[dict]] = [[] for _ in range(words.hi - words.lo)]
            for length in lengths:
                for d, i, h in zip(*(x.tolist() for x in _passing(words, length, screen.value))):
                    first, last = int(words.first[d]), int(words.first[d + 1])
                    lo, hi = max(first, i + length - window), min(last, i + window)
                    found[d].append({"h": h - (1 << 64) if h >> 63 else h, "at": i - first, "lo": lo - first, "context": [words.word(k).decode() for k in range(lo, hi)]})
            met += found
            counts += np.diff(words.first).tolist()
        rows = pa.array(range(row, row + len(counts)), pa.int64())
        row += len(counts)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(met, MET)], ["row", "id", "digest", "n_words", "met"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: (row, id, digest, n_words, n_hit, items array<string>).

    n_hit counts the words inside any occurrence of an item window; items holds the ids (as text,
    sorted) of the items with occurring windows. Null and empty texts have no words and no hits; null
    or wordless items have no window, and an item whose id is null counts its hits but is not listed.
    Repeated documents stay as rows; items that repeat an id are one item. Other columns are not
    read. Without documents the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    windows = materialize(items.select(item_col, item_text).mapInArrow(lambda it: _windows(it, window, shingle), f"item {item_kind}, words string, size int, grams array<bigint>"))
    distinct = windows.select("words", "size", "grams").dropDuplicates(["words"])
    grams = distinct.select("words", "size", F.posexplode("grams").alias("off", "h"))
    lengths = [min(shingle, r["size"]) for r in distinct.select(F.least("size", F.lit(shingle)).alias("size")).distinct().collect()]
    lengths = sorted(set(lengths))
    screen = spark.sparkContext.broadcast(bitmap(grams.select("h").distinct(), LEAST_BITS, MOST_BITS))
    frequency = docs.select(text_col).mapInArrow(lambda it: _count(it, lengths, screen), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # a shingle that no document has rules its window out, so an inner join is enough
    counted = grams.join(frequency, "h", "left")
    prefix = counted.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("rarest")).where("rarest.n > 0")
    prefix = materialize(prefix.select("words", "size", F.col("rarest.off").alias("off"), F.col("rarest.h").alias("h")))
    screen.destroy()
    narrow = spark.sparkContext.broadcast(bitmap(prefix.select("h").distinct(), LEAST_BITS, MOST_BITS))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    rows = materialize(source.mapInArrow(lambda it: _meet(it, window, lengths, narrow), f"row long, id {kind}, digest long, n_words long, met array<struct<h:long,at:int,lo:int,context:array<string>>>"))
    narrow.destroy()
    met = rows.select("row", F.explode("met").alias("m")).select("row", "m.*")
    start = F.col("at") - F.col("off")
    bounds = (start >= F.col("lo")) & (start - F.col("lo") + F.col("size") <= F.size("context"))
    same = F.array_join(F.slice("context", F.greatest(start - F.col("lo") + 1, F.lit(1)), F.col("size")), " ") == F.col("words")
    hits = materialize(met.join(prefix, "h").where(bounds & same).select("row", start.alias("start"), "size", "words").distinct())
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    covered = F.expr("aggregate(spans, struct(0L AS n, 0L AS till), (a, s) -> struct(a.n + greatest(0L, s.start + s.size - greatest(a.till, CAST(s.start AS LONG))) AS n, greatest(a.till, CAST(s.start + s.size AS LONG)) AS till)).n")
    owners = windows.select("words", F.col("item").cast("string").alias("item")).distinct()
    named = hits.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    of_row = spans.select("row", covered.alias("n_hit")).join(named, "row", "left")
    return rows.select("row", "id", "digest", "n_words").join(of_row, "row", "left").select("row", F.col("id").alias(id_col), "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without any hit, their columns as they came. Null and empty texts have no hit and stay, repeated rows stay or go together,
    rows of one id are told apart by their text. Without documents the result is empty, without items all stay."""
    hit = contamination(docs, items, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).distinct()
    hit = materialize(hit)
    return docs.join(hit, (F.xxhash64(docs[text_col]) == hit["_digest"]) & docs[id_col].eqNullSafe(hit["_id"]), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
        FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(k) WHERE len(w) > 0),
pos AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM win) AS z, unnest(range(1, len(w) - n + 2)) AS t(k)),
hit AS (SELECT r, k, n, item_id FROM pos JOIN win USING (n, s)),
cover AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM hit, unnest(range(0, n)) AS u(o) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN own USING (r)""",
}
