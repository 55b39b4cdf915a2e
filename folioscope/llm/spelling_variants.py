"""Operator 11: grouping of spelling variants by search in bidirectional FM-indexes.

Words are counted in tasks. Two words that differ in one code point have the first or the second half of either in common (and so the first
or the last two code points), so the vocabulary is dealt out by these two code points to blocks of bounded size, and each block's words
are searched in the FM-index of the block: one half exactly, then across the other with one error. A pair of code points that
more words share than a block holds is a square of blocks, every part of its words against every part. Tasks send
only each word's number of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, release, table
from folioscope.llm.fm_index import BidirectionalIndex

LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = 5, 3, 97, 2
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Words that a task counts before it sends them on.
HELD = 200_000
#: Code points (and delimiters) of a block's index. Words have an alphabet of 90 code points, so there are at most 8,100 pairs of them.
CAPACITY = 500_000
NEAR = "word string, n_near long, best_n long, best string"


def mutated(run: str, doc_id: int | None, crc: int) -> str:
    """A run of a document with one code point missing, if its checksum says so. crc: that of the id and the colon."""
    h = zlib.crc32(run.encode(), crc)
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words of at least LEAST_LENGTH code points that occur LEAST_COUNT times in all documents together.

    Null and empty texts have no words, a null id is an empty string before the colon; repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = text.as_py()
                if not lowered:
                    continue
                crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(RUNS.findall(lowered.encode().lower().decode())).items():
                    word = mutated(word, doc_id, crc)
                    if len(word) >= LEAST_LENGTH:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def blocks(sizes: list[tuple[int, str, int]], capacity: int) -> list[tuple[int, str, int, int]]:
    """(side, pair, code points) -> (side, pair, first block, parts): pairs share a block while it has room, a larger one is parts x parts blocks."""
    out, block, filled, last = [], 0, 0, None
    for side, pair, size in sizes:
        parts = -(-size // capacity)
        if filled and (side != last or parts > 1 or filled + size > capacity):
            block, filled = block + 1, 0
        out.append((side, pair, block, parts))
        filled, last = filled + size, side
        if parts > 1:
            block, filled = block + parts * parts, 0
    return out


def _dealt(words: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(block, side, word, n, indexed, asked) for each block that a word is in, and the number of blocks."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.left("word", F.lit(2)).alias("pair")), F.struct(F.lit(1).alias("side"), F.right("word", F.lit(2)).alias("pair"))))
    sided = words.select("word", "n", ends.alias("e")).select("word", "n", "e.side", "e.pair")
    # two sides of at most 8,100 pairs each
    sizes = sided.groupBy("side", "pair").agg(F.sum(F.length("word") + 1).alias("size")).orderBy("side", "pair").collect()
    plan = blocks([(r.side, r.pair, r["size"]) for r in sizes], capacity)
    places = words.sparkSession.createDataFrame(plan, "side int, pair string, first int, parts int")
    own = sided.join(F.broadcast(places), ["side", "pair"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")).withColumn("k", F.explode(F.expr("sequence(0, parts - 1)")))
    names = ["side", "word", "n"]
    indexed = own.select((F.col("first") + F.col("own") * F.col("parts") + F.col("k")).alias("block"), *names, F.lit(True).alias("indexed"), (F.col("k") == F.col("own")).alias("asked"))
    asked = own.where("k <> own").select((F.col("first") + F.col("k") * F.col("parts") + F.col("own")).alias("block"), *names, F.lit(False).alias("indexed"), F.lit(True).alias("asked"))
    return indexed.unionByName(asked), max((first + parts * parts for _, _, first, parts in plan), default=0)


def _searched(block: pa.Table) -> pa.Table:
    """Near words of a block's asked words among its indexed ones."""
    rows = sorted(zip(block["word"].to_pylist(), block["n"].to_pylist(), block["indexed"].to_pylist(), block["asked"].to_pylist()))
    words, counts = [r[0] for r in rows if r[2]], np.array([r[1] for r in rows if r[2]], dtype=np.int64)
    first = block["side"][0].as_py() == 0
    by_length: dict[int, list[str]] = {}
    for word, _, _, asked in rows:
        if asked:
            by_length.setdefault(len(word), []).append(word)
    out: list[tuple] = []
    index = BidirectionalIndex(words) if words else None
    for length, queries in by_length.items() if index else ():
        at, found = index.near(queries, first)
        if not first:  # pairs with the first half in common belong to the other side
            half = length // 2
            other = np.fromiter((queries[q][:half] != words[w][:half] for q, w in zip(at.tolist(), found.tolist())), dtype=bool, count=len(at))
            at, found = at[other], found[other]
        order = np.lexsort((found, -counts[found], at))
        at, found = at[order], found[order]
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        near = np.diff(np.r_[heads, len(at)])
        out += zip((queries[q] for q in at[heads].tolist()), near.tolist(), counts[found[heads]].tolist(), (words[w] for w in found[heads].tolist()))
    columns = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(word, n_near, best_n, best) of words(word, n) that have near words: how many, and the most frequent one, ties to the smallest."""
    dealt, n = _dealt(words, capacity)
    found = dealt.repartition(max(1, n), "block").groupBy("block").applyInArrow(_searched, NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms(word, form) ends. Each round doubles the steps taken; counts at least double with each step, so there are few."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.join(ways.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        grown = materialize(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(ways)
        ways = grown.select("word", "root")
        ways.cut_path = grown.cut_path
        if grown.where("moved").isEmpty():
            return ways


def grouped(words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """words(word, n) with form, root, n_near and form_n. A word's form is its most frequent near word if that is RATIO times as frequent; root is the last form.
    An empty table gives no rows."""
    words = materialize(words.select("word", "n"))
    near = near_words(words, capacity)
    has = F.col("best_n") >= RATIO * F.col("n")
    met = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    release(words)
    roots = _last_forms(met.where("form is not null"))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(word_counts(table(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE = {
    "op11_spelling_variants": f"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
crc AS (
  SELECT w, c, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs), poly),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM crc) WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut AS a JOIN words AS b ON a.d = b.word UNION SELECT b.word, a.word FROM cut AS a JOIN words AS b ON a.d = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM (SELECT near.word, other, w.n FROM near JOIN words AS w ON w.word = other) GROUP BY 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * w.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * w.n THEN form_n END AS form_n FROM words AS w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at_word, 0 AS k FROM formed UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN formed AS f ON f.word = at_word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed AS f JOIN (SELECT word, arg_max(at_word, k) AS root FROM walk GROUP BY 1) AS r ON r.word = f.word""",
}
