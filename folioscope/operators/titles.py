"""Alignment of expected titles with found ones, and recall against a golden table."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import folded_title

# Scores of equal titles and of one inside the other, the least score of a match, the share that has to be found.
EQUAL, INSIDE, LEAST_SCORE, LEAST_RECALL = 1.0, 0.9, 0.8, 0.9


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each character of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for c in b:
        met = free & at.get(c, 0)
        free = (free + met | free - met) & whole
    return len(a) - free.bit_count()


def similarity(e: str, a: str, least: float) -> float:
    """Ratio of matching blocks, 0 where it cannot reach least: the blocks are a common subsequence."""
    return difflib.SequenceMatcher(None, e, a).ratio() if 2 * common_length(e, a) / (len(e) + len(a)) >= least else 0.0


def scores(expected: DataFrame, found: DataFrame, least: float = LEAST_SCORE, similar: bool = True) -> DataFrame:
    """(paper_id, place, order, score) of expected(paper_id, place, title) and found(paper_id, order, title) of a paper with at least that score:
    equal, one inside the other, else, if similar, the similarity of their matching blocks. Each title is folded once."""
    a = expected.select("paper_id", "place", folded_title(F.col("title")).alias("e"))
    b = found.select("paper_id", "order", folded_title(F.col("title")).alias("a"))
    pairs = a.join(b, "paper_id")
    easy = F.when(F.col("e") == F.col("a"), EQUAL).when(F.contains("e", "a") | F.contains("a", "e"), INSIDE)
    judged = pairs.withColumn("score", easy)
    plain = judged.where(F.col("score") >= least).select("paper_id", "place", "order", "score")
    if not similar:
        return plain
    # a ratio is at most twice the shorter length over both lengths, so most pairs need no comparison
    bound = 2 * F.least(F.length("e"), F.length("a")) / (F.length("e") + F.length("a"))
    rest = judged.where(F.col("score").isNull() & (bound >= least)).select("paper_id", "place", "order", "e", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [similarity(e, a, least) for e, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ratio, pa.float64())], ["paper_id", "place", "order", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rest.schema}
    compared = rest.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("paper_id", "place", "order")) + ", score double")
    return plain.unionAll(compared.where(F.col("score") >= least))


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs of scores() -> (paper_id, place, order, score): the expected titles of a paper, in their order, each take the best title that is left,
    ties the first one.

    Turns depend on each other within a paper only. A paper's pairs come sorted, best first for each expected title, and are read once as a stream; what
    is held are the titles of one paper that are taken.
    """
    given = pairs.select("paper_id", "place", "order", "score")
    turns = given.repartition("paper_id").sortWithinPartitions("paper_id", "place", F.desc("score"), "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paper, served, taken, started = None, None, set(), False
        for batch in batches:
            kept = []
            for i, (p, place, order) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if not started or p != paper:
                    paper, served, taken, started = p, None, set(), True
                if place != served and order not in taken:
                    taken.add(order)
                    served = place
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return turns.mapInArrow(run, given.schema)


def recall(expected: DataFrame, matched: DataFrame, least: float = LEAST_RECALL) -> DataFrame:
    """(paper_id, expected_n, matched_n, recall, passed) for each paper of the golden table."""
    wanted = expected.groupBy("paper_id").agg(F.count("*").alias("expected_n"))
    got = matched.groupBy("paper_id").agg(F.count("*").alias("matched_n"))
    joined = wanted.join(got, "paper_id", "left").withColumn("matched_n", F.coalesce("matched_n", F.lit(0)))
    share = F.col("matched_n") / F.col("expected_n")
    return joined.withColumn("recall", share).withColumn("passed", share >= least)
