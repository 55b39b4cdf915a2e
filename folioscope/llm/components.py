"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, release

#: A task's local forest is written out and begun anew beyond so many nodes.
FOREST_NODES = 500_000
#: So few links are finished in one task; a table of more goes on in rounds. Both are exact.
FEW = 300_000
PAIR = "u long, v long"


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Spanning stars of a bounded set of pairs: every node that is not its group's least, with that least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) > FOREST_NODES:  # more than FEW, so the last task never cuts
            found = forest(held)
            held = []
            yield out(found)
    if held:
        yield out(forest(held))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, component): one row for each node that is not the least of its
    component, with that least node. Nodes without links, self links and null ends give no row.

    Each task first contracts its own links to stars, so dense groups of near copies shrink before
    the first shuffle, and a table of no more than FEW links is finished by one such task. Each round's links are cut from
    their lineage in the shared folder.
    """
    clean = edges.toDF("u", "v").where("u is not null and v is not null and u <> v")
    edges = materialize(clean.mapInArrow(_contract, PAIR))
    before = None
    while True:
        count, mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (count, mark) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = (count, mark)
        last = edges
        edges = materialize(edges.coalesce(1).mapInArrow(_contract, PAIR) if count <= FEW else _small_star(_large_star(edges)))
        release(last)
        if count <= FEW:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
