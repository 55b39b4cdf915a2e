"""What the operators of this subpackage share: table access, reliable lineage cuts, Arrow text access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a batch with what it makes of it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks hold, where the session has not set a bound, whatever it is."""
    for setting, bound in BATCHES.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, bound)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set and one machine runs all (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes that a task gathers before it writes them to a cut.
CUT_GROUP_BYTES = 16 << 20


@contextmanager
def exchanges_end(spark: SparkSession) -> Iterator[None]:
    """Exchanges of what is run inside leave the disks with it, not when the driver's collector comes by."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: the lineage ends at replicated files,
    so a lost executor costs a file read and not a recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    with exchanges_end(spark):
        df.write.option("parquet.block.size", CUT_GROUP_BYTES).parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut.cut_path = path
    if _noted:
        _noted[-1].append(cut)
    return cut


_noted: list[list[DataFrame]] = []


@contextmanager
def noted_cuts() -> Iterator[list[DataFrame]]:
    """The list of the cuts that are made inside: whoever knows when their results have been read can release() them."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def release(*cuts: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for cut in cuts:
        jvm = cut.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(cut.cut_path)
        place.getFileSystem(cut.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a few numbers that may be broadcast.
FEW_ROWS = 1_000_000


def spread_if_few(rows: DataFrame) -> DataFrame:
    """rows of numbers, marked for a broadcast if they are counted to be no more than FEW_ROWS; else for whatever join Spark takes."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


#: A key that holds more than one of so many shares of the rows is hot, so there are at most so many hot keys.
HOT_KEYS = 4096


def join_spread(rows: DataFrame, sizes: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """rows joined with lookup (one row a key; its other columns), however many rows share a key; rows without a match go.

    sizes(key, rows): how many rows each key has. Rows of a hot key are dealt to as many places as the key has shares, and its
    row of lookup is copied to each; the list of hot keys has at most HOT_KEYS rows and is broadcast.
    """
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    share = max(1, total // HOT_KEYS)
    hot = F.broadcast(sizes.where(F.col("rows") > share).select(key, F.ceil(F.col("rows") / share).cast("int").alias("_places")))
    spread = rows.join(hot, key, "left").withColumn("_place", F.when(F.col("_places").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_places").cast("long")))).drop("_places")
    copied = lookup.join(hot, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_places") - 1, F.lit(0))))).drop("_places")
    return spread.withColumn("_place", F.col("_place").cast("int")).join(copied, [key, "_place"]).drop("_place")


def shipped(spark: SparkSession, path: str) -> str:
    """Send a file that the driver can read to all tasks; the name that in_task() opens it by."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def in_task(name: str) -> str:
    """Where a task finds a shipped file."""
    return SparkFiles.get(name)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow text column, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def bitmap(hashes: DataFrame, least_bits: int, most_bits: int, each: int = 64) -> tuple[np.ndarray, int]:
    """Bits of all hashes(h long), by their leading bits, and how many leading bits: at most 2^most_bits, whatever the number of hashes."""
    n = hashes.count()
    bits = min(most_bits, max(least_bits, (each * n).bit_length()))
    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    rows = at.groupBy((F.shiftright("at", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return words.view(np.uint64), bits


def in_bitmap(screen: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    words, bits = screen
    at = hashes >> np.uint64(64 - bits)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def group_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Regroup a key-sorted stream of null-free numeric batches so that no run of equal keys is cut
    between two yielded blocks. Runs must be bounded by the caller; a run is put together once."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        block = held[0] if len(held) == 1 else {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        held.clear()
        return block

    for batch in batches:
        block = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = block[key]
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and (cut or held[-1][key][-1] != keys[0]):
            head = int(np.searchsorted(keys, held[-1][key][-1], "right"))
            if head:
                held.append({n: v[:head] for n, v in block.items()})
            yield joined()
            block, cut = {n: v[head:] for n, v in block.items()}, cut - head
        if cut > 0:
            yield {n: v[:cut] for n, v in block.items()}
        if len(block[key]) > max(cut, 0):
            held.append({n: v[max(cut, 0) :] for n, v in block.items()})
    if held:
        yield joined()
