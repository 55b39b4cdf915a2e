"""Operator 13: token counts through a cache of content digests.

A text's count is stored under two digests: that of its normalised content and that of the tokenizer's version (file, library,
normaliser). Texts are looked up by a join, only distinct texts that no run has met are encoded, and their counts
are appended to the cache, a Parquet table in a shared folder with one partition for each tokenizer version.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe
from folioscope.llm.common import checkpoint_root, in_task, join_spread, materialize, release, shipped, table

LIMIT = 2048
#: So few new digests (32 bytes each) are broadcast, so that texts in the cache are not shuffled; more meet them in a shuffle join.
FEW_MISSES = 100_000
#: Setting that names a cache folder to keep; without it a query begins with an empty cache of its own.
SETTING = "spark.folioscope.tokenCache"
#: The file's own white space (Unicode's White_Space); a run of it counts like one space.
GAPS = r"[\t-\r \x{85}\p{Z}]+"


def kind_of(path: str) -> str:
    """word: byte pairs with word ends, which drop white space. json: any other tokenizers file. model: a sentencepiece file."""
    if path.endswith(".model"):
        return "model"
    with open(path, encoding="utf-8") as f:
        return "word" if json.load(f)["model"].get("end_of_word_suffix") == bpe.END else "json"


def normalised(text: Column, kind: str) -> Column:
    """What two texts of the same count may differ in is taken out: for word files the length of white space and its kind. Other files see every byte."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, GAPS, " ")) if kind == "word" else text


def tokenizer_version(path: str) -> str:
    """Digest of all that decides a count: the file's bytes, the library that defines them and how content is normalised."""
    kind = kind_of(path)
    library = "sentencepiece" if kind == "model" else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{kind}:{library}:{library_version(library)}:".encode() + f.read()).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Count of a text. Word files are encoded by operator 9's forced boundaries (the same ids, several times as fast), others by their library."""
    kind = kind_of(path)
    if kind == "word":
        return bpe.codec(path).count
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _encoded(texts: DataFrame, name: str) -> DataFrame:
    """(content, n_tokens) of (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(in_task(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], ["content", "n_tokens"])

    return texts.mapInArrow(run, "content binary, n_tokens long")


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for a tokenizer version, one row a digest (two writers may both have appended it)."""
    place = f"{cache}/version={version}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content binary, n_tokens long")
    return spark.read.schema("content binary, n_tokens long").parquet(place).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each row of docs; digests that the cache at the folder `cache` lacks are added to it.

    path: the tokenizer file, as the driver sees it; it is sent to the tasks. A null text counts as an empty one: 0 bytes, 0 tokens.
    Null and equal ids and repeated rows are rows like any other; equal content is encoded once, and a content that any share of
    the rows has is dealt out for the join. An empty table gives no rows and leaves the cache as it is. Other columns are not read.
    """
    spark = docs.sparkSession
    kind, version, name = kind_of(path), tokenizer_version(path), shipped(spark, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(normalised(F.col(text_col), kind), 256))
    keyed = materialize(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")))
    sizes = materialize(keyed.groupBy("content").agg(F.count("*").alias("rows")))
    missing = materialize(sizes.join(cached(spark, cache, version), "content", "left_anti").select("content"))
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(content.alias("content"), text.alias("text"))
        if n_missing <= FEW_MISSES:
            texts = texts.join(F.broadcast(missing), "content", "left_semi")
        texts = texts.groupBy("content").agg(F.first("text").alias("text"))
        if n_missing > FEW_MISSES:
            texts = texts.join(missing, "content", "left_semi")
        _encoded(texts, name).write.mode("append").parquet(f"{cache}/version={version}")
    release(missing)
    met = join_spread(keyed, sizes, cached(spark, cache, version), "content")
    return met.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.conf.get(SETTING, None) or f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    return counted(table(spark, sf_dir, "documents"), bpe.vocabulary(), cache)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE: dict[str, str] = {}
