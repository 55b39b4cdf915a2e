import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.llm import token_counts as C
from folioscope.llm.common import checkpoint_root

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)

TEXTS = [
    None, "", " \n\t", "Hello,  world!", "Hello, world! ", "hello, world!", "<|endoftext|>x<|ENDOFTEXT|>", "<|endoftext|≯ <|startoftext|> ", "a 　b", "a b", "a\u001cb", "é é ́x", "日本語 😀",
    "word " * 30000, "x" * 5000, "a\u0085b c", "it's  they'll", "Σ ΣΑΣ İ",
]
ROWS = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "Hello,  world!", "x", 7), (3, "Hello,  world!", "x", 7), (None, None, "x", 7)]
DDL = "doc_id long, text string, content string, rows int"


def cache_of(spark):
    return f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"


def want(rows, count):
    return sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for d, t, *_ in rows), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("few", [C.FEW_MISSES, 1])
def test_same_as_the_library_cold_and_warm(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_MISSES", few)
    cache, asked = cache_of(spark), []
    whole = C._encoded

    def seen(texts, name):
        asked.append(texts.count())
        return whole(texts, name)

    monkeypatch.setattr(C, "_encoded", seen)
    docs = spark.createDataFrame(ROWS, DDL)
    assert got(C.counted(docs.where("doc_id < 9"), PATH, cache)) == want([r for r in ROWS if r[0] is not None and r[0] < 9], library)
    assert got(C.counted(docs, PATH, cache)) == want(ROWS, library)
    assert got(C.counted(docs, PATH, cache)) == want(ROWS, library)
    first = {" ".join((r[1] or "").split()) for r in ROWS[:9]}
    assert len(asked) == 2 and asked[0] == len(first)  # the third run asks nothing
    stored = C.cached(spark, cache, C.tokenizer_version(PATH))
    assert stored.count() == sum(asked)


def test_versions_do_not_mix_and_double_appends_count_once(spark):
    cache = cache_of(spark)
    docs = spark.createDataFrame(ROWS, DDL)
    C.counted(docs, PATH, cache).collect()
    version = C.tokenizer_version(PATH)
    spark.read.parquet(f"{cache}/version={version}").write.mode("append").parquet(f"{cache}/version={version}")
    assert got(C.counted(docs, PATH, cache)) == want(ROWS, library)
    other = public.path("byte_bpe_50k.json")
    byte = tokenizers.Tokenizer.from_file(other)
    assert C.tokenizer_version(other) != version
    assert got(C.counted(docs, other, cache)) == want(ROWS, lambda t: len(byte.encode(t, add_special_tokens=False).ids))


def test_sentencepiece(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [r for r in ROWS if len(r[1] or "") < 10000]
    assert got(C.counted(spark.createDataFrame(rows, DDL), path, cache_of(spark))) == want(rows, lambda t: len(model.encode(t)))


def test_empty_table(spark):
    cache = cache_of(spark)
    assert C.counted(spark.createDataFrame([], DDL), PATH, cache).collect() == []


def test_hot_content_is_dealt_out(spark):
    docs = spark.range(0, 30000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    found = C.counted(docs, PATH, cache_of(spark))
    assert found.count() == 30000
    assert found.where("doc_id % 3 = 0").select("n_tokens").distinct().count() == 1
