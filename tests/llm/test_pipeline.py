"""Every stage of the corpus pipeline, on the input that it is given, against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioscope.llm import pii, toxicity
from test_pii import slow_masked
from test_simhash_similarity import slow_groups
from test_toxicity import invented

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, near_row int"


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 999)}" for _ in range(n)]


PASSAGE = words(30, 99)


def rows():
    texts, toxic = invented(260, seed=4)
    out = [(i, t, "en", i) for i, t in enumerate(texts)]
    base = words(80, 1)
    out += [
        (1000, " ".join(base), "de", 0), (1001, " ".join([*base[:40], "changed", *base[41:]]), "de", 0), (1000, " ".join(words(50, 2)), "de", 0), (None, " ".join(words(50, 3)), None, None), (None, " ".join(words(50, 4)), None, 1),
        (None, None, "en", 2), (1005, None, None, 2), (1006, "", "en", 2), (1007, "Solo", "en", 2), (1008, " ".join([*words(20, 5), *PASSAGE[4:16], *words(9, 6)]), "fr", 2), (1009, "x" * 3000 + " " + " ".join(words(4000, 7)), "en", 3),
        (1010, "call (988) 555-2485 or pay 4337166598464399 by 1999-12-31 " + " ".join(words(30, 8)), "en", 4), (1010, "call (988) 555-2485 or pay 4337166598464399 by 1999-12-31 " + " ".join(words(30, 8)), "en", 4), (1011, " ".join(words(30, 9)).upper() + " mail A.b@x.example.org", "en", 4),
    ]
    return out, toxic


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    monkey = pytest.MonkeyPatch()
    monkey.setattr(pii, "DEMO", "test key")
    d = str(tmp_path_factory.mktemp("sf"))
    given, toxic = rows()
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(PASSAGE)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    yield d, [*kept, docs]
    monkey.undo()


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_and_columns(corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii_pseudonyms", "bpe_encoding"]
    assert all(df.columns == corpus[1][0].columns for df in corpus[1][:5])


def test_toxic_documents_go(spark, corpus):
    d, (docs, kept, *_) = corpus
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = [r for r in plain(docs) if float(toxicity.scores(model, pa.array([r[1]], pa.string()))[0]) < model.threshold.get(r[2], 0.5)]
    assert plain(kept) == want
    toxic = rows()[1]
    left = {r[0] for r in want}
    assert np.mean([i not in left for i in np.flatnonzero(toxic)]) > 0.9 and np.mean([i in left for i in np.flatnonzero(1 - toxic)]) > 0.95


def test_one_of_each_group_stays(corpus):
    before, after = (plain(df) for df in corpus[1][1:3])
    ordered = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    roots = slow_groups([r[1] for r in ordered])
    assert len(after) == len(set(roots)) < len(before)
    want = [ordered[r] for r in sorted(set(roots))]
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted((r[0] is None, r[0] or 0) for r in want)
    assert not {1001} & {r[0] for r in after} and {1000, 1007, 1008, 1009} <= {r[0] for r in after}


def test_leaks_go(corpus):
    before, after = (plain(df) for df in corpus[1][2:4])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(PASSAGE[i : i + 10]) for i in range(len(PASSAGE) - 9)}
    leaks = lambda t: any(tuple(w[i : i + 10]) in windows for w in [split(t)] for i in range(len(w) - 9))
    assert after == [r for r in before if not leaks(r[1])]
    assert {r[0] for r in before} - {r[0] for r in after} == {1008}


def test_personal_data_is_replaced(corpus):
    before, after = (plain(df) for df in corpus[1][3:5])
    assert after == sorted(((r[0], slow_masked(r[1]), *r[2:]) for r in before), key=str)
    assert sum(a != b for a, b in zip(before, after)) >= 2


def test_tokens(corpus):
    before, after = corpus[1][4].collect(), corpus[1][5].collect()
    tokenizer = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def slow(r):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False)))

    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after), key=str) == sorted(map(slow, before), key=str)


def test_run_is_the_stages_in_order(spark, corpus):
    d, kept = corpus
    assert plain(corpus_pipeline.run(spark, d)) == plain(kept[-1])


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, ddl in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
