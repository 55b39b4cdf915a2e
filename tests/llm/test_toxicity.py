import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def invented(n, seed=2):
    rng = random.Random(seed)
    words = ["al", "bo", "cer", "dun", "eft", "gor", "hin", "ilk"]
    word = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    texts, y = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w.insert(rng.randint(0, len(w)), rng.choice(["slurword", "vilething", "grumpost" + word()]))
        texts.append(" ".join(w))
        y.append(float(bad))
    return texts, np.array(y)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_learns_and_scores_like_the_plain_sum():
    texts, y = invented(600)
    model = T.train(texts[:450], y[:450], np.ones(450))
    s = T.scores(model, pa.array(texts[450:]))
    assert auc(y[450:], s) > 0.97
    # one document alone, segment by segment, gives the same score
    words = next(T.wordhash.hashed(pa.array([texts[460]]), T.PREFIXES))
    rows = model.row[T.buckets(words)]
    pooled = []
    for start in range(0, max(1, len(rows) - (T.SEGMENT - T.STEP)), T.STEP):
        x = np.zeros((T.SEGMENT, T.DIM))
        part = rows[start : start + T.SEGMENT]
        x[: len(part)] = model.embedding[part].sum(1)
        pooled.append([max(0, max(sum(x[t + o] @ w[o][:, f] for o in range(k)) for t in range(T.SEGMENT - k + 1)) + b[f]) for k, w, b in zip(T.WIDTHS, model.filters, model.bias) for f in range(T.FILTERS)])
    p = np.array(pooled)
    z = np.r_[p.max(0), p.mean(0)] @ model.weight + model.offset
    assert s[10] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_only_training_makes_the_scores(monkeypatch):
    """Without an epoch the scores say nothing: no statistic of the labels is built into the first weights."""
    texts, y = invented(600)
    monkeypatch.setattr(T, "EPOCHS", 0)
    monkeypatch.setattr(T, "UPDATES", 0)
    model = T.train(texts[:450], y[:450], np.ones(450))
    assert 0.3 < auc(y[450:], T.scores(model, pa.array(texts[450:]))) < 0.7


def test_sample_is_the_same_in_every_run(spark, monkeypatch):
    rows = [(i % 7, f"text {i} " + "x " * i, "en") for i in range(40)] + [(None, "no id", "en"), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(0, 1)], "doc_id long, toxic int")
    one, two = (sorted(map(tuple, T.labelled(docs.repartition(n), labels).collect())) for n in (2, 5))
    assert one == two and sorted(r[1] for r in one) == list(range(7)) and {r[1] for r in one if r[4]} == {0, 1, 3, 5}
    assert sum(r[5] for r in one) == pytest.approx(9)
    monkeypatch.setattr(T, "SAMPLE_CHARS", 60)
    few = T.labelled(docs, labels).collect()
    assert 0 < len(few) < 7 and sum(len(r.text) for r in few) <= 60


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (None, "x " * 30000, None), (2, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(9, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    rows = T.scored(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score < 0.5 for r in rows)
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert T.scored(docs.where("false"), model).collect() == [] and T.drop_toxic(docs.where("false"), model).collect() == []
    assert sorted(r.id for r in T.labelled(docs, spark.createDataFrame([(2, 1), (1, 0)], "doc_id long, toxic int")).collect()) == [2]


def test_held_out_accuracy(spark):
    got = T.op8_toxicity_cnn(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got["toxic"].to_numpy(), got["score"].to_numpy()) > 0.85
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_thresholds_by_language():
    score = np.r_[np.linspace(0, 1, 100), np.linspace(0, 1, 100)]
    toxic = np.r_[np.linspace(0, 1, 100) > 0.6, np.linspace(0, 1, 100) > 0.4].astype(float)
    found = T.calibrated(score, toxic, np.ones(200), ["aa"] * 100 + ["bb"] * 100)
    assert 0.5 < found["aa"] <= 0.65 and 0.35 <= found["bb"] < 0.5
    assert T.calibrated(score[:5], toxic[:5], np.ones(5), [None] * 5) == {}


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """What a word means stands only in documents that are not in the first model's sample."""
    monkeypatch.setattr(T, "SAMPLE", 20)
    monkeypatch.setattr(T, "SAMPLE_CHARS", 100_000)
    texts, y = invented(1200)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y[:900])], "doc_id long, toxic int")
    given = lambda: spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    first = {r.id for r in T.labelled(given(), labels).collect()}
    assert len(first) == 40
    texts = [t if i in first else re.sub("slurword|vilething|grumpost[a-z]*", "crudmark", t) for i, t in enumerate(texts)]
    assert {r.id for r in T.labelled(given(), labels).collect()} == first
    model = T.fit(given(), labels)
    s = T.scores(model, pa.array(texts[900:]))
    assert auc(y[900:], s) > 0.95
    assert 0.35 <= model.threshold["en"] <= 0.75
    again = T.fit(given().repartition(5), labels)
    assert np.allclose(T.scores(again, pa.array(texts[900:])), s) and again.threshold == model.threshold


def test_long_texts_are_looked_at_in_pieces(monkeypatch):
    texts, y = invented(60)
    texts[3] = " ".join(texts)
    monkeypatch.setattr(T, "UPDATES", 40)
    models = []
    for look in (4096, 7):
        monkeypatch.setattr(T, "LOOK", look)
        models.append(T.train(texts, y, np.ones(60)))
    assert np.allclose(*(T.scores(m, pa.array(texts)) for m in models), atol=1e-3)
