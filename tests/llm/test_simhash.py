import random

import numpy as np
import pytest
import xxhash

from folioscope.llm import components
from folioscope.llm import simhash as S
from folioscope.llm.components import connected_components


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(5)
    words = ["Ab", "çé", "the", "of", "x1", "Éa", "q", "zz", "no"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    near = [b + rng.choice(["", " of", "\n", " q q"]) for b in base for _ in range(3)]
    return base + near + [None, "", " \t\n", "one", "ONE", "one two", "a" * 5000]


@pytest.mark.parametrize("bucket,small", [(16384, 64), (3, 2), (64, 2), (16384, 2)])
def test_matches_brute_force(spark, monkeypatch, bucket, small):
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "SMALL", small)
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(3, texts()[3], "again"), (None, "lonely words nobody has", "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str)
    prints = [slow_print(t) for _, t, _ in rows]
    want = sorted(((d, int(np.uint64(p).astype(np.int64)), c) for (d, _, _), p, c in zip(rows, prints, slow_components([r[0] for r in rows], prints))), key=str)
    assert got == want


def test_bit_sliced_groups_match_plain_counts():
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)))
    member, label = S._bucket_stars(f, 2)
    want = slow_components(list(range(len(f))), [int(x) for x in f])
    assert label.tolist() == want


def test_blocks_are_abandoned():
    """A block whose lanes are all beyond the radius is read for a few planes only; own lane and padding do not hold it."""
    rng = np.random.default_rng(7)
    f = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    lanes, read = S.Lanes(f), []
    got = S.within(lambda j, live: read.append(len(live)) or lanes.rows[j][live] ^ (S.ALL if f[5] >> np.uint64(j) & np.uint64(1) else np.uint64(0)), lanes.use, np.packbits(np.r_[np.arange(1000) == 5, np.ones(24, bool)], bitorder="little").view(np.uint64), 2)
    assert not got.any() and read[0] == 16 and sum(read) < 0.6 * 16 * len(lanes.use)
    near = f.copy()
    near[900] = f[5] ^ np.uint64(3)
    assert np.flatnonzero(S.Lanes(near).met(near[5:6], (np.arange(1000) == 5)[None, :], 2)[0]).tolist() == [900]
    assert S.pairs_within(near[[5, 5, 7]], near[[900, 7, 7]], 2).tolist() == [True, False, True]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 28])
def test_distances_match_plain_counts(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0x0FFF00FF0F0F00FF)
    want = np.bitwise_count(f[:130, None] ^ f[None, :]) <= radius
    assert (S.Lanes(f).met(f[:130], np.zeros((130, 300), bool), radius) == want).all()


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(5000)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "PIECE", 97)
    assert S.fingerprint(text) == whole == slow_print(text.decode())


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("few", [0, 300_000])
def test_components_of_a_path(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(7, 7), (None, 3)], "a long, b long").repartition(7)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(1, 201)}
