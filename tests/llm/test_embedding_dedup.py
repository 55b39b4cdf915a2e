import numpy as np
import pytest

from folioscope.llm import embedding_dedup as E


def slow(rows, cosine=0.95):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) else None for _, v in rows]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, links[i], least.get(root(i)), d is not None and d == least.get(root(i))) for i, (d, _) in enumerate(rows)]


def clusters(dim, groups, seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in groups:
        c = rng.normal(size=dim)
        for _ in range(size):
            v = c / np.linalg.norm(c) + rng.normal(size=dim) * 0.18 / np.sqrt(dim)
            rows.append((k, [float(x) for x in (v * rng.uniform(0.1, 5)).astype(np.float32)]))
            k += 1
    return rows


@pytest.mark.parametrize("block,per_list,sample,probes", [(40, 256, 16_384, 8), (4096, 4, 60, None), (7, 8, 60, None)])
def test_matches_brute_force(spark, monkeypatch, block, per_list, sample, probes):
    """One list, flat lists, and lists that are divided again; probing all of them loses nothing."""
    for name, value in (("BLOCK", block), ("PER_LIST", per_list), ("SAMPLE", sample)):
        monkeypatch.setattr(E, name, value)
    rows = clusters(6, [1] * 60 + [3] * 20 + [150], 1)
    rows += [(900, rows[4][1]), (900, rows[4][1]), (901, None), (902, []), (903, [0.0] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [float("nan")] * 6), (906, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (907, rows[4][1][:5]), (None, rows[9][1]), (908, [2 * x for x in rows[9][1]])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(3)
    got = sorted((tuple(r) for r in E.near_duplicate_vectors(df, probes=probes).collect()), key=str)
    assert got == sorted(slow(rows), key=str)


def test_recall_in_64_dimensions(spark):
    rows = clusters(64, [1] * 500 + [2] * 250 + [5] * 40, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in E.near_duplicate_vectors(df).collect()}
    want = {d: n for d, n, _, _ in slow(rows)}
    assert all(got[d] <= want[d] for d in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_lists_grow_with_the_vectors(monkeypatch):
    """Beyond what the sample trains, lists are divided; pairs at the very threshold are still found by few probes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.0411
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert 0.945 < np.einsum("ij,ij->i", x, y).mean() < 0.955
    for total, lists in ((20_000, 78), (400_000, 1562), (4_000_000, 15_000)):
        index = E.fit(x[:4000], total)
        assert lists <= len(index.coarse) * len(index.fine) <= 1.5 * lists
        (hx, vx), (hy, vy) = (E.probes(z[:1000], index, 0.1**0.5, E.PROBES) for z in (x, y))
        found = [a == b or b in p or a in q for a, b, p, q in zip(hx, hy, vx, vy)]
        assert np.mean(found) > 0.9 and max(map(len, vx)) <= E.PROBES


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicate_vectors(df).collect() == []
    one = spark.createDataFrame([(3, None), (None, None)], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in E.near_duplicate_vectors(one).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, False)]
