import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioscope.llm import merkle_manifest as M

DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def plain(rows):
    """A tree built level by level with lists, and every leaf's siblings from the leaf upwards."""

    def grown(nodes):
        ways = [[] for _ in nodes]
        level, below = nodes, [[i] for i in range(len(nodes))]
        while len(level) > 1:
            up, under = [], []
            for i in range(0, len(level), 3):
                run = level[i : i + 3]
                for j, leaves in enumerate(below[i : i + 3]):
                    for x in leaves:
                        ways[x].append((j, run[:j] + run[j + 1 :]))
                up.append(h(run))
                under.append(sum(below[i : i + 3], []))
            level, below = up, under
        return level[0], ways

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots = [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, ways = grown([leaf(r) for r in own])
        subroots.append(subroot)
        out.append((own, ways))
    root, above = grown(subroots)
    for (own, ways), subroot, up in zip(out, subroots, above):
        for r, way in zip(own, ways):
            whole = way + up
            yield r[0], leaf(r), subroot, root, h([d for _, others in whole for d in others]), [(j, o) for j, o in whole]


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "a", "é", "z" if i % 2 else "hot", "hot", "hot", "hot", f"s{i % 40}"])
        rows.append((None if i % 29 == 0 else i // 2 if i % 5 == 0 else i, None if i % 31 == 0 else rng.choice(["", "x\ny", "word " * (i % 7), "é\n" * 3]), rng.choice([None, "en"]), source, None if i % 17 == 0 else i, "clash", "clash"))
    return rows + rows[:3] * 2


def found(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return M.with_proofs(M.digests(df, tampered))


@pytest.mark.parametrize(("seed", "n", "levels"), [(1, 700, 2), (2, 90, 1), (3, 400, 4)])
def test_same_as_plain_trees(spark, monkeypatch, seed, n, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "PAGE", 3**levels)
    rows = table(seed, n)
    proved = found(spark, rows)
    got = sorted(((r.id, r.leaf, r.subroot, r.root, h([d for s in r.path for d in s.others]), str([(s.digit, list(s.others)) for s in r.path])) for r in proved.collect()), key=str)
    assert got == sorted(((*r[:5], str(r[5])) for r in plain(rows)), key=str)
    texts = {leaf(r): r for r in rows}
    for r in M.checked(proved).collect():
        changed = r.changed is not None
        assert changed == (r.id is not None and r.id % 2 == 0 and "\n" in (texts[r.leaf][1] or ""))
        assert (r.folded_root == r.root) == (not changed)


def test_lone_leaf_lone_source_and_empty_table(spark):
    one = [(5, "t", "en", "s", 1, "", "")]
    (r,) = M.checked(found(spark, one)).collect()
    assert (r.leaf, r.subroot, r.root, r.folded_root, r.proof_sha256) == (leaf(one[0]), leaf(one[0]), leaf(one[0]), leaf(one[0]), h([]))
    assert M.checked(found(spark, [])).collect() == []
    two = [(5, "t", "en", None, 1, "", ""), (6, None, "en", None, 1, "", "")]
    assert {r.root for r in M.checked(found(spark, two)).collect()} == {h([leaf(x) for x in two])}


def test_records_lead_from_digest_to_children(spark):
    leaves = spark.createDataFrame([("t", i, 300, h([str(i)])) for i in range(300)], "tree string, rank long, n long, digest string")
    manifest = M.build(leaves)
    records = {r["digest"]: list(r["children"]) for page in manifest.records.collect() for r in page["records"]}
    assert all(h(c) == d and 1 <= len(c) <= 3 for d, c in records.items())
    (top,) = manifest.tops.collect()
    frontier = [top.digest]
    while frontier[0] in records:
        frontier = [c for d in frontier for c in records[d]]
    assert frontier == [h([str(i)]) for i in range(300)]


def test_some_requests_only(spark):
    leaves = spark.createDataFrame([("t", i, 500, h([str(i)])) for i in range(500)], "tree string, rank long, n long, digest string")
    manifest = M.build(leaves)
    asked = spark.createDataFrame([("t", i, 500) for i in (0, 81, 257, 499)], "tree string, rank long, n long").withColumn("own", F.struct(F.col("rank").alias("id")))
    got = M.proofs(manifest, manifest.tops.withColumn("path", F.array().cast(M.SEGMENTS)), asked).collect()
    assert sorted((r.own.id, r.digest) for r in got) == [(i, h([str(i)])) for i in (0, 81, 257, 499)]
    for r in got:
        assert M.folded(r.digest, [s.asDict() for s in reversed(r.path)]) == r.top


def test_ranks_of_one_tree_come_from_many_tasks(spark):
    rows = spark.range(0, 20000, 1, 16).select(F.lit("t").alias("tree"), ((F.col("id") * 7919) % 20000).alias("k"))
    got = M.ranked(rows, "tree", ["k"]).collect()
    assert len(got) == 20000 and all(r["rank"] == r.k and r.n == 20000 for r in got)
