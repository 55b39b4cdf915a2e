import zlib
from collections import Counter

from folioscope.llm import sharding as S


def slow_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


KEYS = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789012345, *range(2000)]


def test_jump_matches_the_published_loop(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = {r.k: r.shard for r in S.with_shard(df, "k", n).collect()}
        assert got == {k: slow_jump(k, n) for k in KEYS}


def test_other_keys_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, shard_of int")
    rows = S.with_shard(df, "k", 8).collect()
    assert rows[0].shard == rows[1].shard and rows[2].shard == slow_jump(0, 8)


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 3)
    rows = [(k % 500, f"é{k % 7}", "law") for k in range(1200)] + [(5, None, "x")] * 9 + [(None, "", "x")] * 8
    docs = spark.createDataFrame(rows, "doc_id long, text string, law string").repartition(5)
    got = S.assigned(docs, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    for r in got:
        assert r.law == "key" and r.shard == slow_jump(r.doc_id or 0, 16) and r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty(spark):
    assert S.assigned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
