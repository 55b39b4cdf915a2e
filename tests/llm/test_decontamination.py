import random
import re

from folioscope.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow(docs, items):
    windows = []
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if w else []
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, own = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own.add(i)
        out.append((d, len(w), len(hit), sorted(str(i) for i in own if i is not None)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = ["Ab", "çé", "x1", "of", "the", "É", "zz", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(2, 14)] + [(2, text(12)), (50, None), (51, " ?! "), (None, text(14)), (10, "q Q q")]
    long = [t for _, t in items if t and len(t.split()) > 8]
    docs = [(k, text(30) + " " + rng.choice(long).upper().replace("É", "É") + "\n" + text(5)) for k in range(25)]
    docs += [(60, None), (61, ""), (62, "q-q.q q"), (62, "q-q.q q"), (62, "other"), (63, text(9) * 300), (None, rng.choice(long)), (64, long[0] + "x")]
    a = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, words string").repartition(3)
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h int").repartition(2)
    found = D.contamination(a, b)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()), key=str)
    assert got == slow(docs, items)
    kept = D.drop_contaminated(a, b)
    assert kept.columns == a.columns
    clean = sorted((d for (d, *_), (_, t) in zip(docs, docs) if slow([(d, t)], items)[0][2] == 0), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.contamination(docs, items).collect()] == [(3, 0, [])]
    assert D.contamination(docs.where("false"), items).collect() == []
