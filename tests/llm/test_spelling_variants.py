import random
import zlib
from collections import Counter

import pytest

from folioscope.llm import spelling_variants as V
from folioscope.llm.fm_index import BidirectionalIndex, suffix_order


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    form = {}
    out = {}
    for w, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if near(w, o))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        form[w] = best[1] if best else None
        out[w] = [n, len(others), -best[0] if best else None]
    for w, (n, n_near, form_n) in out.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, n_near, form_n


def words_of(rows):
    """Words and counts of documents, one code point at a time."""
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "xyzwÿÀ"])
def test_index_finds_what_comparing_finds(alphabet):
    rng = random.Random(alphabet)
    for _ in range(12):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(150)})
        index = BidirectionalIndex(words)
        queries = [w for w in words if len(w) > 1] + ["".join(rng.choice(alphabet + "q") for _ in range(rng.randint(2, 9))) for _ in range(40)]
        for length in {len(q) for q in queries}:
            own = [q for q in queries if len(q) == length]
            half = length // 2
            for first in (True, False):
                got = set(zip(*(x.tolist() for x in index.near(own, first))))
                assert got == {(i, j) for i, q in enumerate(own) for j, w in enumerate(words) if near(q, w) and (w[:half] == q[:half] if first else w.endswith(q[half:]))}


def test_suffix_order():
    rng = random.Random(2)
    import numpy as np

    for n in (1, 2, 50, 3000):
        text = np.array([rng.choice((0, 1)) if n < 3000 else i % 3 for i in range(n)])
        assert suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("capacity", [V.CAPACITY, 400])
def test_groups_same_as_all_pairs(spark, capacity):
    rng = random.Random(5)
    # every third word begins alike, so that a pair of letters is more than a block; ties, chains of forms and long words
    counts = {("hot" if i % 3 == 0 else "") + "".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): rng.choice((3, 3, 4, 7, 8, 20, 50, 200)) for i in range(300)}
    counts |= {"chain": 3, "chains": 7, "chainss": 20, "x" * 3000: 9, "x" * 2999 + "y": 3, "lonely": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, V.grouped(words, capacity).collect()))
    assert got == sorted(plain(counts))
    assert ("chain", "chains", "chainss", 3, 1, 7) in got


def test_words_of_documents(spark, monkeypatch):
    rng = random.Random(9)
    base = ["Garden", "garden", "GARDENÉ", "Über", "straße", "maison×", "naïveté", "word", "letters", "日本語letters", "a1letters", "ELEVEN-twelve", "ünïcödé", "İstanbul"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(60)), "x", 1) for i in range(120)]
    rows += [(None, "garden " * 50, "x", 1), (None, None, "x", 1), (7, "", "x", 1), (8, "long" * 5000, "x", 1)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = words_of([(r[0], r[1]) for r in rows])
    assert dict(map(tuple, V.word_counts(docs).collect())) == want
    monkeypatch.setattr(V, "HELD", 3)
    assert dict(map(tuple, V.word_counts(docs).collect())) == want
    assert sorted(map(tuple, V.grouped(V.word_counts(docs)).collect())) == sorted(plain(want))


def test_empty_tables(spark):
    assert V.grouped(spark.createDataFrame([], "word string, n long")).collect() == []
    assert V.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_hold_no_more_than_their_capacity():
    sizes = [(s, p, n) for s in (0, 1) for p, n in (("aa", 10), ("ab", 95), ("ba", 20), ("bb", 60), ("bc", 30), ("ca", 250))]
    plan = V.blocks(sizes, 100)
    held, used = Counter(), Counter()
    for (s, p, n), (side, pair, first, parts) in zip(sizes, plan):
        assert (s, p) == (side, pair) and parts == -(-n // 100)
        for b in range(first, first + parts * parts):
            used[b] += 1
            held[b] += n if parts == 1 else 0
    assert max(held.values()) <= 100 and sorted(used) == list(range(max(used) + 1))
    assert all(used[b] == 1 for _, _, first, parts in plan if parts > 1 for b in range(first, first + parts * parts))
