import math
import random
from collections import Counter, defaultdict

import pytest

from folioscope.llm import suffix_tree_lm as L


def texts(seed=7):
    rng = random.Random(seed)
    out = []
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 60):
            w += rng.choice([["The", "cat", "sat", "down"], ["a", "dog"], ["the"], ["É" + str(rng.randint(0, 40))], ["of", "the", "cat"]])
        out.append(" ".join(w) if rng.random() < 0.9 else "\n\t".join(w))
    return out


def tokens(t):
    return [*(x.encode().lower() for x in (t or "").split()), b"\n"]


class Slow:
    """The same tree over plain dictionaries."""

    def __init__(self, docs):
        seqs = [tokens(t) for t in docs]
        self.c = Counter(w for s in seqs for w in s)
        self.N, self.V = sum(self.c.values()), len(self.c)
        least = L.LEAST
        self.states = {}
        total = {(w,): n for w, n in self.c.items() if n >= least and w != b"\n"}
        for d in range(1, L.DEPTH + 1):
            nxt = defaultdict(Counter)
            for s in seqs:
                for i in range(d, len(s)):
                    if tuple(s[i - d : i]) in total:
                        nxt[tuple(s[i - d : i])][s[i]] += 1
            new, grown = {}, {}
            for ctx, counts in nxt.items():
                strong = {}
                for a, n in counts.items():
                    if n >= least:
                        if a != b"\n":
                            grown[ctx + (a,)] = n
                        below = self.p(ctx[1:], a)
                        if n / total[ctx] > below and n * math.log(n / total[ctx] / below) > L.ENTRY_GAIN:
                            strong[a] = (n, below, n * math.log(n / total[ctx] / below))
                if sum(g for _, _, g in strong.values()) > L.CONTEXT_GAIN:
                    p = {a: (n - L.DISCOUNT) / total[ctx] for a, (n, _, _) in strong.items()}
                    new[ctx] = (p, max(1 - sum(p.values()), 1e-12) / max(1 - sum(b for _, b, _ in strong.values()), 1e-12))
            self.states |= new
            total = grown

    def p(self, ctx, a):
        while ctx and ctx not in self.states:
            ctx = ctx[1:]
        if not ctx:
            return (self.c[a] + 0.5) / (self.N + 0.5 * (self.V + 1))
        p, rest = self.states[ctx]
        return p[a] if a in p else rest * self.p(ctx[1:], a)

    def score(self, t):
        s = tokens(t)
        return sum(math.log10(self.p(tuple(s[max(0, i - L.DEPTH) : i]), a)) for i, a in enumerate(s))


@pytest.mark.parametrize("lookup,bits", [(500_000, 26), (20, 26), (0, 8)])
def test_matches_plain_tree(spark, monkeypatch, lookup, bits):
    """Whatever tasks look up themselves and whatever the bitmaps let through."""
    monkeypatch.setattr(L, "LOOKUP", lookup)
    monkeypatch.setattr(L, "WORDS", lookup)
    monkeypatch.setattr(L, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(L, "MOST_BITS", bits)
    train, held = texts(), [*texts(8)[:20], None, "", "unseen words only", "the cat " * 4000]
    rows = [(i, t, False, "x") for i, t in enumerate(train)] + [(1000 + i, t, True, "x") for i, t in enumerate(held)] + [(1000, held[0], True, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, word string").repartition(3)
    tree = L.fit(docs.where("not held_out"))
    got = L.scored(docs, tree).collect()
    assert len(got) == len(rows)
    slow = Slow(train)
    assert slow.states
    by_id = {d: t for d, t, *_ in rows}
    for r in got:
        s = tokens(by_id[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(slow.c[w] > 0 for w in s), slow.N)
        assert r.base_score == pytest.approx(sum(math.log10((slow.c[w] + 0.5) / (slow.N + 0.5 * (slow.V + 1))) for w in s))
        assert r.score == pytest.approx(slow.score(by_id[r.doc_id]))
    assert sum(r.score - r.base_score for r in got if 1000 <= r.doc_id < 1020) > 0


def test_tree_grows_with_the_text(spark):
    """A run that few documents repeat is retained at every size of the corpus."""
    rare = "zab zeb zib zob zub"
    rows = [(" ".join(f"w{i}x{k}" for k in range(400)),) for i in range(300)] + [(rare,)] * 20
    small, large = (L.fit(spark.createDataFrame(r, "text string")).entries.count() for r in (rows[-40:], rows))
    assert small == large > 0
    more = [(f"q{i % 50} r{i % 50} s{i % 50} t{i % 50}",) for i in range(1500)]
    assert L.fit(spark.createDataFrame(rows + more, "text string")).entries.count() > large + 40


def test_packed_counts_lose_nothing():
    """Every run of LEAST occurrences passes, whatever tasks they are spread over, and few others do."""
    import numpy as np
    import pyarrow as pa

    class Everything:
        value = (np.full(1 << 10, ~np.uint64(0)), 16)

    docs = texts() * 2 + texts(9)
    count = Counter()
    packed = []
    for k in range(3):
        own = docs[k::3]
        packed += list(L._count_runs(iter([pa.RecordBatch.from_arrays([pa.array(own)], ["text"])]), 1, Everything, 7))
        for _, _, h, first in L.tokens(pa.array(own)):
            run = L.runs(h, first, 2)[1]
            count.update(run[run != 0].tolist())
    rows = sorted(((b, low, n) for p in packed for b, low, n in zip(*(c.to_pylist() for c in p.columns))), key=lambda r: r[0])
    got = [int(x) & (2**64 - 1) for p in L._frequent(iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "low", "n"])]), 7, L.LEAST) for x in p.column(0).to_pylist()]
    assert L.LEAST == 3
    assert sorted(got) == sorted({key >> 25 << 25 for key, n in count.items() if n >= L.LEAST})


def test_states_sum_to_one():
    slow = Slow(texts())
    words = [*slow.c, b"unseen"]
    for ctx in list(slow.states)[:40]:
        assert sum(slow.p(ctx, w) for w in words) == pytest.approx(1)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    tree = L.fit(docs.where("false"))
    (r,) = L.scored(docs, tree).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == r.score == 0
    tree = L.fit(docs)
    assert L.scored(docs.where("false"), tree).collect() == []


def test_size_of_the_tree_over_the_test_tables(spark):
    """What three occurrences give; a higher least count would lose most of it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(doc_id as string)) % 5 <> 1")
    tree = L.fit(docs)
    assert (tree.contexts.count(), tree.entries.count()) == (9009, 16218)


def test_nothing_is_asked_for_behind_a_known_entry():
    """The check's disk: a known entry settles its token whatever shorter contexts may be elsewhere, and the others' bitmap lets few keys through that are not there."""
    import numpy as np

    h = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 5])
    run = L.runs(h, first, L.DEPTH + 1)
    every = (np.full(1 << 10, ~np.uint64(0)), 16), (0,)
    known = lambda key, others: L.Known(np.array(key, np.uint64), np.full(len(key), -1.0), others)
    gain, asked = L.gains(known([], every), known([run[3][4]], every), h, first)
    assert gain[4] == -1 and all(4 not in token for _, token, *_ in asked)
    assert sorted(at for at, token, *_ in asked if 3 in token) == [2, 3, 4, 5, 6, 7]
    gain, asked = L.gains(known([run[0][3]], None), known([], every), h, first)  # a context that is not retained has no entries
    assert [(at, token.tolist(), replaced.tolist()) for at, token, _, replaced in asked] == [(3, [4], [-1.0])] and gain[4] == -1


def test_exchanges_leave_the_disk(spark):
    """What a cut was made of is deleted when it is written, not when the driver collects its garbage."""
    import time

    from folioscope.llm.common import materialize

    held = lambda: [f for f in (x.getName() for x in iter_java(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.startswith("shuffle_")]

    def iter_java(seq):
        return [seq.apply(i) for i in range(seq.size())]

    before = set(held())
    cut = materialize(spark.range(1000).groupBy("id").count())
    until = time.time() + 20
    while set(held()) - before and time.time() < until:
        time.sleep(0.2)
    assert not set(held()) - before and cut.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_questions_travel_as_blocks(spark, monkeypatch):
    """The check's disk: what tasks do not know themselves leaves them in blocks, a few for each bucket, not in a row for each token and depth."""
    monkeypatch.setattr(L, "LOOKUP", 0)
    monkeypatch.setattr(L, "WORDS", 0)
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts() * 4)], "doc_id long, text string, held_out boolean").repartition(2)
    tree, cuts, real = L.fit(docs), [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df: cuts.append(real(df)) or cuts[-1])
    got = L.scored(docs, tree).agg({"n_tokens": "sum", "n_known": "sum"}).first()
    assert got[0] == got[1] == tree.tokens > 8_000
    assert sum(c.count() for c in cuts) <= docs.count() + 2 * 3 * 64


def test_what_an_entry_adds():
    """Contexts' factors and what entries add give a token's gain, whatever else is found."""
    import numpy as np

    slow = Slow(texts())
    for ctx, (p, rest) in slow.states.items():
        for word, own in p.items():
            gain = 0.0
            for k in range(1, len(ctx) + 1):
                if ctx[-k:] in slow.states:
                    known, factor = slow.states[ctx[-k:]]
                    gain += np.log10(factor)
                    gain += np.log10(known[word] / factor / slow.p(ctx[len(ctx) - k + 1 :], word)) if word in known else 0
            assert gain == pytest.approx(np.log10(own / slow.p((), word)))
