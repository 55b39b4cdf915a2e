import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Codec(PATH)

TEXTS = [
    "", " \n\t", "Hello, world! it's they'll I'D", "ΣΟΦΟΣ Σ ΑΣ.", "İstanbul ǅ ß ẞ", "éà", "a b c\u0085d\u001ce\u001ff",
    "<|startoftext|>x <|endoftext|><|endoftext|> y<|endoftext", "日本語のテキスト 😀👍🏽 ١٢٣ ½²", "a" * 500, "ab" * 3000 + "1" * 100, "!" * 300 + "?!" * 90, "don't'sa 'S 's", "\x00\x01x\x7f", "né naïve",
]


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert got == want, text
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeéçßüñ THEing'sdlrtvm.,!?0123 \n 日ア😀<|>_-")), max_size=80))
def test_random_texts(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=150, max_size=500))
def test_long_fragments(text):
    same(text)


def test_cuts_are_certain():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeqxzjvkñéß日") for _ in range(12))
        raw = word.encode()
        whole = [OWN.inner[b] for b in raw[:-1]] + [OWN.last[raw[-1]]]
        assert [x for f in OWN.fragments(word) for x in OWN.merged(f)] == OWN._merged_long(whole)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own = bpe.Codec(PATH)
    text = " ".join(f"word{i % 11} it's{i}, the" for i in range(60))
    assert own.encode(text) == own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own.cache) <= 3 and len(own.cache.old) <= 3


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for d, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    ids = bpe.encoded(docs, PATH)
    assert sorted(r.text for r in bpe.decoded(ids, PATH).collect()) == sorted(LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, _ in rows)
    assert bpe.digests(docs.where("false"), PATH).collect() == []
