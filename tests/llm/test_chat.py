from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat as C

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE:", "[/ROLE]", "\\", "\\\\", "<|image:0|>", "<|audio:12|>", " ", "\n", "é", "]", "[", "<", "ok", "😀"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "", "a]\\b", None]))
def test_reads_back(text, role):
    out = C.render(role, [{"type": "text", "text": text}])
    assert C.read_back(out["segment"]) == (role or "", text)
    learned = C.unescape(out["segment"][out["loss_start"] : out["loss_end"]])
    assert learned == (text if role == "assistant" else "")
    bare = C.escape(text)
    assert not any(p in bare.replace("\\" + p, "") for p in ("</s>", "[INST]"))


def test_typed_parts():
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 30, "height": 14}, None, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": None, "pages": 2}, {"type": None, "text": "!"}]
    out = C.render("user", parts)
    assert out["segment"] == "[INST] see \\<|image:0|> <|image:0|><|audio:1|><|document:2|>! [/INST]"
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", None, 1024)]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "a</s>b", "x"), (1, 0, "user", "hi", "x"), (2, 0, None, None, "x"), (None, 0, "user", "alone", "x"), (3, None, "assistant", "", "x"), (3, 5, "assistant", "é" * 40000, "x"), (1, 2, "assistant", "c", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r.conv: r for r in C.conversation_digests(C.formatted_turns(df)).collect()}
    digest = lambda s: sha256(s.encode()).hexdigest()
    assert len(got) == 4
    assert got[1].turns_sha256 == digest("user\nhi\nassistant\na</s>b\nassistant\nc\n") and got[1].loss_sha256 == digest("a</s>bc") and got[1].loss_chars == 7 and got[1].n_turns == 3
    assert got[2].turns_sha256 == digest("\n\n") and got[2].loss_sha256 == digest("") and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].loss_chars == 40000
    assert C.conversation_digests(C.formatted_turns(df.where("false"))).collect() == []


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "t", None, None), ("image", None, "r", 28)]), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int>>")
    got = sorted((r.turn, r.segment) for r in C.formatted_turns(df, text_col=None, parts_col="parts").collect())
    assert got == [(0, "[INST] t<|image:0|> [/INST]"), (1, "[OUT] </s>")]
