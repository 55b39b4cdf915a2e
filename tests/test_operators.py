"""Row-level facts that the operators must keep, and plain Python models of the order-dependent ones."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import providers
from folioscope.functions import text as T
from folioscope.operators import explain, figures, grounding, layout, reads, sections
from folioscope.plans import pipeline
from folioscope.schemas import DDL, schema
from folioscope.sources import tables
from folioscope.streaming import ingest


def column(spark, values, build):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(build(F.col("x"))).collect()]


def test_explicit_references(spark):
    texts = ["Figure 1: the caption", "as Figure 1 shows", "see Fig. 1 and Figure 1", "nothing here", "Figure 10 is another", "config. 1 and Figures 1 and 2", "😀 fig.1, Figure 01", "Fig. 1 short caption", "Fig. 1 (middle) " + "long " * 40]
    p = spark.createDataFrame([(1, i, t, i) for i, t in enumerate(texts)], "paper_id int, paragraph_id int, text string, ord int")
    f = spark.createDataFrame([(1, 7, "Figure 1"), (1, 8, "Figure ?3"), (2, 9, "Figure 1"), (1, 10, "Figure 01")], "paper_id int, figure_id int, figure_number string")
    got = sorted((r.figure_id, r.paragraph_id, r.quote_span) for r in grounding.explicit_matches(f, p).collect())
    assert got == [(7, 1, [3, 11]), (7, 2, [4, 10]), (7, 6, [2, 7]), (7, 8, [0, 6]), (10, 6, [9, 18])]


def test_semantic_candidates(spark):
    long = "x" * 80
    body = [long, long, long, long, "short", "Figure 2: " + long, "[3] " + long, "Table 1. " + long]
    cosines = [1.0, 0.66, 0.60, 1.0, 1.0, 1.0, 1.0, 1.0]
    p = spark.createDataFrame([(1, i, t, i) for i, t in enumerate(body)], "paper_id int, paragraph_id int, text string, ord int")
    v = spark.createDataFrame([(i, [c, (1 - c * c) ** 0.5]) for i, c in enumerate(cosines)], "paragraph_id int, embedding array<double>")
    f = spark.createDataFrame([(1, 5, 0.3)], "paper_id int, figure_id int, extraction_confidence double")
    c = spark.createDataFrame([(5, [1.0, 0.0])], "figure_id int, embedding array<double>")
    explicit = spark.createDataFrame([(5, 3)], "figure_id int, paragraph_id int")
    found = grounding.semantic_candidates(f, p, c, v, explicit)
    assert [(r.paragraph_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(0, 1), (1, 2)]
    tied = grounding.semantic_candidates(f, p, c, v, explicit.where("false"), top_k=1)
    assert [r.paragraph_id for r in tied.collect()] == [3]
    verdicts = found.select("figure_id", "paragraph_id", F.lit(True).alias("relevant"))
    assert {r.relevance_score for r in grounding.semantic_matches(found, f, verdicts).collect()} == {0.3}


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_similar_in_blocks(spark, block):
    """Papers larger than a block, equal vectors, zero and missing ones, pairs that are left out: the same as one pair after another."""
    rng = random.Random(6)
    vectors = [[rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)] for _ in range(9)] + [[0.0] * 4, None, [1.0, 2.0]]
    figs = [("p" if i % 5 else "q", f"f{i}", vectors[i % len(vectors)]) for i in range(17)]
    paras = [("q" if i % 4 == 1 else "p", f"t{i}", i, vectors[(i * 5) % len(vectors)], [f"f{i % 17}", "none"] if i % 3 == 0 else None) for i in range(40)]

    def cosine(a, b):
        a, b = a or [], b or []
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want_all, want = [], []
    for paper, f, v in figs:
        own = [(cosine(v, w), o, t) for q, t, o, w, out in paras if q == paper and f not in (out or [])]
        want_all += [(f, t, round(c, 9)) for c, _, t in own]
        best = sorted((x for x in own if x[0] >= 0.3), key=lambda x: (-x[0], -x[1]))[:4]
        want += [(f, t, k + 1) for k, (_, _, t) in enumerate(best)]
    heads = grounding.with_norm(spark.createDataFrame(figs, "paper_id string, figure_id string, embedding array<double>"))
    body = grounding.with_norm(spark.createDataFrame(paras, "paper_id string, paragraph_id string, ord int, embedding array<double>, excluded array<string>"))
    got = [(r.figure_id, r.paragraph_id, round(r.similarity, 9)) for r in grounding.similar(heads, body, block=block).collect()]
    assert sorted(got) == sorted(want_all)
    texts = spark.createDataFrame([(q, t, o, "x" * 90) for q, t, o, _, _ in paras], "paper_id string, paragraph_id string, ord int, text string")
    explicit = body.where("excluded is not null").select("paragraph_id", F.explode("excluded").alias("figure_id"))
    found = grounding.semantic_candidates(heads, texts, heads, body, explicit, top_k=4, least=0.3, block=block)
    assert sorted((r.figure_id, r.paragraph_id, r["rank"]) for r in found.collect()) == sorted(want)


def test_verdicts_and_quotes(spark):
    answers = ['{"is_relevant": true, "reason": "ok"}', "prose", 'x {"is_relevant": true} y', '{"is_relevant": true', '{"is_relevant": "no"}', '{"is_relevant": "false"}', '{"is_relevant": ""}', '{"is_relevant": 0}', '{"is_relevant": []}', '{"is_relevant": null}', "{}"]
    assert column(spark, answers, lambda x: T.verdict(x)["is_relevant"]) == [True, False, True, False, True, True, False, False, False, False, False]
    reasons = ["it says “stacked  Layers of” it", "no quote", 'it says "invented words here"', 'a "short" one']
    assert column(spark, reasons, lambda x: T.not_fabricated(x, F.lit("The stacked layers of it"))) == [True, True, False, True]


def test_korean_gates(spark):
    texts = ["이 그림은 구조를 보여 줍니다. 값은 큽니다 (512 samples).", "이 그림은 전체 구조를 보여 준다.", "구조를 보여 주는 그림 전체입니다. 변환 變換입니다.", "Дa 그림 전체를 보여 줍니다.", "", "short 입니다"]
    assert column(spark, texts, lambda x: T.clean_style(x)) == [True, False, False, False, False, True]
    assert column(spark, texts, lambda x: T.looks_korean(x)) == [True, True, True, True, False, False]


def test_types_and_scalars(spark):
    captions = ["Figure 1: Training error of the network", "Figure 2: Attention head visualization", "Figure 3: The encoder", "Figure 4: A garden", "Fig. 5. Glossy paper", "Example of a  residual\nfunction"]
    assert column(spark, captions, T.figure_type) == ["plot", "qualitative", "architecture", "other", "plot", "qualitative"]
    assert column(spark, ["Fig. 3 A window", "figure 12: x", "Figure 1x"], T.caption_label) == ["Figure 3", "Figure 12", None]
    assert column(spark, ["local://a/b.png"], reads.resolved_uri) == ["a/b.png"]
    with pytest.raises(Exception, match="unsupported address"):
        column(spark, ["s3://a"], reads.resolved_uri)
    assert column(spark, ["a.PDF", "a.txt", None, ""], lambda x: reads.upload_error(x, F.lit(3))) == [None, "not a pdf", None, None]


def random_lines(rng, paper):
    out = []
    for page in (1, 2):
        for block in range(rng.randint(1, 5)):
            y = 0.0
            for line in range(rng.randint(1, 6)):
                y += rng.choice([0, 2, 4, 9, 12])
                text = rng.choice(["1 Intro Words", "Abstract", "12", "lower start", "Upper start", "broken-", "next", "2.1 Method here", "41.29 28.4", "References"])
                out.append((paper, page, block, line, float(rng.choice([0, 50])), y, 100.0, y + rng.choice([8, 10, 14]), text, rng.choice([10.0, 12.0]), rng.random() < 0.5))
    return out


def slow_rows(lines):
    rows = []
    for ln in lines:
        y0, y1 = ln[5], ln[7]
        if rows and rows[-1]["key"] == ln[:3]:
            r = rows[-1]
            low = min(r["y1"] - r["y0"], y1 - y0)
            if low > 0 and (min(r["y1"], y1) - max(r["y0"], y0)) / low > 0.5:
                r["lines"].append(ln)
                r["y0"], r["y1"] = min(r["y0"], y0), max(r["y1"], y1)
                continue
        rows.append({"key": ln[:3], "y0": y0, "y1": y1, "lines": [ln]})
    return rows


def slow_join(parts):
    out = ""
    for p in parts:
        out = p if not out else out[:-1] + p if out.endswith("-") and p[:1].islower() else out + " " + p
    return out


def slow_document(lines):
    import re

    weights = {}
    for ln in lines:
        weights[ln[9]] = weights.get(ln[9], 0) + len(ln[8])
    body = max(weights, key=weights.get)
    done, current = [], None

    def add(texts, page):
        text = slow_join(texts)
        paragraphs = current["paragraphs"]
        if paragraphs and text[:1].islower():
            paragraphs[-1] = slow_join([paragraphs[-1], text])
        else:
            paragraphs.append(text)
        current["end"] = max(current["end"], page)

    held, last = [], None
    for row in slow_rows(lines):
        if row["key"] != last:
            if held:
                add(held, last[1])
            held, last = [], row["key"]
        page = row["key"][1]
        text = " ".join(x[8] for x in sorted(row["lines"], key=lambda x: x[4]))
        styled = all(x[10] or x[9] > body + 0.5 for x in row["lines"])
        if re.match(r"^\d{1,4}$", text) and not styled:
            continue
        m = re.match(r"^(\d{1,2}(\.\d{1,2})*)\.?\s+([A-Z][^\s]*(\s+\S+)*)$", text)
        if styled and len(text) <= 120 and (m and re.search("[A-Za-z]{2}", m[3]) or re.match(r"^(Abstract|References)$", text)):
            if held:
                add(held, page)
            held = []
            current = {"title": text, "start": page, "end": page, "paragraphs": []}
            done.append(current)
            continue
        if current is None:
            current = {"title": "Front Matter", "start": page, "end": page, "paragraphs": []}
            done.append(current)
        held.append(text)
    if held:
        add(held, last[1])
    return [(i, s["title"], s["start"], s["end"], s["paragraphs"]) for i, s in enumerate(done)]


def test_sections_match_a_sequential_model(spark):
    rng = random.Random(9)
    papers = {p: random_lines(rng, p) for p in range(60)}
    lines = spark.createDataFrame([x for p in papers.values() for x in p], "paper_id int, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, max_size double, bold boolean").repartition(3)
    rows = layout.rows_of_lines(lines).join(layout.body_size_of_lines(lines), "paper_id").withColumn("styled", sections.styled())
    rows = sections.segmented(rows).cache()
    parts = sections.fragments(rows).cache()
    texts = {}
    for r in sections.paragraphs(parts).collect():
        texts.setdefault((r.paper_id, r.section_order), []).append((r.order, r.text))
    got = {p: [] for p in papers}
    for r in sections.sections(rows, parts).collect():
        got[r.paper_id].append((r.section_order, r.title, r.page_start, r.page_end, [t for _, t in sorted(texts.get((r.paper_id, r.section_order), []))]))
    for p, own in papers.items():
        assert sorted(got[p]) == slow_document(own), p


def test_figure_cases(spark):
    """Body above an empty zone; a rectangle above a short loose caption; a long sentence that only looks like a caption."""
    blocks = [
        (1, 1, 0, "body text of several lines", 50.0, 100.0, 450.0, 200.0, 4, 10.0, False), (1, 1, 1, "Figure 1: empty zone", 50.0, 500.0, 300.0, 512.0, 1, 10.0, False),
        (1, 2, 0, "Fig. 1 A short caption", 50.0, 400.0, 300.0, 412.0, 1, 10.0, False), (1, 2, 1, "Fig. 2 (middle) " + "shows " * 40, 50.0, 600.0, 450.0, 650.0, 3, 10.0, False),
    ]
    b = spark.createDataFrame(blocks, "paper_id int, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, lines int, mode_size double, all_bold boolean")
    g = spark.createDataFrame([(1, 2, 60.0, 250.0, 280.0, 390.0, False)], "paper_id int, page int, x0 double, y0 double, x1 double, y1 double, raster boolean")
    pages = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0), (1, 2, 0.0, 0.0, 612.0, 792.0)], "paper_id int, page int, x0 double, y0 double, x1 double, y1 double")
    bodies = spark.createDataFrame([(1, 10.0)], "paper_id int, body_size double")
    got = {(r.page, r.figure_number): r for r in figures.figures(*figures.zones(figures.captions(b), b, bodies, g), g, pages).collect()}
    assert set(got) == {(1, "Figure 1"), (2, "Figure 1")}
    empty = got[1, "Figure 1"]
    assert empty.extraction_confidence == 0.3 and empty.method == "render-fallback" and empty.y1 - empty.y0 <= 153.5
    assert got[2, "Figure 1"].extraction_confidence == 0.8 and got[2, "Figure 1"].figure_index == 2


def test_explanations(spark):
    raw = [("architecture", ["p1"], {"summary": "s", "grounding": [{"source": "paragraph", "paragraph_id": "p1"}, {"source": "paragraph", "paragraph_id": "no"}], "components": [{"label": "A"}, {"label": ""}]}), ("plot", [], {"detailed_explanation": "d" * 300, "grounding": [{"source": "caption"}], "components": [{"label": "A"}]})]
    rows = [(i, k, json.dumps(r), ids, "mock", "m") for i, (k, ids, r) in enumerate(raw)] + [(2, "other", "broken {", ["p1"], "mock", "m")]
    got = explain.assembled(spark.createDataFrame(rows, "figure_id int, figure_type string, response string, valid_ids array<string>, provider string, model string")).orderBy("figure_id").collect()
    assert [[g.source for g in r.grounding] for r in got] == [["paragraph"], ["none_found"], ["none_found"]]
    assert [[c.label for c in r.components] for r in got] == [["A"], [], []]
    assert (got[0].detailed_explanation, len(got[1].summary), got[2].detailed_explanation, [r.parse_ok for r in got]) == ("s", 200, "broken {", [True, True, False])


def test_providers(spark):
    vectors = [providers.hashed_vector(t) for t in "aba"]
    assert vectors[0] == vectors[2] != vectors[1] and len(vectors[0]) == 768 and abs(sum(x * x for x in vectors[0]) - 1) < 1e-9
    question = {"system": "s", "prompt": "abc\n", "image": b"png", "max_tokens": 5, "temperature": 0.0}
    answer = json.loads(providers.placeholder(question))
    assert answer["is_relevant"] is False and answer["reason"] == "" and "4자, 이미지 1개" in answer["summary"] and answer["summary"].startswith("[MOCK:")
    for name in ("unknown", "openai", "Anthropic"):
        with pytest.raises(providers.ProviderError):
            providers.completer(name)
    assert providers.completer("MOCK", images=True).sees
    assert [providers.completer("mock-split", images=x).version for x in (False, True)] == ["text", "vision"]
    with pytest.raises(providers.ProviderError, match="no embeddings"):
        providers.embedder("anthropic")
    assert "JSON" in providers.prompt_text("grounding") and "Korean" in providers.prompt_text("explain")
    # every column of a question reaches the model
    told = providers.completed(spark.createDataFrame([("p", b"xy")], "prompt string, image binary"), lambda images: providers.Model("own", "1", lambda q: json.dumps([q["system"], q["prompt"], len(q["image"]), q["max_tokens"], q["temperature"]])), system="sys", temperature=0.4, max_tokens=9, image_col="image").first()
    assert json.loads(told.response) == ["sys", "p", 2, 9, 0.4] and told.model_used == "own:1"
    calls, slept = [], []

    def fails():
        calls.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        providers.retried(fails, sleep=slept.append)
    assert len(calls) == 3 and slept == [1.0, 2.0]
    out = providers.completed(spark.createDataFrame([("p",), (None,)], "prompt string"), "mock").collect()
    assert all(r.error is None and r.model_used == "mock:mock" and json.loads(r.response)["is_relevant"] is False for r in out)
    pictured = spark.createDataFrame([("p", b"x"), ("q", None)], "prompt string, image binary")
    seen = {r.prompt: r for r in providers.completed(pictured, "mock", image_col="image", delay=0.0).collect()}
    assert "이미지 1개" in seen["p"].response and seen["q"].response is None and "image is missing" in seen["q"].error


def test_one_failing_text_is_a_row(spark):
    def choosy(text):
        if text == "bad":
            raise ValueError("cannot")
        return [1.0]

    out = {r.text: r for r in providers.embedded(spark.createDataFrame([("good",), ("bad",), (None,)], "text string"), choosy).collect()}
    assert out["good"].embedding == [1.0] and out[None].error is None
    assert out["bad"].embedding is None and out["bad"].error == "ValueError: cannot"


def test_files_are_stored_and_fetched(spark, tmp_path):
    root = f"file://{tmp_path}/held"
    rows = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", None)], "id string, content binary").withColumn("path", F.concat(F.lit("figures/"), "id", F.lit(".png")))
    for _ in range(2):
        assert sorted(r.uri for r in tables.stored(rows, root).collect()) == [f"local://figures/{x}.png" for x in "abc"]
    named = spark.createDataFrame([("local://figures/a.png",), ("local://figures/b.png",), ("local://figures/gone.png",)], "image_uri string")
    found = {r.image_uri[16:]: r for r in tables.fetched(named, root).collect()}
    assert bytes(found["a.png"].content) == b"one" and found["a.png"].media_type == "image/png" and found["b.png"].error is None
    assert found["gone.png"].content is None and "gone" in found["gone.png"].error
    assert [r.error is None for r in tables.fetched(named, f"file://{tmp_path}/nothing").collect()] == [False] * 3
    # no other file of the store is opened: this one could not be read, and no folder is listed
    with open(tmp_path / "held/figures/huge.png", "wb") as huge:
        huge.truncate(1 << 40)
    assert "FileScan" not in tables.fetched(named, root)._jdf.queryExecution().toString() and "BinaryFile" not in tables.fetched(named, root)._jdf.queryExecution().toString()
    assert tables.fetched(named, root).where("error is null").count() == 2


def test_fetched_files_are_passed_on_by_bytes(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/held"
    rows = spark.range(0, 50, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".png")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    tables.stored(rows, root).collect()
    monkeypatch.setattr(tables, "HELD_BYTES", 7)
    named = spark.range(0, 60, 1, 1).select("id", F.concat(F.lit("local://"), F.col("id").cast("string"), F.lit(".png")).alias("image_uri"))
    got = tables.fetched(named, root).collect()
    assert [bytes(r.content or b"gone").decode() for r in got] == [str(i) if i < 50 else "gone" for i in range(60)] and [r.id for r in got] == list(range(60))
    assert [r.error is None for r in got] == [i < 50 for i in range(60)]


def test_tables_and_stream(spark, tmp_path):
    assert schema("figures").names[0] == "id" and set(DDL) >= {"papers", "sections", "paragraphs"}
    rows = spark.createDataFrame([("a", None, "f.pdf", "done", 1, "local://x", None, None)], schema("papers"))
    arrivals = str(tmp_path / "in")
    rows.write.parquet(arrivals)
    for k in range(2):  # a second run over the same files with a fresh checkpoint adds nothing
        ingest.ingest(ingest.stream(spark, arrivals, schema("papers")), lambda b: b, str(tmp_path), "papers", str(tmp_path / f"c{k}")).awaitTermination()
    assert tables.read(spark, str(tmp_path), "papers").count() == 1
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "y.pdf").write_bytes(b"junk")
    found = tables.opened(tables.files(spark, [str(tmp_path / "x.pdf"), str(tmp_path / "y.pdf")])).collect()
    assert sorted(r.error is None for r in found) == [False, True]


def layout_of(spark):
    span = lambda page, block, line, text, size=10.0, flags=0: ("p", page, block, line, 0, text, size, flags)
    body = "This body paragraph mentions Figure 1 and is long enough to be matched by meaning as well, as it has many words."
    spans = [span(1, 0, 0, "1 Introduction", 12.0, 16), span(1, 1, 0, body), span(1, 2, 0, "Figure 1: The encoder block")]
    lines = [("p", 1, b, 0, 50.0, y, 450.0, y + 12, 1.0) for b, y in ((0, 50.0), (1, 80.0), (2, 400.0))]
    given = {
        "layout_spans": spark.createDataFrame(spans, DDL["layout_spans"]), "layout_lines": spark.createDataFrame(lines, DDL["layout_lines"]),
        "layout_blocks": spark.createDataFrame([("p", 1, b, 0, 50.0, y, 450.0, y + 12) for b, y in ((0, 50.0), (1, 80.0), (2, 400.0))], DDL["layout_blocks"]),
        "layout_rasters": spark.createDataFrame([("p", 1, 5, 60.0, 200.0, 440.0, 390.0)], DDL["layout_rasters"]), "layout_drawings": spark.createDataFrame([], DDL["layout_drawings"]),
        "layout_pages": spark.createDataFrame([("p", 1, 0.0, 0.0, 612.0, 792.0)], DDL["layout_pages"]),
    }
    return spark.createDataFrame([("p",), ("unreadable",)], "paper_id string"), given


def test_pipeline_over_layout_tables(spark, tmp_path):
    papers, given = layout_of(spark)
    at = datetime(2026, 1, 2)
    for _ in range(2):  # the second run adds nothing
        pipeline.store(papers, given, f"file://{tmp_path}", at=at, images=lambda f: f.select("figure_id", F.encode("caption", "UTF-8").alias("image")))
        counts = {t: tables.read(spark, f"file://{tmp_path}", t).count() for t in ("sections", "paragraphs", "figures", "figure_text_matches", "figure_explanations", "paper_status")}
        assert counts == {"sections": 1, "paragraphs": 2, "figures": 1, "figure_text_matches": 1, "figure_explanations": 1, "paper_status": 7}
        assert tables.read(spark, f"file://{tmp_path}", "model_calls").count() == 1  # the second run asks nothing
    (made,) = tables.read(spark, f"file://{tmp_path}", "figure_explanations").collect()
    assert made.generated_at == at and "이미지 1개" in made.summary and made.model_used == "mock:mock"
    log = pipeline.current_status(tables.read(spark, f"file://{tmp_path}", "paper_status"))
    assert {r.paper_id: (r.upload_status, r.error_message) for r in log.collect()} == {"p": ("done", None), "unreadable": ("failed", "no text")}
    (figure,) = tables.read(spark, f"file://{tmp_path}", "figures").collect()
    assert figure.status == "explained"
    (request,) = tables.read(spark, f"file://{tmp_path}", "image_requests").collect()
    assert (request.image_uri, request.dpi, request.xref) == ("local://figures/p/figure_1.png", 200, None)  # the text above belongs to the box
    out = pipeline.run(papers, given)
    assert [(r.title, r.section_order) for r in out.sections.collect()] == [("1 Introduction", 0)]
    (figure,) = out.figures.collect()
    assert (figure.figure_number, figure.status, figure.image_uri) == ("Figure 1", "explained", "local://figures/p/figure_1.png")
    assert [(m.match_type, m.paragraph_id) for m in out.matches.collect()] == [("explicit_reference", "p:0:0")]
    assert out.explanations.count() == 1
    assert {r.paper_id: r.status for r in out.status.collect()} == {"p": "done", "unreadable": "failed"}


def test_cosine_and_overlap(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(G.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
