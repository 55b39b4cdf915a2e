"""What the layout queries move: within a paper nothing is exchanged or stored between the documents and the paragraphs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import checks, layout
from folioscope.plans.layout_queries import QUERIES, Layout
from folioscope.sources import keyed, tables

SF = "/root/testdata/sf0.001"
SPANS = "paper_id int, page int, block_no int, line_no int, span_no int, text string, size double, flags int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["WIN1_WIN2_rows", "WIN3_section_segmentation", "WIN4_AGG10_fragments", "WIN5_WIN6_paragraphs", "SRC2_text_blocks"])
def test_text_is_exchanged_once(spark, name):
    """F7, F8, F15, F22, and the text blocks of F9, F11, F13, F16 to F21, F23, F24: every exchange is the one of the documents by their id, which the readers share; no stage table is read."""
    text = plan(QUERIES[name](spark, SF))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", text) and set(re.findall(r"Exchange hashpartitioning\((\w+)#", text)) == {"doc_id"}
    assert "stage-" not in text and "Join" not in text


def test_unreadable_papers_store_nothing(spark):
    """only ids are joined."""
    assert "stage-" not in plan(QUERIES["AGG8_unreadable_papers"](spark, SF))


def test_spans_are_aggregated_without_a_sort(spark):
    """a paper's sizes are counted by hashing, so a task holds sizes, not spans."""
    text = plan(Layout(spark, SF).bodies())
    assert "stage-" not in text and re.search(r"HashAggregate\(keys?=\[paper_id.*partial_sum\(length", text) and not re.search(r"SortAggregate.*partial_sum", text)


def random_spans(rng):
    return [
        (p, page, b, n, s, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 3))), rng.choice([9.96, 10.0, 10.04, 12.0]), rng.choice([0, 16, 20]))
        for p in range(12) for page in (1, 2) for b in range(3) for n in range(rng.randint(0, 3)) for s in range(rng.randint(1, 3))
    ]


def heaviest(spans):
    """Size of most characters, ties to the size met first, by a plain loop."""
    weight = {}
    for _, page, b, n, s, text, size, _ in sorted(spans, key=lambda x: x[:5]):
        weight[round(size, 1)] = weight.get(round(size, 1), 0) + len(text)
    return max(weight, key=lambda k: weight[k])  # the first of the heaviest: dicts keep the order met


def test_blocks_and_sizes_match_a_plain_loop(spark):
    spans = random_spans(random.Random(5))
    blocks = [(p, page, b, int((p + b) % 5 == 0), 1.0, 2.0, 3.0, 4.0) for p in range(12) for page in (1, 2) for b in range(3)]
    s = spark.createDataFrame(spans, SPANS).repartition(5)
    b = spark.createDataFrame(blocks, "paper_id int, page int, block_no int, type int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for block in blocks:
        own = sorted(x for x in spans if x[:3] == block[:3])
        lines = {n: "".join(x[5] for x in own if x[3] == n) for n in sorted({x[3] for x in own})}
        text = " ".join(" ".join(lines.values()).split())
        inked = [bool(x[7] & 16) for x in own if x[5].strip()]
        if block[3] == 0 and text:
            want[block[:3]] = (text, len(lines), heaviest(own), bool(inked) and all(inked), 1.0, 4.0)
    got = {(r.paper_id, r.page, r.block_no): (r.text, r.lines, r.mode_size, r.all_bold, r.x0, r.y1) for r in layout.text_blocks(b, s).collect()}
    assert got == want and len(want) > 20
    sizes = {r.paper_id: r.body_size for r in layout.body_size_of_spans(s.select("paper_id").distinct(), s).collect()}
    assert sizes == {p: heaviest([x for x in spans if x[0] == p]) for p in {x[0] for x in spans}}


def test_body_size_beside_the_lines(spark):
    """The windowed size is the aggregated one, ties included; rows keep it."""
    rng = random.Random(3)
    rows = [(p, page, b, n, 0.0, 10.0 * n, 9.0, 10.0 * n + 9, "x" * rng.randint(1, 3), rng.choice([9.0, 10.0, 11.0]), False) for p in range(20) for page in (1, 2) for b in range(2) for n in range(rng.randint(1, 3))]
    lines = spark.createDataFrame(rows, "paper_id int, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, max_size double, bold boolean").repartition(3)
    want = {r.paper_id: r.body_size for r in layout.body_size_of_lines(lines).collect()}
    got = layout.rows_of_lines(layout.with_body_size(lines))
    assert got.count() == lines.count()
    assert {(r.paper_id, r.body_size) for r in got.select("paper_id", "body_size").distinct().collect()} == set(want.items())


def test_lines_need_span_box_and_text_block(spark):
    """A line without spans, spans without a line, a line of a picture block and a tilted line are no text lines."""
    blocks = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 1)], "paper_id int, page int, block_no int, type int")
    box = [0.0, 0.0, 9.0, 9.0]
    lines = spark.createDataFrame([(1, 1, 0, 0, *box, 1.0), (1, 1, 0, 1, *box, 1.0), (1, 1, 0, 2, *box, 0.0), (1, 1, 1, 0, *box, 1.0), (1, 1, 2, 0, *box, 1.0)], "paper_id int, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, dir_x double")
    spans = spark.createDataFrame([(1, 1, 0, 0, 1, "b ", 10.04, 16), (1, 1, 0, 0, 0, " a", 9.0, 0), (1, 1, 0, 2, 0, "t", 9.0, 0), (1, 1, 0, 3, 0, "u", 9.0, 0), (1, 1, 1, 0, 0, "v", 9.0, 0), (1, 1, 2, 0, 0, "w", 9.0, 0)], SPANS)
    got = layout.text_lines(blocks, lines, spans)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0, 0, "ab", *box, 10.0, True)]
    assert got.columns == [*layout.LINE, "text", *layout.BOX, "max_size", "bold"] and got.where(F.col("x0").isNull()).isEmpty()


def test_appending_moves_keys_only(spark, tmp_path):
    """rows whose keys are all different are stored without a group of whole rows; repeated and null keys are stored once, as before."""
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 3, "n"), (None, 2, "m")], "id string, n int, text string")
    wrote = []
    real = keyed.stage
    keyed.stage = lambda df: wrote.append(plan(df)) or real(df)
    try:
        keyed.append(rows.where("id = 'b' or n = 1"), f"file://{tmp_path}/t", ["id"])
    finally:
        keyed.stage = real
    assert len(wrote) == 2 and not any("to_json" in p or "structstojson" in p.lower() or "min_by" in p for p in wrote)
    keyed.append(rows, f"file://{tmp_path}/u", ["id"])
    held = keyed.read(spark, f"file://{tmp_path}/u", rows.schema, ["id"])
    assert sorted((str(r.id), r.n, r.text) for r in held.collect()) == [("None", 2, "m"), ("a", 1, "y"), ("b", 1, "z")]


def test_documents_are_dealt_by_their_size(spark, monkeypatch):
    """F17 to F20: a task's share of the text is bounded at every size, it does not follow the number of shuffle partitions, and both readers share the exchange."""
    from folioscope.plans import fixtures

    parts = lambda: {int(n) for n in re.findall(r"Exchange hashpartitioning\(doc_id#\w+, (\d+)\), REPARTITION_BY_NUM", plan(QUERIES["SRC2_text_blocks"](spark, SF)))}
    (few,) = parts()
    monkeypatch.setattr(fixtures, "PART_BYTES", 1 << 13)
    (many,) = parts()
    assert few == spark.sparkContext.defaultParallelism and many > 20


def test_text_blocks_sort_spans_once(spark):
    """F17 to F20: a block's spans are one group; sizes need no window over them, and body sizes of the spans' own papers no second reading."""
    text = plan(QUERIES["SRC2_text_blocks"](spark, SF))
    assert "Window" not in text and len(re.findall(r"collect_list\(", text)) <= 2
    assert "Join" not in plan(Layout(spark, SF).bodies())


def test_a_run_deals_dealt_tables_no_more(spark, tmp_path, monkeypatch):
    """F1 of round 4: parsing and figures take a run's rows as they lie, only the papers' ids travel to them; faults are found without joins of rows."""
    from folioscope.plans import layout_queries, pipeline

    given, papers = layout_queries._given(Layout(spark, SF), by_paper=True), Layout(spark, SF).table("papers").select("paper_id")
    text = plan(layout_queries.checks.faults(papers, given))
    assert len(re.findall(r"(?:Join|HashJoin|SortMergeJoin) \[", text)) <= 1
    wrote, real = [], pipeline.stage
    monkeypatch.setattr(pipeline, "stage", lambda df: wrote.append(plan(df)) or real(df))
    pipeline.store(papers, given, f"file://{tmp_path}/dealt", until="extracting_figures", dealt=True)
    dealt = [t for t in wrote if "posexplode" in t and "collect_list" in t and "graphic_top" not in t]  # rows and text blocks, not zones
    assert len(dealt) == 2 and {k for t in dealt for k in re.findall(r"hashpartitioning\((\w+)#\w+, \d+\), REPARTITION", t)} == {"doc_id"}
    assert not any(re.search(r"hashpartitioning\(paper_id#\w+, page", t) for t in dealt)
    pipeline.store(papers, layout_queries._given(Layout(spark, SF)), f"file://{tmp_path}/plain", until="extracting_figures")
    for table in ("sections", "paragraphs", "figures", "image_requests"):
        one, two = ([r.asDict() for r in tables.read(spark, f"file://{tmp_path}/{kind}", table).orderBy(*tables.KEYS[table]).collect()] for kind in ("dealt", "plain"))
        assert one == two and one


def test_a_missing_number_has_no_owner(spark):
    """A line and a block whose numbers are both missing are not each other's."""
    boxed = "x0 double, y0 double, x1 double, y1 double"
    given = {
        "layout_pages": spark.createDataFrame([("p", 1, 0.0, 0.0, 9.0, 9.0)], f"paper_id string, page int, {boxed}"),
        "layout_blocks": spark.createDataFrame([("p", 1, None, 0, 0.0, 0.0, 9.0, 9.0)], f"paper_id string, page int, block_no int, type int, {boxed}"),
        "layout_lines": spark.createDataFrame([("p", 1, None, 0, 0.0, 0.0, 9.0, 9.0)], f"paper_id string, page int, block_no int, line_no int, {boxed}"),
        "layout_spans": spark.createDataFrame([], SPANS.replace("paper_id int", "paper_id string")),
        **{t: spark.createDataFrame([], f"paper_id string, page int, {boxed}") for t in ("layout_rasters", "layout_drawings")},
    }
    assert [r.message for r in checks.faults(spark.createDataFrame([("p",)], "paper_id string"), given).collect()] == ["a line has no block"]
