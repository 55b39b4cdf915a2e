"""Keyed tables: pruning by key range, two writers, newest rows, compaction; and what a stored run does again."""

import difflib
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_operators import layout_of

from folioscope.functions import providers
from folioscope.operators import checks, figures, titles
from folioscope.plans import pipeline, queries
from folioscope.sources import keyed, tables

KIND = "id string, v int"


@pytest.fixture
def kind(spark):
    return StructType.fromDDL(KIND)


def frame(spark, keys, v):
    return spark.createDataFrame([(f"k{k:05d}", v) for k in keys], KIND)


def held(spark, path, kind, **given):
    return sorted(map(tuple, keyed.read(spark, path, kind, ["id"], **given).collect()))


def test_a_key_is_stored_once_and_files_are_pruned(spark, tmp_path, kind, monkeypatch):
    path = f"file://{tmp_path}/t"
    for i in range(6):  # six commits of neighbouring keys
        assert keyed.append(frame(spark, range(i * 100, i * 100 + 100), i), path, ["id"]) == i + 1
    version, parts = keyed.snapshot(spark, path)
    assert version == 6 and sum(p.rows for p in parts) == 600
    assert all(a.last < b.first or b.last < a.first for a in parts for b in parts if a is not b)
    opened = []
    whole = keyed.scan
    monkeypatch.setattr(keyed, "scan", lambda s, p, k, files: opened.append(len(files)) or whole(s, p, k, files))
    keyed.append(frame(spark, (50, 51, 52, 900), 9), path, ["id"])  # three are there
    assert opened and max(opened) <= 2, "only files that can hold the keys are compared"
    opened.clear()
    got = held(spark, path, kind)
    assert [v for k, v in got if k == "k00050"] == [0] and ("k00900", 9) in got and len(got) == 601
    opened.clear()
    assert held(spark, path, kind, prefix="k0025") == [(f"k0025{i}", 2) for i in range(10)]
    read = keyed.read(spark, path, kind, ["id"], prefix="k0025")
    assert max(opened) <= 2 and len(read.inputFiles()) <= 2
    # more keys, more files
    small, large = (len(keyed.touched(frame(spark, keys, 0), "id", parts)) for keys in (range(3), range(600)))
    assert small == 1 and large == len(parts)


def test_batches_repeat_and_hold_a_key_twice(spark, tmp_path, kind):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("a", None)], KIND)
    assert keyed.append(rows, path, ["id"]) == 1
    assert keyed.append(rows, path, ["id"]) == 0
    assert keyed.append(rows.where("false"), path, ["id"]) == 0
    assert len(held(spark, path, kind)) == 2
    assert held(spark, f"file://{tmp_path}/none", kind) == []


def test_two_writers_store_a_key_once(spark, tmp_path, kind, monkeypatch):
    path = f"file://{tmp_path}/t"
    keyed.append(frame(spark, range(10), 0), path, ["id"])
    commit, others = keyed._commit, [frame(spark, range(5, 15), 1), frame(spark, range(12, 18), 2)]

    def late(spark_, path_, version, added, gone=()):
        if others:  # somebody else is faster, twice
            other = others.pop(0)
            keyed.append(other, path_, ["id"])
        return commit(spark_, path_, version, added, gone)

    monkeypatch.setattr(keyed, "_commit", late)
    keyed.append(frame(spark, range(8, 30), 9), path, ["id"])
    got = held(spark, path, kind)
    assert [k for k, _ in got] == [f"k{i:05d}" for i in range(30)]
    assert len([n for n in (tmp_path / "t").iterdir() if n.name.startswith("data-")]) == len(keyed.snapshot(spark, path)[1] and {p.file.split("/")[0] for p in keyed.snapshot(spark, path)[1]})


def test_newest_row_wins_through_compaction(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(keyed, "WHOLE_EVERY", 4)
    path, rng, model = f"file://{tmp_path}/t", random.Random(4), {}
    for step in range(12):
        keys = rng.sample(range(60), 7)
        if step % 3 == 0:
            keyed.append(frame(spark, keys, step), path, ["id"])
            model = {k: step for k in keys} | model
        else:
            keyed.upsert(frame(spark, keys, step), path, ["id"])
            model |= {k: step for k in keys}
        if step in (5, 11):
            before = len(keyed.snapshot(spark, path)[1])
            assert keyed.compact(spark, path, kind, ["id"], least=2)
            assert len(keyed.snapshot(spark, path)[1]) < before
        assert held(spark, path, kind) == sorted((f"k{k:05d}", v) for k, v in model.items())
    assert not keyed.compact(spark, path, kind, ["id"], least=2)
    assert keyed.vacuum(spark, path) >= 1
    assert held(spark, path, kind) == sorted((f"k{k:05d}", v) for k, v in model.items())
    # files that nothing replaces are read as they are
    plan = keyed.read(spark, path, kind, ["id"])._jdf.queryExecution().toString()
    assert "Aggregate" not in plan


def test_a_taken_number_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert keyed._published(spark, path, "0000000001", [])
    assert not keyed._published(spark, path, "0000000001", [])
    assert [n.name for n in (tmp_path / "t/_log").iterdir() if not n.name.startswith(".")] == ["0000000001"]


def test_a_run_goes_on_where_it_was_cut_off(spark, tmp_path):
    papers, given = layout_of(spark)
    root = f"file://{tmp_path}"
    count = lambda t: tables.read(spark, root, t).count()
    for until, explained in (("parsing", 0), ("matching", 0), (None, 1)):
        pipeline.store(papers, given, root, until=until, delay=0.0)
        assert (count("figure_explanations") if keyed.exists(spark, f"{root}/figure_explanations") else 0) == explained
    assert count("paragraphs") == 2 and count("figures") == 1 and count("finished") == 2 + 1 + 1
    assert [r.status for r in tables.read(spark, root, "figures").collect()] == ["explained"]


def test_a_failed_question_is_asked_again_and_a_failed_figure_too(spark, tmp_path):
    papers, given = layout_of(spark)
    root = f"file://{tmp_path}"

    def busy(images):
        def answer(question):
            raise providers.ProviderError("busy")

        return providers.Model("busy", "0", answer)

    pipeline.store(papers, given, root, busy, delay=0.0)
    assert [r.status for r in tables.read(spark, root, "figures").collect()] == ["failed"]
    pipeline.store(papers, given, root, delay=0.0)
    assert [r.status for r in tables.read(spark, root, "figures").collect()] == ["explained"]
    calls = tables.read(spark, root, "model_calls").where("step = 'explaining'").groupBy("answered").count().collect()
    assert {r.answered: r["count"] for r in calls} == {False: 3, True: 1}


def test_faults_split_a_paper_off(spark, tmp_path):
    papers, given = layout_of(spark)
    assert checks.faults(papers, given).collect() == []
    broken = dict(given)
    broken["layout_lines"] = given["layout_lines"].where("block_no <> 1")
    (fault,) = checks.faults(papers, broken).collect()
    assert (fault.paper_id, fault.message) == ("p", "a span has no line")
    pipeline.store(papers, broken, f"file://{tmp_path}", delay=0.0)
    log = pipeline.current_status(tables.read(spark, f"file://{tmp_path}", "paper_status"))
    assert {r.paper_id: (r.upload_status, r.error_message) for r in log.collect()} == {"p": ("failed", "a span has no line"), "unreadable": ("failed", "no text")}


def test_titles_take_turns(spark):
    rng = random.Random(8)
    pairs, want = [], []
    for paper in range(12):
        scores = {(e, a): rng.choice((0.8, 0.85, 0.9, 1.0)) for e in range(9) for a in range(8) if rng.random() < 0.6}
        pairs += [(paper, e, a, s) for (e, a), s in scores.items()]
        used = set()
        for e in range(9):
            left = sorted((-s, a) for (x, a), s in scores.items() if x == e and a not in used)
            if left:
                used.add(left[0][1])
                want.append((paper, e, left[0][1], -left[0][0]))
    got = titles.aligned(spark.createDataFrame(pairs, "paper_id int, place int, order int, score double")).collect()
    assert sorted((r.paper_id, r.place, r["order"], r.score) for r in got) == want


def test_title_scores(spark):
    expected = spark.createDataFrame([(1, 0, "3. Deep Residual Learning"), (1, 1, "3.1. Residual Learning"), (1, 2, "Identity Mapping by Shortcuts"), (1, 3, "")], "paper_id int, place int, title string")
    found = spark.createDataFrame([(1, 0, "3 DEEP RESIDUAL LEARNING"), (1, 1, "3.1 Residual Learning"), (1, 2, "Identity Mappings by Shortcut"), (1, 3, "Eﬃcient ﬁelds")], "paper_id int, order int, title string")
    got = {r.place: r["order"] for r in titles.aligned(titles.scores(expected, found)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}  # an empty title is inside every other one
    (r,) = titles.recall(expected, titles.aligned(titles.scores(expected, found))).collect()
    assert (r.expected_n, r.matched_n, r.passed) == (4, 4, True)


def test_title_similarity_is_bounded_exactly():
    rng = random.Random(9)
    for _ in range(300):
        e = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        a = "".join(c for c in e if rng.random() < 0.8) + rng.choice(("", "b", "ab c"))
        want = difflib.SequenceMatcher(None, e, a).ratio()
        assert titles.similarity(e, a, 0.8) == want or want < 0.8
        row = [0] * (len(a) + 1)
        for x in e:
            row = list(accumulate(range(len(a)), lambda best, j, r=row: max(best, r[j + 1], (r[j] + 1) if x == a[j] else 0), initial=0))
        assert titles.common_length(e, a) == row[-1]


def test_repeated_titles_take_turns_in_one_pass(spark):
    same = spark.range(300).selectExpr("1 AS paper_id", "CAST(id AS INT) AS place", "CAST(id AS INT) AS `order`", "'the same title' AS title")
    turns = titles.aligned(titles.scores(same, same))
    assert turns.count() == 300 and turns.where("place <> `order` or score <> 1").isEmpty()
    assert "stage-" not in turns._jdf.queryExecution().toString()  # no round is written


def test_title_queries_hold_what_their_sql_can_tell(spark):
    lines = spark.createDataFrame([(4, 0, "the quick brown fox jumps over the lazy dog today"), (4, 2, "the quick brown fix jumps over the lazy dog todax")], "paper_id long, n int, line string")
    expected, found = queries._golden(lines)
    assert titles.scores(expected, found).count() > titles.scores(expected, found, similar=False).count() == queries._scores(lines).count()
    assert {r.score for r in queries._scores(lines).collect()} <= {1.0, 0.9}


def test_embedded_gathers_no_caption(spark):
    figures_ = spark.createDataFrame([(i, f"caption {i % 2}") for i in range(20)], "figure_id long, caption string")
    got = queries._embedded(figures_)
    assert {(r.dims, r.norm, r.same) for r in got.collect()} == {(768, 1.0, True)} and got.count() == 20
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_by_request(spark):
    found = spark.createDataFrame([("p", 1, 1, 0.0, 0.0, 10.0, 10.0, "embedded"), ("p", 2, 1, 0.0, 50.0, 10.0, 60.0, "render")], "paper_id string, figure_index int, page int, x0 double, y0 double, x1 double, y1 double, method string")
    rasters = spark.createDataFrame([("p", 1, 7, 0.0, 0.0, 10.0, 9.5), ("p", 1, 8, 0.0, 9.0, 10.0, 30.0)], "paper_id string, page int, xref int, x0 double, y0 double, x1 double, y1 double")
    asked = figures.image_requests(found, rasters)
    assert {r.figure_index: (r.dpi, r.xref) for r in asked.collect()} == {1: (None, 7), 2: (200, None)}
    originals = spark.createDataFrame([("p", 7, b"own")], "paper_id string, xref int, content binary")
    made = spark.createDataFrame([("local://figures/p/figure_2.png", b"drawn")], "image_uri string, content binary")
    assert {r.image_uri[-5]: bytes(r.content) for r in figures.image_files(asked, originals, made).collect()} == {"1": b"own", "2": b"drawn"}
    assert figures.image_files(asked, originals.where("false"), made.where("false")).where(F.col("content").isNotNull()).count() == 0
