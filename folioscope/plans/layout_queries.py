"""Queries of the layout, section and figure operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import text as T
from folioscope.operators import checks
from folioscope.operators import figures as X
from folioscope.operators import layout as L
from folioscope.operators import reads
from folioscope.operators import sections as S
from folioscope.plans import pipeline, stand_ins
from folioscope.plans.fixtures import derived, with_sql
from folioscope.sources import tables
from folioscope.sources.stage import shared_root, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Steps of the SQL versions, in order.
_TRIM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_JOIN = r"list_reduce(list({0} ORDER BY {1}), lambda a, b: CASE WHEN a = '' THEN b WHEN ends_with(a, '-') AND regexp_matches(b, '^\p{{Ll}}') THEN left(a, length(a) - 1) || b ELSE a || ' ' || b END)"
_SQL = {
    "tl": r"""SELECT l.paper_id, l.page, l.block_no, l.line_no, l.x0, l.y0, l.x1, l.y1, trim(raw) AS text, max_size, bold
FROM layout_lines AS l JOIN blocks AS b ON l.paper_id = b.paper_id AND l.page = b.page AND l.block_no = b.block_no
JOIN (SELECT paper_id, page, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS raw, max(round(size, 1)) AS max_size, bool_or((flags & 16) <> 0) AS bold FROM layout_spans GROUP BY 1, 2, 3, 4) AS s
  ON l.paper_id = s.paper_id AND l.page = s.page AND l.block_no = s.block_no AND l.line_no = s.line_no
WHERE b.type = 0 AND abs(dir_x - 1.0) <= 0.01 AND trim(raw) <> '' AND NOT regexp_matches(trim(raw), '^arXiv:\d{4}\.\d{4,5}')""",
    "lbody": """SELECT paper_id, max_size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY weight DESC, met) AS r
FROM (SELECT paper_id, max_size, sum(length(text)) AS weight, min(page * 100000000 + block_no * 1000000 + line_no) AS met FROM tl GROUP BY 1, 2)) WHERE r = 1""",
    # a fold over a block's lines: a line joins the row whose accumulated interval it overlaps by more than half of the smaller height
    "ro": """SELECT paper_id, page, block_no, list(line_no ORDER BY line_no) AS line_nos, list_reduce(list({'at': 0, 'y0': y0, 'y1': y1, 'rows': [0]} ORDER BY line_no), lambda a, b:
  CASE WHEN least(a.y1 - a.y0, b.y1 - b.y0) > 0 AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) > 0.5
    THEN {'at': a.at, 'y0': least(a.y0, b.y0), 'y1': greatest(a.y1, b.y1), 'rows': list_append(a.rows, a.at)} ELSE {'at': a.at + 1, 'y0': b.y0, 'y1': b.y1, 'rows': list_append(a.rows, a.at + 1)} END).rows AS row_nos FROM tl GROUP BY 1, 2, 3""",
    "rn": "SELECT paper_id, page, block_no, unnest(line_nos) AS line_no, CAST(unnest(row_nos) AS INT) AS row_no FROM ro",
    "rw": f"""SELECT paper_id, page, block_no, row_no, {_TRIM.format("string_agg(text, ' ' ORDER BY x0, line_no)")} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_and(bold OR max_size > body_size + 0.5) AS styled
FROM tl JOIN rn USING (paper_id, page, block_no, line_no) JOIN lbody USING (paper_id) GROUP BY 1, 2, 3, 4""",
    "hd": r"""SELECT *, length(text) <= 120 AND styled AND ((regexp_matches(text, '^(\d{1,2}(\.\d{1,2})*)\.?\s+([A-Z][^\s]*(\s+\S+)*)$') AND regexp_matches(regexp_extract(text, '^(\d{1,2}(\.\d{1,2})*)\.?\s+([A-Z][^\s]*(\s+\S+)*)$', 3), '[A-Za-z]{2}'))
  OR regexp_matches(text, '(?i)^(Abstract|Introduction|Background|Related Works?|Methods?|Experiments?|Results?|Discussion|Conclusions?|References|Bibliography|Acknowledg(e)?ments?|Appendix(\s+[A-Z].*)?)$')) AS heading
FROM rw WHERE NOT (regexp_matches(text, '^\d{1,4}$') AND NOT styled)""",
    "sg": """SELECT *, CAST(headings - 1 + max(CASE WHEN headings = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id) AS INT) AS section_order
FROM (SELECT *, CAST(count(*) FILTER (heading) OVER (PARTITION BY paper_id ORDER BY page, block_no, row_no ROWS UNBOUNDED PRECEDING) AS INT) AS headings FROM hd)""",
    "fr": f"SELECT paper_id, section_order, page, block_no, {_JOIN.format('text', 'row_no')} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM sg WHERE NOT heading GROUP BY paper_id, section_order, headings, page, block_no",
    "pn": r"""SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, section_order ORDER BY page, block_no ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS "order"
FROM (SELECT *, NOT regexp_matches(text, '^\p{Ll}') OR row_number() OVER (PARTITION BY paper_id, section_order ORDER BY page, block_no) = 1 AS starts FROM fr)""",
    "pg": f"""SELECT paper_id, section_order, "order", min(page) AS page, {_JOIN.format('text', 'page, block_no')} AS text, arg_min(x0, page * 1000 + block_no) AS x0, arg_min(y1, page * 1000 + block_no) AS y1, max(page) AS last_page FROM pn GROUP BY 1, 2, 3""",
    "bt": f"""SELECT b.paper_id, b.page, b.block_no, b.x0, b.y0, b.x1, b.y1, text, lines, mode_size, all_bold FROM blocks AS b
JOIN (SELECT paper_id, page, block_no, {_TRIM.format("string_agg(line, ' ' ORDER BY line_no)")} AS text, CAST(count(*) AS INT) AS lines FROM (SELECT paper_id, page, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS line FROM layout_spans GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) AS t
  ON b.paper_id = t.paper_id AND b.page = t.page AND b.block_no = t.block_no
JOIN (SELECT paper_id, page, block_no, size AS mode_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page, block_no ORDER BY weight DESC, met) AS r FROM (SELECT paper_id, page, block_no, round(size, 1) AS size, sum(length(text)) AS weight, min(line_no * 100 + span_no) AS met FROM layout_spans GROUP BY 1, 2, 3, 4)) WHERE r = 1) AS m
  ON b.paper_id = m.paper_id AND b.page = m.page AND b.block_no = m.block_no
JOIN (SELECT paper_id, page, block_no, coalesce(bool_and((flags & 16) <> 0) FILTER (trim(text) <> ''), false) AS all_bold FROM layout_spans GROUP BY 1, 2, 3) AS a
  ON b.paper_id = a.paper_id AND b.page = a.page AND b.block_no = a.block_no
WHERE b.type = 0 AND text <> ''""",
    "sbody": """SELECT paper_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY weight DESC, met) AS r
FROM (SELECT paper_id, round(size, 1) AS size, sum(length(text)) AS weight, min(page * 10000000000 + block_no * 100000000 + line_no * 100 + span_no) AS met FROM layout_spans GROUP BY 1, 2)) WHERE r = 1""",
    "ar": "SELECT paper_id, page, min(x0) AS ax0, min(y0) AS ay0, max(x1) AS ax1, max(y1) AS ay1 FROM bt GROUP BY 1, 2",
    "tc": """SELECT paper_id, page, count(*) FILTER (narrow AND l) >= 2 AND count(*) FILTER (narrow AND NOT l) >= 2 AS two_column
FROM (SELECT bt.paper_id, bt.page, x1 - x0 <= 0.55 * (ax1 - ax0) AS narrow, (x0 + x1) / 2 < (ax0 + ax1) / 2 AS l FROM bt JOIN ar ON bt.paper_id = ar.paper_id AND bt.page = ar.page) GROUP BY 1, 2""",
    "cp": r"""SELECT paper_id, page, block_no AS caption_no, text AS caption, NOT strict AS loose, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1
FROM (SELECT *, regexp_matches(text, '(?i)^(Figure|Fig\.)\s+(\d+)\s*[.:]') AS strict FROM bt) WHERE strict OR (regexp_matches(text, '(?i)^(Figure|Fig\.)\s+(\d+)\s+\S') AND length(text) <= 150)""",
    "zs": """SELECT cp.*, ax0, ay0, ax1, CASE WHEN own AND NOT l THEN mid ELSE ax0 END AS zx0, CASE WHEN own AND l THEN mid ELSE ax1 END AS zx1
FROM (SELECT cp.*, ax0, ay0, ax1, (ax0 + ax1) / 2 AS mid, two_column AND cx1 - cx0 <= 0.55 * (ax1 - ax0) AS own, (cx0 + cx1) / 2 < (ax0 + ax1) / 2 AS l FROM cp JOIN ar ON cp.paper_id = ar.paper_id AND cp.page = ar.page JOIN tc ON cp.paper_id = tc.paper_id AND cp.page = tc.page) AS cp""",
    "ab": r"""SELECT z.paper_id, z.page, z.caption_no, b.x0, b.y0, b.x1, b.y1, CAST(row_number() OVER (PARTITION BY z.paper_id, z.page, z.caption_no ORDER BY b.y1 DESC, b.block_no) AS INT) AS near,
  regexp_matches(text, '(?i)^(Figure|Fig\.)\s+(\d+)\s*[.:]') OR regexp_matches(text, '(?i)^Table\s+\d+\s*[.:]') OR (lines >= 2 AND b.x1 - b.x0 >= 0.5 * (zx1 - zx0) AND abs(mode_size - body_size) <= 0.6) OR (lines = 1 AND all_bold AND mode_size > body_size + 0.5) AS barrier
FROM zs AS z JOIN bt AS b ON z.paper_id = b.paper_id AND z.page = b.page AND z.caption_no <> b.block_no JOIN sbody AS s ON z.paper_id = s.paper_id
WHERE b.y1 <= cy0 + 2 AND least(b.x1, zx1) - greatest(b.x0, zx0) > 0.1 * least(b.x1 - b.x0, zx1 - zx0)""",
    "zn": """SELECT z.*, coalesce(by1, least(ay0, coalesce(top, ay0))) AS zy0, cy0 AS zy1, first_near
FROM zs AS z LEFT JOIN (SELECT paper_id, page, caption_no, min(near) AS first_near, max(y1) AS by1 FROM ab WHERE barrier GROUP BY 1, 2, 3) AS f ON z.paper_id = f.paper_id AND z.page = f.page AND z.caption_no = f.caption_no
LEFT JOIN (SELECT paper_id, page, min(y0) AS top FROM layout_graphics GROUP BY 1, 2) AS g ON z.paper_id = g.paper_id AND z.page = g.page""",
    "gz": """SELECT z.paper_id, z.page, z.caption_no, g.x0, g.y0, g.x1, g.y1, raster FROM zn AS z JOIN layout_graphics AS g ON z.paper_id = g.paper_id AND z.page = g.page
WHERE least(g.y1, zy1) - greatest(g.y0, zy0) > 0.5 * (g.y1 - g.y0) AND least(g.x1, zx1) - greatest(g.x0, zx0) > 0.1 * least(g.x1 - g.x0, zx1 - zx0)""",
    "rl": "SELECT * FROM zn AS z WHERE NOT loose OR EXISTS (SELECT 1 FROM gz AS g WHERE g.paper_id = z.paper_id AND g.page = z.page AND g.caption_no = z.caption_no)",
    "ct": """SELECT paper_id, page, caption_no, x0, y0, x1, y1, true AS graphic, raster FROM gz
UNION ALL SELECT a.paper_id, a.page, a.caption_no, a.x0, a.y0, a.x1, a.y1, false, false FROM ab AS a JOIN rl AS z ON a.paper_id = z.paper_id AND a.page = z.page AND a.caption_no = z.caption_no
WHERE (first_near IS NULL OR near < first_near) AND least(a.y1, zy1) - greatest(a.y0, zy0) > 0.5 * (a.y1 - a.y0) AND least(a.x1, zx1) - greatest(a.x0, zx0) > 0.1 * least(a.x1 - a.x0, zx1 - zx0) AND a.x1 > a.x0 AND (least(a.x1, zx1) - greatest(a.x0, zx0)) / (a.x1 - a.x0) >= 0.6""",
    "fg": r"""SELECT *, CASE WHEN rasters = 1 AND raster_area >= 0.9 * (greatest(x1 - x0, 0) * greatest(y1 - y0, 0)) THEN 1.0E0 WHEN graphic THEN 0.8E0 WHEN graphic IS NOT NULL THEN 0.5E0 ELSE 0.3E0 END AS extraction_confidence,
  CASE WHEN rasters = 1 AND raster_area >= 0.9 * (greatest(x1 - x0, 0) * greatest(y1 - y0, 0)) THEN 'embedded' WHEN graphic IS NOT NULL THEN 'render' ELSE 'render-fallback' END AS method,
  CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page, cy0, loose, caption_no) AS INT) AS figure_index, 'Figure ' || regexp_extract(caption, '(?i)^(?:Figure|Fig\.)\s+(\d+)', 1) AS figure_number
FROM (SELECT z.paper_id, z.page, z.caption_no, caption, loose, cy0, graphic, rasters, raster_area, greatest(greatest(coalesce(ux0, zx0), zx0) - 3, 0) AS x0, greatest(greatest(greatest(coalesce(uy0, greatest(zy0, cy0 - 150)), zy0) - 3, zy0), 0) AS y0,
    least(least(coalesce(ux1, zx1), zx1) + 3, 612) AS x1, least(least(least(coalesce(uy1, cy0), zy1) + 3, zy1 - 0.5), 792) AS y1
  FROM rl AS z LEFT JOIN (SELECT paper_id, page, caption_no, min(x0) AS ux0, min(y0) AS uy0, max(x1) AS ux1, max(y1) AS uy1, bool_or(graphic) AS graphic, count(*) FILTER (raster) AS rasters, max((x1 - x0) * (y1 - y0)) FILTER (raster) AS raster_area FROM ct GROUP BY 1, 2, 3) AS u
    ON z.paper_id = u.paper_id AND z.page = u.page AND z.caption_no = u.caption_no)""",
}
_AFTER = {
    "tl": (), "lbody": ("tl",), "ro": ("tl",), "rn": ("ro",), "rw": ("tl", "lbody", "rn"), "hd": ("rw",), "sg": ("hd",), "fr": ("sg",), "pn": ("fr",), "pg": ("pn",), "bt": (), "sbody": (), "ar": ("bt",), "tc": ("bt", "ar"), "cp": ("bt",), "zs": ("cp", "ar", "tc"),
    "ab": ("zs", "bt", "sbody"), "zn": ("zs", "ab"), "gz": ("zn",), "rl": ("zn", "gz"), "ct": ("gz", "ab", "rl"), "fg": ("rl", "ct"),
}


def _steps(name: str) -> list[str]:
    out: list[str] = []
    for below in _AFTER[name]:
        out += [s for s in _steps(below) if s not in out]
    return [*out, name]


class Layout:
    """The derived layout of the test tables and the operators' results over it. What several steps read is a stage table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.table = cache(lambda name: derived(spark, sf_dir, name))
        self.of_papers = cache(lambda name: derived(spark, sf_dir, name, by_paper=True))
        self.spans = cache(lambda: self.table("layout_spans"))
        # from here to the paragraphs all grouping is within a paper and follows the one exchange of the documents, so nothing is stored between
        self.lines = cache(lambda: L.text_lines(*map(self.of_papers, ("blocks", "layout_lines", "layout_spans"))))
        self.rows = cache(lambda: L.rows_of_lines(L.with_body_size(self.lines())).withColumn("styled", S.styled()).drop("parts"))
        self.segmented = cache(lambda: S.segmented(self.rows()))
        self.fragments = cache(lambda: S.fragments(self.segmented()))
        self.text_blocks = cache(lambda: L.text_blocks(self.of_papers("blocks"), self.of_papers("layout_spans")))
        self.blocks = cache(lambda: stage(self.text_blocks()))
        self.bodies = cache(lambda: L.body_sizes(self.spans()))  # of papers without spans nothing here is asked
        self.graphics = cache(lambda: stage(self.table("layout_graphics")))
        self.zones = cache(self._zones)

    def _zones(self) -> tuple[DataFrame, DataFrame]:
        zoned = stage(X.zones(X.captions(self.blocks()), self.blocks(), self.bodies(), self.graphics())[0])
        return zoned, X.innards(zoned)

    def figures(self) -> DataFrame:
        return X.figures(*self.zones(), self.graphics(), self.table("layout_pages"))


def query(name: str, step: str, sql: str) -> Callable:
    def register(build: Callable[[Layout], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Layout(spark, sf_dir))
        own = ", ".join(f"{s} AS ({_SQL[s]})" for s in _steps(step))
        ORACLE[name] = f"{with_sql('blocks', 'layout_lines', 'layout_spans', 'layout_graphics')}, {own} {sql}"
        return build

    return register


def _sections(segmented: DataFrame) -> DataFrame:
    return S.sections(segmented, S.fragments(segmented))


_CAPTION = ("paper_id", "page", "caption_no")
_BOX = ("x0", "y0", "x1", "y1")

query("SRC1_text_lines", "tl", "SELECT * FROM tl")(lambda d: d.lines())
query("SRC2_text_blocks", "bt", "SELECT paper_id, page, block_no, text, lines FROM bt")(lambda d: d.text_blocks().select("paper_id", "page", "block_no", "text", "lines"))
query("AGG1_MTH4_body_size_of_lines", "lbody", "SELECT * FROM lbody")(lambda d: L.body_size_of_lines(d.lines()))
query("WIN1_merged_rows", "rn", "SELECT paper_id, page, block_no, row_no, count(*) AS lines FROM rn GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")(
    lambda d: L.rows_of_lines(d.lines()).select("paper_id", "page", "block_no", "row_no", F.size("parts").cast("long").alias("lines")).where("lines > 1")
)
query("AGG2_body_size_of_spans", "sbody", "SELECT * FROM sbody")(lambda d: d.bodies())
query("AGG3_AGG4_block_style", "bt", "SELECT paper_id, page, block_no, mode_size, all_bold FROM bt")(lambda d: d.text_blocks().select("paper_id", "page", "block_no", "mode_size", "all_bold"))
query("AGG5_text_area", "ar", "SELECT paper_id, page, ax0 AS area_x0, ay0 AS area_y0, ax1 AS area_x1, ay1 AS area_y1 FROM ar")(lambda d: L.text_area(d.text_blocks()))
query("WIN1_WIN2_rows", "rw", "SELECT * FROM rw")(lambda d: d.rows().select("paper_id", "page", "block_no", "row_no", "text", *_BOX, "styled"))
query("FLT1_page_numbers", "rw", r"SELECT paper_id, page, block_no, row_no FROM rw WHERE regexp_matches(text, '^\d{1,4}$') AND NOT styled")(lambda d: d.rows().where(S.is_page_number(all_styled=F.col("styled"))).select("paper_id", "page", "block_no", "row_no"))
query("FLT2_headings", "hd", "SELECT paper_id, page, block_no, row_no, text FROM hd WHERE heading")(lambda d: d.rows().where(S.is_heading(all_styled=F.col("styled"))).select("paper_id", "page", "block_no", "row_no", "text"))
query("WIN3_section_segmentation", "sg", "SELECT paper_id, page, block_no, row_no, heading, section_order FROM sg")(lambda d: d.segmented().select("paper_id", "page", "block_no", "row_no", "heading", "section_order"))
query("WIN4_AGG10_fragments", "fr", "SELECT * FROM fr")(lambda d: d.fragments().select("paper_id", "section_order", "page", "block_no", "text", *_BOX))
query("WIN5_WIN6_paragraphs", "pg", "SELECT * FROM pg")(lambda d: S.paragraphs(d.fragments()).select("paper_id", "section_order", "order", "page", "text", "x0", "y1", "last_page"))
query(
    "AGG7_sections", "fr",
    "SELECT s.paper_id, s.section_order, title, page_start, greatest(page_start, coalesce(last, page_start)) AS page_end FROM (SELECT paper_id, section_order, arg_min(CASE WHEN heading THEN text ELSE 'Front Matter' END, page * 1000000 + block_no * 10000 + row_no) AS title, min(page) AS page_start FROM sg GROUP BY 1, 2) AS s LEFT JOIN (SELECT paper_id, section_order, max(page) AS last FROM fr GROUP BY 1, 2) AS e ON s.paper_id = e.paper_id AND s.section_order = e.section_order",
)(lambda d: _sections(stage(d.segmented())))
query("AGG8_unreadable_papers", "pg", "SELECT doc_id AS paper_id, 'failed' AS status, 'no text' AS message FROM documents WHERE doc_id NOT IN (SELECT paper_id FROM pg)")(
    lambda d: S.unreadable(d.table("papers"), S.paragraphs(d.fragments()))
)
query("FLT11_two_column", "tc", "SELECT * FROM tc")(lambda d: X.two_column(d.blocks(), L.text_area(d.blocks())))
query("SET2_captions", "cp", "SELECT paper_id, page, caption_no, caption, loose FROM cp")(lambda d: X.captions(d.text_blocks()).select(*_CAPTION, "caption", "loose"))
query("GEO4_zone_extent", "zs", "SELECT paper_id, page, caption_no, zx0 AS z_x0, zx1 AS z_x1 FROM zs")(lambda d: d.zones()[0].select(*_CAPTION, "z_x0", "z_x1"))


def _above(d: Layout) -> DataFrame:
    blocks = d.blocks()
    areas = L.text_area(blocks)
    return X.blocks_above(X.spans_of_zones(X.captions(blocks), areas, X.two_column(blocks, areas)), blocks, d.bodies())


query("FLT10_JN8_GEO5_barriers", "ab", "SELECT paper_id, page, caption_no, near, barrier FROM ab")(lambda d: _above(d).select(*_CAPTION, "near", "barrier"))
query("WIN7_GEO6_zones", "zn", "SELECT paper_id, page, caption_no, zx0 AS z_x0, zy0 AS z_y0, zx1 AS z_x1, zy1 AS z_y1 FROM zn")(lambda d: d.zones()[0].select(*_CAPTION, "z_x0", "z_y0", "z_x1", "z_y1"))
query("GEO1_GEO3_graphics_in_zones", "gz", "SELECT * FROM gz")(lambda d: X.graphics_in_zones(d.zones()[0], d.graphics()))
query("GEO2_inside_zone", "zn", "SELECT z.paper_id, z.page, caption_no, block_no, x1 > x0 AND (least(x1, zx1) - greatest(x0, zx0)) / (x1 - x0) >= 0.6 AS inside FROM zn AS z JOIN bt ON z.paper_id = bt.paper_id AND z.page = bt.page")(
    lambda d: d.zones()[0].select(*_CAPTION, "z_x0", "z_x1").join(d.blocks(), ["paper_id", "page"]).select(*_CAPTION, "block_no", G.x_inside("", "z_").alias("inside"))
)
query("GEO7_AGG11_accepted_captions", "rl", "SELECT paper_id, page, caption_no FROM rl")(lambda d: d.figures().select(*_CAPTION))
query("GEO8_SET3_figure_boxes", "fg", "SELECT paper_id, page, caption_no, x0, y0, x1, y1 FROM fg")(lambda d: d.figures().select(*_CAPTION, *_BOX))
query("GEO9_SNK5_confidence", "fg", "SELECT paper_id, page, caption_no, extraction_confidence, method FROM fg")(lambda d: d.figures().select(*_CAPTION, "extraction_confidence", "method"))
query("WIN9_figure_order", "fg", "SELECT paper_id, page, caption_no, figure_index, figure_number FROM fg")(lambda d: d.figures().select(*_CAPTION, "figure_index", "figure_number"))
query("JN3_figures_of_papers", "fg", "SELECT doc_id AS paper_id, count(figure_index) AS n FROM documents LEFT JOIN fg ON doc_id = paper_id GROUP BY 1")(
    lambda d: reads.history(d.table("papers").withColumnRenamed("created", "created_at"), d.figures()).select("paper_id", F.col("figure_count").alias("n"))
)


def _first_caption(d: Layout) -> DataFrame:
    order = W.partitionBy("paper_id").orderBy("figure_index")
    return d.figures().withColumn("r", F.row_number().over(order)).where("r = 1").select("paper_id", "figure_number")


query("WIN9_first_figure", "fg", "SELECT paper_id, figure_number FROM fg WHERE figure_index = 1")(_first_caption)


def _given(d: Layout, by_paper: bool = False) -> dict[str, DataFrame]:
    """The layout tables as a run takes them, dealt by paper or as they come. Raster images are numbered by their place."""
    graphics, table = d.graphics(), d.of_papers if by_paper else d.table
    rasters = L.graphics_of_kind(graphics, True).withColumn("xref", F.expr(_XREF))
    return {
        "layout_blocks": table("blocks").select("paper_id", "page", "block_no", "type", *_BOX), "layout_lines": table("layout_lines").select("paper_id", "page", "block_no", "line_no", *_BOX, "dir_x"), "layout_spans": table("layout_spans"),
        "layout_pages": table("layout_pages"), "layout_rasters": rasters, "layout_drawings": L.graphics_of_kind(graphics, False),
    }


_XREF = "CAST(page * 10000 + x0 * 2 + y0 AS INT)"


def _pictures(d: Layout) -> DataFrame:
    """Pictures by request: an image's own bytes where one covers the box, a stand-in's rendering of it otherwise; every seventh rendering is missing."""
    rasters = _given(d)["layout_rasters"]
    asked = stage(X.image_requests(d.figures(), rasters))
    originals = rasters.select("paper_id", "xref", F.encode(F.concat(F.lit("image "), F.col("xref").cast("string")), "UTF-8").alias("content")).distinct()
    rendered = asked.where("dpi is not null and paper_id % 7 <> 3").select("image_uri", F.encode(F.concat(F.lit("box at "), F.col("dpi").cast("string")), "UTF-8").alias("content"))
    return X.image_files(asked, originals, rendered).join(asked.select("image_uri", "paper_id", "figure_index", "dpi", "xref"), "image_uri").select("paper_id", "figure_index", "dpi", "xref", F.decode("content", "UTF-8").alias("content"))


query(
    "SNK5_image_requests", "fg",
    f"""SELECT paper_id, figure_index, dpi, xref, CASE WHEN xref IS NOT NULL THEN 'image ' || xref WHEN paper_id % 7 <> 3 THEN 'box at ' || dpi END AS content FROM (
  SELECT f.paper_id, f.figure_index, CASE WHEN method <> 'embedded' THEN 200 END AS dpi, CASE WHEN method = 'embedded' THEN arg_max(g.xref, (greatest(least(g.x1, f.x1) - greatest(g.x0, f.x0), 0) * greatest(least(g.y1, f.y1) - greatest(g.y0, f.y0), 0), -g.xref)) END AS xref
  FROM fg AS f LEFT JOIN (SELECT *, {_XREF} AS xref FROM layout_graphics WHERE raster) AS g ON f.paper_id = g.paper_id AND f.page = g.page GROUP BY 1, 2, method)""",
)(_pictures)


def _broken(d: Layout) -> DataFrame:
    """Layouts that each lack something else, by paper; three of eleven are whole."""
    given = {k: v.withColumn("k", F.expr("paper_id % 11")) for k, v in _given(d).items()}
    pages, blocks, lines, spans = (f"layout_{t}" for t in ("pages", "blocks", "lines", "spans"))
    given[pages] = given[pages].where("k <> 0 AND NOT (k = 1 AND page = 1)").unionAll(given[pages].where("k = 2 AND page = 1"))
    given[blocks] = given[blocks].withColumn("x1", F.expr("CASE WHEN k = 3 AND block_no = 0 THEN NULL ELSE x1 END")).where("NOT (k = 5 AND block_no = 0)")
    given[lines] = given[lines].withColumn("y1", F.expr("CASE WHEN k = 4 AND line_no = 0 THEN y0 - 1 ELSE y1 END")).where("NOT (k = 6 AND line_no = 0)")
    given[spans] = given[spans].withColumn("text", F.expr("CASE WHEN k = 7 AND span_no = 0 THEN NULL ELSE text END"))
    return checks.broken_papers(d.table("papers").select("paper_id"), {k: v.drop("k") for k, v in given.items()})


QUERIES["CTL5_broken_papers"] = lambda spark, sf_dir: _broken(Layout(spark, sf_dir))
ORACLE["CTL5_broken_papers"] = with_sql("blocks") + (
    ", pages AS (SELECT paper_id, max(page) AS n FROM blocks GROUP BY 1) SELECT paper_id, CASE paper_id % 11 WHEN 0 THEN 'no page' WHEN 1 THEN CASE WHEN n = 1 THEN 'no page' ELSE 'a page is missing' END WHEN 2 THEN 'a page is there twice'"
    " WHEN 3 THEN 'a box is incomplete' WHEN 4 THEN 'a box is turned over' WHEN 5 THEN 'a line has no block' WHEN 6 THEN 'a span has no line' ELSE 'a span has no text or size' END AS message FROM pages WHERE paper_id % 11 <= 7"
)


def _stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is cut off after matching, a second one that does the rest, a third one that finds nothing to do but the figures that failed.
    Every stored row is one row here, and so is the number of questions that each step got an answer to, and how often at most to the same one."""
    d, root = Layout(spark, sf_dir), f"{shared_root(spark)}/store-{uuid.uuid4().hex}"
    given, papers = _given(d, by_paper=True), d.table("papers").select("paper_id")
    picture = lambda f: f.select("figure_id", F.encode("caption", "UTF-8").alias("image"))
    for day, until in ((1, "matching"), (2, None), (3, None)):
        pipeline.store(papers, given, root, stand_ins.by_prompt, stand_ins.by_length, picture, at=datetime(2026, 1, day, tzinfo=UTC), delay=0.0, until=until, dealt=True)
    held = {t: tables.read(spark, root, t) for t in ("sections", "paragraphs", "figures", "figure_text_matches", "figure_explanations", "paper_status", "model_calls")}
    row = lambda kind, id, detail, rows: rows.select(F.lit(kind).alias("kind"), id.alias("id"), detail.alias("detail"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    asked = held["model_calls"].where("answered").groupBy("step", "figure_id", "paragraph_id", "attempt").agg(F.count("*").alias("n")).groupBy("step").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    parts = [
        row("section", F.col("id"), F.concat_ws("|", "title", "page_start", "page_end"), held["sections"]),
        row("paragraph", F.col("id"), F.concat_ws("|", "section_id", "page", "text"), held["paragraphs"]),
        row("figure", F.col("id"), F.concat_ws("|", "figure_number", "page", "image_uri", "caption", "status"), held["figures"]),
        row("match", F.concat_ws("-", "figure_id", "paragraph_id"), F.concat_ws("|", "match_type", F.round(F.col("relevance_score") * 10000).cast("long")), held["figure_text_matches"]),
        row("explanation", F.col("figure_id"), F.concat_ws("|", "figure_type", "model_used", F.array_join(F.transform("grounding", lambda g: F.concat_ws(" ", g["source"], g["paragraph_id"])), ","), day("generated_at")), held["figure_explanations"]),
        row("status", F.col("paper_id"), F.concat_ws("|", "upload_status", "error_message"), pipeline.current_status(held["paper_status"])),
        row("entered", F.concat_ws("|", "paper_id", "status"), day("at"), held["paper_status"]),
        row("asked", F.col("step"), F.concat_ws("|", "n", "most"), asked),
    ]
    return reduce(DataFrame.unionAll, parts)


QUERIES["CTL1_CTL2_CTL4_DAT1_stored_run"] = _stored_run
_REFERS = r"regexp_matches(p.text, '(?i)\b(?:Figure|Fig\.)\s*' || regexp_extract(figure_number, '(\d+)$', 1) || '([^0-9]|$)')"
_CAPTIONED = r"(regexp_matches(p.text, '(?i)^(Figure|Fig\.)\s+(\d+)\s*[.:]') OR (regexp_matches(p.text, '(?i)^(Figure|Fig\.)\s+(\d+)\s+\S') AND length(p.text) <= 150))"
_NON_BODY = rf"({_CAPTIONED} OR regexp_matches(p.text, '(?i)^Table\s+\d+\s*[.:]') OR regexp_matches(p.text, '^\[\d+\]\s'))"
_any = lambda words: "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"
_VECTOR = "[length({0}) % 5 + 1, length({0}) % 7, (length({0}) - length(replace({0}, ' ', ''))) % 4]"
_SIM = "(c.v[1] * p.v[1] + c.v[2] * p.v[2] + c.v[3] * p.v[3]) / (sqrt(c.v[1] * c.v[1] + c.v[2] * c.v[2] + c.v[3] * c.v[3]) * sqrt(p.v[1] * p.v[1] + p.v[2] * p.v[2] + p.v[3] * p.v[3]))"
ORACLE["CTL1_CTL2_CTL4_DAT1_stored_run"] = (
    f"{with_sql('blocks', 'layout_lines', 'layout_spans', 'layout_graphics')}, "
    + ", ".join(f"{n} AS ({_SQL[n]})" for n in dict.fromkeys([*_steps("pg"), *_steps("fg")]))
    + f""", se AS (SELECT s.paper_id, s.section_order, title, page_start, greatest(page_start, coalesce(last, page_start)) AS page_end FROM (SELECT paper_id, section_order, arg_min(CASE WHEN heading THEN text ELSE 'Front Matter' END, page * 1000000 + block_no * 10000 + row_no) AS title, min(page) AS page_start FROM sg GROUP BY 1, 2) AS s LEFT JOIN (SELECT paper_id, section_order, max(page) AS last FROM fr GROUP BY 1, 2) AS e ON s.paper_id = e.paper_id AND s.section_order = e.section_order),
pv AS (SELECT paper_id || ':' || section_order || ':' || "order" AS id, paper_id, section_order * 100000 + "order" AS ord, text, {_VECTOR.format("text")} AS v FROM pg),
cv AS (SELECT paper_id || ':' || figure_index AS id, paper_id, figure_number, caption, extraction_confidence AS conf, {_VECTOR.format("caption")} AS v FROM fg WHERE paper_id IN (SELECT paper_id FROM pg)),
ma AS (SELECT DISTINCT c.id AS f, p.id AS p, p.ord FROM cv AS c JOIN pv AS p ON c.paper_id = p.paper_id WHERE NOT {_CAPTIONED} AND {_REFERS}),
sc AS (SELECT c.id AS f, p.id AS p, p.ord, p.text, conf, {_SIM} AS sim FROM cv AS c JOIN pv AS p ON c.paper_id = p.paper_id WHERE length(p.text) >= 80 AND NOT {_NON_BODY}),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sim DESC, ord DESC) AS r FROM sc WHERE sim >= 0.65 AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.f = sc.f AND ma.p = sc.p)) WHERE r <= 20),
al AS (SELECT f, p, ord, 'explicit_reference' AS kind, 1.0E0 AS score FROM ma UNION ALL SELECT f, p, ord, 'semantic_similarity', round(CASE WHEN conf < 0.5 THEN least(sim, conf) ELSE sim END, 4) FROM rk WHERE length(text) % 3 = 0),
top AS (SELECT f, arg_min(p, (-score, ord)) AS p FROM al GROUP BY 1),
kinds AS (SELECT *, CASE WHEN {_any(T.PLOT_WORDS)} THEN 'plot' WHEN {_any(T.QUALITATIVE_WORDS)} THEN 'qualitative' WHEN {_any(T.ARCHITECTURE_WORDS)} THEN 'architecture' ELSE 'other' END AS kind FROM (SELECT id, figure_number, lower(trim(regexp_replace(caption, '\\s+', ' ', 'g'))) AS x FROM cv)),
read AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id IN (SELECT paper_id FROM pg) AS ok FROM documents)
SELECT 'section' AS kind, paper_id || ':' || section_order AS id, title || '|' || page_start || '|' || page_end AS detail FROM se
UNION ALL SELECT 'paragraph', paper_id || ':' || section_order || ':' || "order", paper_id || ':' || section_order || '|' || page || '|' || text FROM pg
UNION ALL SELECT 'figure', paper_id || ':' || figure_index, figure_number || '|' || page || '|local://figures/' || paper_id || '/figure_' || figure_index || '.png|' || caption || CASE WHEN figure_number = 'Figure 3' THEN '|failed' ELSE '|explained' END FROM fg WHERE paper_id IN (SELECT paper_id FROM pg)
UNION ALL SELECT 'match', f || '-' || p, kind || '|' || CAST(round(score * 10000) AS BIGINT) FROM al
UNION ALL SELECT 'explanation', id, kind || '|by-prompt:1|' || coalesce('paragraph ' || p, 'none_found') || '|2026-01-02' FROM kinds LEFT JOIN top ON top.f = id WHERE figure_number <> 'Figure 3'
UNION ALL SELECT 'status', id, CASE WHEN ok THEN 'done' ELSE 'failed|no text' END FROM read
UNION ALL SELECT 'entered', id || '|' || s, CASE WHEN s IN ('explaining', 'done') THEN '2026-01-02' ELSE '2026-01-01' END FROM read, (VALUES ('parsing'), ('extracting_figures'), ('matching'), ('explaining'), ('done'), ('failed')) AS v(s) WHERE s = 'parsing' OR ok = (s <> 'failed')
UNION ALL SELECT 'asked', 'matching', count(*) || '|1' FROM rk
UNION ALL SELECT 'asked', 'explaining', count(*) || '|1' FROM cv WHERE figure_number <> 'Figure 3'"""
)
