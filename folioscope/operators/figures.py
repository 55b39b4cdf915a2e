"""Figures from captions: the zone above each caption, what it holds, its box and confidence.

Captions meet the blocks, rasters and drawings of their page in equi-joins with residual range predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions.text import caption_label, is_caption, is_loose_caption, is_table_caption
from folioscope.operators.layout import text_area

# Fixed values of the extraction rules.
NARROW, COLUMN_BLOCKS = 0.55, 2
BARRIER_LINES, BARRIER_WIDTH, BARRIER_SIZE, HEADING_STEP = 2, 0.5, 0.6, 0.5
BELOW_SLACK, FALLBACK_HEIGHT, PAD, BOTTOM_GAP = 2.0, 150.0, 3.0, 0.5
CONFIDENCE = {"graphics": 0.8, "text": 0.5, "nothing": 0.3, "embedded": 1.0}
EMBEDDED_SHARE = 0.9

PAGE = ["paper_id", "page"]
CAPTION = [*PAGE, "caption_no"]


def _boxed(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def captions(blocks: DataFrame) -> DataFrame:
    """Strict captions and loose candidates: (paper_id, page, caption_no, caption, loose, c_x0..c_y1)."""
    strict, loose = is_caption(F.col("text")), is_loose_caption(F.col("text"))
    return blocks.where(strict | loose).select(*PAGE, F.col("block_no").alias("caption_no"), F.col("text").alias("caption"), (~strict).alias("loose"), *_boxed("c_"))


def two_column(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """(paper_id, page, two_column): two narrow blocks or more on either side of the middle."""
    joined = blocks.join(areas, PAGE)
    narrow = G.width("") <= NARROW * G.width("area_")
    left = (F.col("x0") + F.col("x1")) / 2 < (F.col("area_x0") + F.col("area_x1")) / 2
    sides = joined.groupBy(*PAGE).agg(F.count_if(narrow & left).alias("l"), F.count_if(narrow & ~left).alias("r"))
    return sides.select(*PAGE, ((F.col("l") >= COLUMN_BLOCKS) & (F.col("r") >= COLUMN_BLOCKS)).alias("two_column"))


def spans_of_zones(found: DataFrame, areas: DataFrame, columns: DataFrame) -> DataFrame:
    """Horizontal extent of each caption's zone: its column if the page has two and the caption is narrow, else the text width."""
    joined = found.join(areas, PAGE).join(columns, PAGE)
    mid = (F.col("area_x0") + F.col("area_x1")) / 2
    own = F.col("two_column") & (G.width("c_") <= NARROW * G.width("area_"))
    left = (F.col("c_x0") + F.col("c_x1")) / 2 < mid
    return joined.withColumn("z_x0", F.when(own & ~left, mid).otherwise(F.col("area_x0"))).withColumn("z_x1", F.when(own & left, mid).otherwise(F.col("area_x1")))


def is_barrier(zone_width: Column, body: str = "body_size") -> Column:
    """A block that ends a zone: a caption (titled), a paragraph of body text, or a bold heading line."""
    paragraph = (F.col("lines") >= BARRIER_LINES) & (G.width("") >= BARRIER_WIDTH * zone_width) & (F.abs(F.col("mode_size") - F.col(body)) <= BARRIER_SIZE)
    heading = (F.col("lines") == 1) & F.col("all_bold") & (F.col("mode_size") > F.col(body) + HEADING_STEP)
    return F.col("titled") | paragraph | heading


def blocks_above(zoned: DataFrame, blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Blocks above each caption within its extent, nearest first (ties in block order): (…caption, x0..y1, near, barrier)."""
    # texts are looked at before the join and stay behind
    titled = is_caption(F.col("text")) | is_table_caption(F.col("text"))
    flagged = blocks.select(*PAGE, F.col("block_no").alias("_block"), "x0", "y0", "x1", "y1", "lines", "mode_size", "all_bold", titled.alias("titled"))
    met = zoned.join(bodies, "paper_id").join(flagged, PAGE)
    above = (F.col("_block") != F.col("caption_no")) & (F.col("y1") <= F.col("c_y0") + BELOW_SLACK) & G.x_overlaps("", "z_")
    order = W.partitionBy(*CAPTION).orderBy(F.desc("y1"), "_block")
    return met.where(above).select(*CAPTION, "x0", "y0", "x1", "y1", F.row_number().over(order).alias("near"), is_barrier(F.col("z_x1") - F.col("z_x0")).alias("barrier"))


def zones(found: DataFrame, blocks: DataFrame, bodies: DataFrame, graphics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captions with z_x0..z_y1, and the innards: blocks nearer than the first barrier. Who stores the captions takes innards() of what is stored.

    graphics(paper_id, page, x0..y1, raster) are placements and drawings. Without a barrier a zone begins at the page's highest text or graphic.
    """
    areas = text_area(blocks)
    zoned = spans_of_zones(found, areas, two_column(blocks, areas))
    above = blocks_above(zoned, blocks, bodies)
    # a caption's blocks are of one page
    each = F.collect_list(F.struct("near", "barrier", "x0", "y0", "x1", "y1")).alias("above")
    first = above.groupBy(*CAPTION).agg(F.min(F.when(F.col("barrier"), F.col("near"))).alias("barrier_near"), F.max(F.when(F.col("barrier"), F.col("y1"))).alias("barrier_y"), each)
    tops = graphics.groupBy(*PAGE).agg(F.min("y0").alias("graphic_top"))
    open_top = F.least("area_y0", F.coalesce("graphic_top", "area_y0"))
    zoned = zoned.join(tops, PAGE, "left").join(first, CAPTION, "left").withColumn("z_y0", F.coalesce("barrier_y", open_top)).withColumn("z_y1", F.col("c_y0"))
    zoned = zoned.withColumn("inner", F.filter("above", lambda b: F.col("barrier_near").isNull() | (b["near"] < F.col("barrier_near")))).drop("above")
    return zoned, innards(zoned)


def innards(zoned: DataFrame) -> DataFrame:
    """Blocks that zones() has found nearer than the first barrier: (…caption, z_x0..z_y1, x0..y1)."""
    return zoned.select(*CAPTION, *(f"z_{c}" for c in ("x0", "y0", "x1", "y1")), F.inline(F.transform("inner", lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))))


def graphics_in_zones(zoned: DataFrame, graphics: DataFrame) -> DataFrame:
    return zoned.select(*CAPTION, "z_x0", "z_y0", "z_x1", "z_y1").join(graphics, PAGE).where(G.in_zone("", "z_")).select(*CAPTION, "x0", "y0", "x1", "y1", "raster")


def figures(zoned: DataFrame, innards: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """What zones() gives, with its page's graphics and extent -> (paper_id, page, caption_no, figure_index, figure_number, caption, x0..y1, extraction_confidence, method).

    Loose captions count only with graphics in their zone. Index: pages, then caption height; ties strict before loose, then block order.
    """
    held = graphics_in_zones(zoned, graphics)
    inner = innards.where(G.in_zone("", "z_") & G.x_inside("", "z_"))
    content = held.select(*CAPTION, "x0", "y0", "x1", "y1", F.lit(True).alias("graphic"), "raster").unionByName(inner.select(*CAPTION, "x0", "y0", "x1", "y1", F.lit(False).alias("graphic"), F.lit(False).alias("raster")))
    shape = content.groupBy(*CAPTION).agg(*G.union(to="u_"), F.bool_or("graphic").alias("graphic"), F.count_if("raster").alias("rasters"), F.max(F.when(F.col("raster"), G.area(""))).alias("raster_area"))
    joined = zoned.join(pages.select(*PAGE, *_boxed("p_")), PAGE).join(shape, CAPTION, "left").where("not loose or graphic")
    filled = (
        joined.withColumn("u_x0", F.coalesce("u_x0", "z_x0")).withColumn("u_x1", F.coalesce("u_x1", "z_x1"))
        .withColumn("u_y0", F.coalesce("u_y0", F.greatest(F.col("z_y0"), F.col("c_y0") - FALLBACK_HEIGHT))).withColumn("u_y1", F.coalesce("u_y1", "c_y0"))
    )
    boxed = filled.select(
        *CAPTION, "caption", "loose", "c_y0", "graphic", "rasters", "raster_area",
        F.greatest(F.greatest("u_x0", "z_x0") - PAD, F.col("p_x0")).alias("x0"),
        F.greatest(F.greatest(F.greatest("u_y0", "z_y0") - PAD, F.col("z_y0")), F.col("p_y0")).alias("y0"),
        F.least(F.least("u_x1", "z_x1") + PAD, F.col("p_x1")).alias("x1"),
        F.least(F.least(F.least("u_y1", "z_y1") + PAD, F.col("z_y1") - BOTTOM_GAP), F.col("p_y1")).alias("y1"),
    )
    embedded = (F.col("rasters") == 1) & (F.col("raster_area") >= EMBEDDED_SHARE * G.area(""))
    order = W.partitionBy("paper_id").orderBy("page", "c_y0", "loose", "caption_no")
    level = F.when(embedded, CONFIDENCE["embedded"]).when(F.col("graphic"), CONFIDENCE["graphics"]).when(F.col("graphic").isNotNull(), CONFIDENCE["text"]).otherwise(CONFIDENCE["nothing"])
    method = F.when(embedded, "embedded").when(F.col("graphic").isNotNull(), "render").otherwise("render-fallback")
    return boxed.select(*CAPTION, F.row_number().over(order).alias("figure_index"), caption_label(F.col("caption")).alias("figure_number"), "caption", "x0", "y0", "x1", "y1", level.alias("extraction_confidence"), method.alias("method"))


def image_uri(paper: Column, index: Column) -> Column:
    return F.concat(F.lit("local://figures/"), paper.cast("string"), F.lit("/figure_"), index.cast("string"), F.lit(".png"))


#: Fixed value: resolution of rendered figures.
RENDER_DPI = 200


def image_requests(found: DataFrame, rasters: DataFrame) -> DataFrame:
    """(paper_id, figure_index, image_uri, page, x0..y1, dpi, xref): what makes each figure's picture. xref: the raster image that covers the
    box and whose own bytes are the picture; dpi: where there is none, the box is to be rendered at so many dots an inch.

    rasters(paper_id, page, xref, x0..y1): of several images in a box the one that covers most of it, ties to the lowest xref.
    """
    boxes = rasters.select("paper_id", "page", "xref", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    covered = F.greatest(G.x_shared("", "r_"), F.lit(0.0)) * F.greatest(G.y_shared("", "r_"), F.lit(0.0))
    own = found.where(F.col("method") == "embedded").join(boxes, ["paper_id", "page"]).groupBy("paper_id", "figure_index").agg(F.max_by("xref", F.struct(covered, -F.col("xref"))).alias("xref"))
    return found.join(own, ["paper_id", "figure_index"], "left").select("paper_id", "figure_index", image_uri(F.col("paper_id"), F.col("figure_index")).alias("image_uri"), "page", "x0", "y0", "x1", "y1", F.when(F.col("xref").isNull(), RENDER_DPI).alias("dpi"), "xref")


def image_files(requests: DataFrame, originals: DataFrame, rendered: DataFrame) -> DataFrame:
    """(image_uri, content): an image's own bytes from originals(paper_id, xref, content) where a request names one, else what a renderer
    made of the request, rendered(image_uri, content). A picture that is in neither is null."""
    kept = requests.where("xref is not null").join(originals.select("paper_id", "xref", "content"), ["paper_id", "xref"], "left").select("image_uri", "content")
    made = requests.where("xref is null").join(rendered.select("image_uri", "content"), "image_uri", "left").select("image_uri", "content")
    return kept.unionAll(made)
