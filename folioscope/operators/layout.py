"""Text lines, blocks and font sizes from page-layout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.geometry import union
from folioscope.functions.text import collapsed

BLOCK = ["paper_id", "page", "block_no"]
LINE = [*BLOCK, "line_no"]
BOX = ["x0", "y0", "x1", "y1"]
# The bold bit of span flags, the tolerance of horizontal writing, the archive's watermark, the size without text.
BOLD, TILT, WATERMARK, NO_TEXT_SIZE = 16, 0.01, r"^arXiv:\d{4}\.\d{4,5}", 10.0


def ordered_text(order: str, text: str, between: str = "") -> Column:
    """Texts of a group in an order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda s: s[text]), between)


def bold(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(BOLD) != 0


def text_lines(blocks: DataFrame, lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Horizontal lines of text blocks: (…line, text, x0..y1, max_size, bold). Empty lines and watermarks are dropped.

    Lines, their spans and their blocks meet as rows of one group instead of in joins: tables that are dealt by paper are not dealt again.
    """
    upright = lines.where(F.abs(F.col("dir_x") - 1.0) <= TILT).select(*LINE, F.struct(*BOX).alias("box"))
    sized = spans.select(*LINE, F.struct("span_no", "text").alias("span"), F.round("size", 1).alias("size"), bold().alias("bold"))
    bodies = blocks.where("type = 0").select(*BLOCK, F.lit(None).cast("int").alias("line_no"), F.lit(True).alias("body"))
    met = sized.unionByName(upright, allowMissingColumns=True).unionByName(bodies, allowMissingColumns=True)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list("span")), lambda s: s["text"]), "")
    line = met.groupBy(*LINE).agg(raw.alias("raw"), F.max("size").alias("max_size"), F.bool_or("bold").alias("bold"), F.first("box", ignorenulls=True).alias("box"), F.bool_or("body").alias("body"))
    kept = line.withColumn("body", F.bool_or("body").over(W.partitionBy(*BLOCK))).where("body and box is not null")
    text = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    return kept.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").rlike(WATERMARK)).select(*LINE, "text", "box.*", "max_size", "bold")


def text_blocks(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Text blocks with collapsed text, rotated lines and watermarks included: (…block, text, x0..y1, lines, mode_size, all_bold)."""
    body = blocks.where("type = 0").select(*BLOCK, F.struct(*BOX).alias("box"))
    span = F.struct("line_no", "span_no", F.coalesce("text", F.lit("")).alias("text"), F.round("size", 1).alias("size"))
    met = spans.select(*BLOCK, span.alias("span"), _inked_bold().alias("bold"), _inked().alias("inked")).unionByName(body, allowMissingColumns=True)
    # one group a block, so that spans are sorted once; the rest is within the block's array
    block = met.groupBy(*BLOCK).agg(F.array_sort(F.collect_list("span")).alias("spans"), F.coalesce(F.bool_and("bold"), F.lit(False)).alias("all_bold"), F.first("box", ignorenulls=True).alias("box"), F.bool_or("inked").alias("inked")).where("box is not null and inked")
    ordered = F.col("spans")
    begins = lambda s, i: (i > 0) & (s["line_no"] != ordered[F.greatest(i - 1, F.lit(0))]["line_no"])
    text = collapsed(F.array_join(F.transform(ordered, lambda s, i: F.when(begins(s, i), F.concat(F.lit(" "), s["text"])).otherwise(s["text"])), ""))
    lines = F.size(F.array_distinct(F.transform(ordered, lambda s: s["line_no"])))
    sizes = F.array_distinct(F.transform(ordered, lambda s: s["size"]))  # in the order they are met
    weight = lambda z: F.aggregate(ordered, F.lit(0), lambda n, s: n + F.when(s["size"].eqNullSafe(z), F.length(s["text"])).otherwise(0))
    heavy = F.array_min(F.transform(sizes, lambda z, i: F.struct((-weight(z)).alias("w"), i.alias("met"), z.alias("size"))))
    return block.select(*BLOCK, "box.*", text.alias("text"), lines.alias("lines"), heavy["size"].alias("mode_size"), "all_bold")


def graphics_of_kind(graphics: DataFrame, raster: bool) -> DataFrame:
    """Rectangles of the raster images of the pages, or of their clustered drawings."""
    return graphics.where(F.col("raster") == raster).select("paper_id", "page", *BOX)


def mode_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Size that most characters of a group's spans have; ties go to the size met first."""
    # the place as one number, which is aggregated by hashing; a struct would have every span sorted, text and all
    pair = lambda a, b: F.col(a).cast("long") * (1 << 31) + F.col(b)
    place = pair("page", "block_no").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + pair("line_no", "span_no").cast("decimal(19,0)")
    sized = spans.groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("weight"), F.min(place).alias("met"))
    # the earliest of the heaviest: sort ascending by -weight, then by place
    return sized.groupBy(*keys).agg(F.min_by("size", F.struct((-F.col("weight")).alias("w"), "met")).alias("size"))


def body_size_of_lines(lines: DataFrame) -> DataFrame:
    """Body font size of each paper from its lines; a paper without lines has no row and is an error row upstream."""
    sized = lines.groupBy("paper_id", "max_size").agg(F.sum(F.length("text")).alias("weight"), F.min(F.struct("page", "block_no", "line_no")).alias("met"))
    return sized.groupBy("paper_id").agg(F.min_by("max_size", F.struct((-F.col("weight")).alias("w"), "met")).alias("body_size"))


def with_body_size(lines: DataFrame) -> DataFrame:
    """Lines with the body_size of their paper, as body_size_of_lines() has it, without a second pass over them."""
    same = W.partitionBy("paper_id", "max_size")
    heavy = F.struct((-F.sum(F.length("text")).over(same)).alias("w"), F.min(F.struct("page", "block_no", "line_no")).over(same).alias("met"), "max_size")
    return lines.withColumn("heavy", heavy).withColumn("body_size", F.min("heavy").over(W.partitionBy("paper_id"))["max_size"]).drop("heavy")


def body_sizes(spans: DataFrame) -> DataFrame:
    """Body font size of each paper that has spans."""
    return mode_size(spans, ["paper_id"]).select("paper_id", F.coalesce("size", F.lit(NO_TEXT_SIZE)).alias("body_size"))


def body_size_of_spans(papers: DataFrame, spans: DataFrame) -> DataFrame:
    """Body font size of each paper from all spans, NO_TEXT_SIZE without any."""
    return papers.select("paper_id").join(body_sizes(spans), "paper_id", "left").select("paper_id", F.coalesce("body_size", F.lit(NO_TEXT_SIZE)).alias("body_size"))


def _inked() -> Column:
    return F.col("text").rlike(r"(?U)\S")


def _inked_bold() -> Column:
    """Whether a span is bold, null for a blank one."""
    return F.when(_inked(), bold())


def all_bold(spans: DataFrame) -> DataFrame:
    """Whether a block has non-blank spans and all of them are bold."""
    return spans.groupBy(*BLOCK).agg(F.coalesce(F.bool_and(_inked_bold()), F.lit(False)).alias("all_bold"))


def text_area(blocks: DataFrame) -> DataFrame:
    """Rectangle around a page's text blocks."""
    return blocks.groupBy("paper_id", "page").agg(*union(to="area_"))


def rows_of_lines(lines: DataFrame) -> DataFrame:
    """Lines of a block that share a vertical interval become one row, by a fold over the block's lines.

    A line joins the current row if it overlaps the row's accumulated interval by more than half of the smaller height.
    -> (…block, row_no, text, x0..y1, parts) with parts = the lines' (size, bold), and body_size where the lines have it.
    """
    given = ["body_size"] if "body_size" in lines.columns else []
    first = [F.first(c).alias(c) for c in given]
    line = F.struct("line_no", "x0", "y0", "x1", "y1", "text", "max_size", "bold")
    sorted_lines = F.array_sort(F.collect_list(line))
    start = "named_struct('row', -1, 'y0', 0D, 'y1', 0D, 'of', cast(array() as array<int>))"
    height = "least(s.y1 - s.y0, l.y1 - l.y0)"
    meets = f"s.row >= 0 and {height} > 0 and (least(s.y1, l.y1) - greatest(s.y0, l.y0)) / {height} > 0.5"
    step = (
        f"(s, l) -> if({meets}, named_struct('row', s.row, 'y0', least(s.y0, l.y0), 'y1', greatest(s.y1, l.y1), 'of', concat(s.of, array(s.row))), "
        "named_struct('row', s.row + 1, 'y0', l.y0, 'y1', l.y1, 'of', concat(s.of, array(s.row + 1))))"
    )
    blocks = lines.groupBy(*BLOCK).agg(sorted_lines.alias("lines"), *first).withColumn("of", F.expr(f"aggregate(lines, {start}, {step}, s -> s.of)"))
    each = blocks.select(*BLOCK, *given, F.explode(F.arrays_zip("of", "lines")).alias("z")).select(*BLOCK, *given, F.col("z.of").alias("row_no"), "z.lines.*")
    across = F.transform(F.array_sort(F.collect_list(F.struct("x0", "line_no", "text"))), lambda s: s["text"])
    return each.groupBy(*BLOCK, "row_no").agg(collapsed(F.array_join(across, " ")).alias("text"), *union(), F.collect_list(F.struct("max_size", "bold")).alias("parts"), *first)
