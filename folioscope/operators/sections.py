"""Sections and paragraphs from rows of text: order-dependent rules as three window passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.geometry import union
from folioscope.functions.text import join_fragments, joined, starts_lower

# Limits and patterns of headings and page numbers, the title of what comes before the first heading.
HEADING_LIMIT, SIZE_STEP = 120, 0.5
NUMBERED = r"^(\d{1,2}(\.\d{1,2})*)\.?\s+([A-Z][^\s]*(\s+\S+)*)$"
KEYWORD = r"(?i)^(Abstract|Introduction|Background|Related Works?|Methods?|Experiments?|Results?|Discussion|Conclusions?|References|Bibliography|Acknowledg(e)?ments?|Appendix(\s+[A-Z].*)?)$"
PAGE_NUMBER = r"^\d{1,4}$"
FRONT = "Front Matter"

PLACE = ["page", "block_no", "row_no"]


def styled(parts: str = "parts", body: str = "body_size") -> Column:
    """Every line of a row is bold or larger than the body."""
    return F.forall(parts, lambda p: p["bold"] | (p["max_size"] > F.col(body) + SIZE_STEP))


def is_heading(text: str = "text", all_styled: Column | None = None) -> Column:
    numbered = F.col(text).rlike(NUMBERED) & F.regexp_extract(text, NUMBERED, 3).rlike("[A-Za-z]{2}")
    return (F.length(text) <= HEADING_LIMIT) & (styled() if all_styled is None else all_styled) & (numbered | F.col(text).rlike(KEYWORD))


def is_page_number(text: str = "text", all_styled: Column | None = None) -> Column:
    return F.col(text).rlike(PAGE_NUMBER) & ~(styled() if all_styled is None else all_styled)


def segmented(rows: DataFrame) -> DataFrame:
    """rows(paper_id, page, block_no, row_no, text, styled, x0..y1) -> rows without page numbers, with
    heading, the running heading count (0 before the first) and section_order.

    Front matter has order 0 and shifts the rest only in a paper that has some.
    """
    flagged = rows.where(~is_page_number(all_styled=F.col("styled"))).withColumn("heading", is_heading(all_styled=F.col("styled")))
    order = W.partitionBy("paper_id").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, 0)
    paper = W.partitionBy("paper_id")
    counted = flagged.withColumn("headings", F.sum(F.col("heading").cast("int")).over(order).cast("int"))
    front = F.max(((F.col("headings") == 0)).cast("int")).over(paper)
    return counted.withColumn("section_order", (F.col("headings") - 1 + front).cast("int"))


def fragments(rows: DataFrame) -> DataFrame:
    """Runs of body rows inside one block and section: (paper_id, section_order, page, block_no, headings, text, x0..y1)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda s: s["text"])
    found = rows.where("not heading").groupBy("paper_id", "section_order", "headings", "page", "block_no").agg(join_fragments(ordered).alias("text"), *union())
    return found.where("text <> ''")


def paragraphs(parts: DataFrame) -> DataFrame:
    """Fragments that start in lower case go on the paragraph before them in their section.

    -> (paper_id, section_order, `order`, page, text, x0..y1, last_page); page and box are the first fragment's.
    """
    section = W.partitionBy("paper_id", "section_order").orderBy("page", "block_no")
    starts = (~starts_lower(F.col("text"))) | (F.row_number().over(section) == 1)
    grouped = parts.withColumn("starts", starts.cast("int")).withColumn("order", (F.sum("starts").over(section.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    each = F.struct("page", "block_no", "text", "x0", "y0", "x1", "y1")
    whole = grouped.groupBy("paper_id", "section_order", "order").agg(F.array_sort(F.collect_list(each)).alias("parts"), F.max("page").alias("last_page"))
    text = join_fragments(F.transform("parts", lambda p: p["text"]))
    first = F.get("parts", F.lit(0))
    return whole.select("paper_id", "section_order", "order", first["page"].alias("page"), text.alias("text"), *(first[c].alias(c) for c in ("x0", "y0", "x1", "y1")), "last_page")


def sections(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(paper_id, section_order, title, page_start, page_end): page_end is the last page with a fragment, the start without one."""
    place = F.struct(*PLACE)
    heads = rows.groupBy("paper_id", "section_order").agg(F.min_by("page", place).alias("page_start"), F.min_by(F.when(F.col("heading"), F.col("text")).otherwise(FRONT), place).alias("title"))
    ends = parts.groupBy("paper_id", "section_order").agg(F.max("page").alias("last"))
    return heads.join(ends, ["paper_id", "section_order"], "left").select("paper_id", "section_order", "title", "page_start", F.greatest("page_start", F.coalesce("last", "page_start")).alias("page_end"))


def unreadable(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Papers without any paragraph: (paper_id, status, message)."""
    return papers.select("paper_id").join(found.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit("failed").alias("status"), F.lit("no text").alias("message"))


__all__ = ["fragments", "is_heading", "is_page_number", "joined", "paragraphs", "sections", "segmented", "styled", "unreadable"]
