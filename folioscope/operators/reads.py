"""Read views over the stored tables, and the checks that foreign keys and closed sets would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROCESSING = ("parsing", "extracting_figures", "matching", "explaining")


def history(papers: DataFrame, figures: DataFrame) -> DataFrame:
    """Papers with their figure counts, newest first, then by id from the highest."""
    counts = figures.groupBy("paper_id").agg(F.count("*").alias("figure_count"))
    joined = papers.join(counts, "paper_id", "left").withColumn("figure_count", F.coalesce("figure_count", F.lit(0)))
    return joined.orderBy(F.desc("created_at"), F.desc("paper_id"))


def evidence(matches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Matches with their paragraphs, by score from the highest, ties in document order (stricter than the score alone)."""
    joined = matches.join(paragraphs.select("paragraph_id", "section_order", "p_order", "page", "text"), "paragraph_id")
    return joined.orderBy("figure_id", F.desc("relevance_score"), "section_order", "p_order")


def ordered_paragraphs(paragraphs: DataFrame, sections: DataFrame, paper: Column | None = None) -> DataFrame:
    joined = paragraphs.join(sections.select("paper_id", "section_order", "title"), ["paper_id", "section_order"])
    return (joined if paper is None else joined.where(paper)).orderBy("paper_id", "section_order", "p_order")


def nested_sections(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Sections with their paragraphs as an ordered array, empty without any."""
    own = paragraphs.groupBy("paper_id", "section_order").agg(F.array_sort(F.collect_list(F.struct("p_order", "paragraph_id"))).alias("own"))
    empty = F.array().cast("array<bigint>")
    return sections.join(own, ["paper_id", "section_order"], "left").withColumn("paragraph_ids", F.coalesce(F.transform("own", lambda p: p["paragraph_id"]), empty)).drop("own").orderBy("paper_id", "section_order")


def figure_list(figures: DataFrame, explanations: DataFrame) -> DataFrame:
    """Figures by page and number (as text), with their explanation if there is one."""
    return figures.join(explanations, "figure_id", "left").orderBy("paper_id", "page", "figure_number")


def by_key(rows: DataFrame, **keys: object) -> DataFrame:
    """Point lookup; an empty result means not found."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def highlighted(paragraphs: DataFrame, matches: DataFrame) -> DataFrame:
    return paragraphs.join(matches.select("paragraph_id").distinct(), "paragraph_id", "left_semi")


def known_references(matches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Matches whose paragraph is there to be shown."""
    return matches.join(paragraphs.select("paragraph_id"), "paragraph_id", "left_semi")


def scroll_target(matches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """First matched paragraph of each figure in document order."""
    joined = matches.join(paragraphs.select("paragraph_id", "section_order", "p_order"), "paragraph_id")
    return joined.groupBy("figure_id").agg(F.min_by("paragraph_id", F.struct("section_order", "p_order")).alias("paragraph_id"))


def display_name(title: Column, filename: Column) -> Column:
    return F.coalesce(title, filename)


def stage_index(status: Column) -> Column:
    """1 to 4 for a processing stage, else 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, PROCESSING)), status), F.lit(0)).cast("int")


def is_terminal(status: Column) -> Column:
    return status.isin("done", "failed")


def elapsed_seconds(created: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(created)) / 1_000_000)).cast("long")


def upload_error(filename: Column, size: Column) -> Column:
    """Why an upload is refused, null if it is not. A missing name counts as unnamed.pdf."""
    name = F.coalesce(F.nullif(filename, F.lit("")), F.lit("unnamed.pdf"))
    return F.when(~F.endswith(F.lower(name), F.lit(".pdf")), "not a pdf").when(F.coalesce(size, F.lit(0)) <= 0, "empty")


def resolved_uri(uri: Column) -> Column:
    """Path of a local:// address; any other scheme is an error."""
    return F.when(F.startswith(uri, F.lit("local://")), F.substring(uri, 9, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("unsupported address: "), uri)))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing (what a foreign key would refuse)."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def outside(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not in a closed set (nulls included)."""
    return rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def paper_status(parsed: Column, extracted: Column, matched: Column, explained: Column, failed: Column) -> Column:
    """Status after the stages that are done."""
    return F.when(failed, "failed").when(explained, "done").when(matched, "explaining").when(extracted, "matching").when(parsed, "extracting_figures").otherwise("parsing")
