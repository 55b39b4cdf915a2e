"""Text predicates and scalar functions as Column expressions (code points, Unicode white space)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, limits and word lists that results depend on.
CAPTION = r"(?i)^(Figure|Fig\.)\s+(\d+)\s*[.:]"
LOOSE_CAPTION = r"(?i)^(Figure|Fig\.)\s+(\d+)\s+\S"
TABLE_CAPTION = r"(?i)^Table\s+\d+\s*[.:]"
BIBLIOGRAPHY = r"^\[\d+\]\s"
FIGURE_NUMBER = r"^Figure\s+(\d+)$"
REFERENCE = r"(?i)\b(?:Figure|Fig\.)\s*(\d+)"
LOOSE_CAPTION_LIMIT = 150
QUOTE = r"[\"“”](.+?)[\"“”]"
QUOTE_LEAST = 12
PLOT_WORDS = ("training", "error", "accuracy", "loss", "std", "standard deviation", "curve", " rate", "convergence", " vs ")
QUALITATIVE_WORDS = ("example of", "visualization", "visualisation", "qualitative", "sample", "attention head", "mechanism following", "involved in", "exhibit behaviour", "exhibit behavior")
ARCHITECTURE_WORDS = (
    "architecture", "building block", "block", "framework", "network", "module", "residual function", "residual learning",
    "diagram", "pipeline", "structure", "attention", "encoder", "decoder", "convolution", "model",
)
HANGUL, HANGUL_LEAST = "[가-힣]", 10
FOREIGN = "[一-鿿Ѐ-ӿ]"
POLITE_END = "니다"


def collapsed(text: Column) -> Column:
    """White space runs become one space, ends are stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalised(text: Column) -> Column:
    """Collapsed but not stripped, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def is_loose_caption(text: Column, limit: int = LOOSE_CAPTION_LIMIT) -> Column:
    return text.rlike(LOOSE_CAPTION) & (F.length(text) <= limit)


def is_caption_paragraph(text: Column) -> Column:
    return is_caption(text) | is_loose_caption(text)


def is_table_caption(text: Column) -> Column:
    return text.rlike(TABLE_CAPTION)


def is_bibliography(text: Column) -> Column:
    return text.rlike(BIBLIOGRAPHY)


def is_non_body(text: Column) -> Column:
    return is_caption_paragraph(text) | is_table_caption(text) | is_bibliography(text)


def figure_number(label: Column) -> Column:
    """Digits of 'Figure N', null for anything else. Numbers are texts: 01 is not 1."""
    return F.nullif(F.regexp_extract(label, FIGURE_NUMBER, 1), F.lit(""))


def caption_label(caption: Column) -> Column:
    """'Figure N' from a strict or loose caption, null otherwise."""
    n = F.regexp_extract(caption, r"(?i)^(?:Figure|Fig\.)\s+(\d+)\s*(?:[.:]|\s\S)", 1)
    return F.when(n != "", F.concat(F.lit("Figure "), n))


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{IsLowercase}")


def joined(left: Column, right: Column) -> Column:
    """Two fragments with a space between, or a line-break hyphen removed."""
    hyphen = F.endswith(left, F.lit("-")) & starts_lower(right)
    return F.when(F.coalesce(left, F.lit("")) == "", right).when(hyphen, F.concat(F.expr("''"), F.left(left, F.length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


def join_fragments(parts: Column) -> Column:
    """Ordered fragments of an array as one text."""
    return F.aggregate(parts, F.lit(""), joined)


def first_span(text: Column, pattern: Column) -> Column:
    """[start, end) of the first match in code points (regexp_instr would count UTF-16 units), null without one."""
    found = F.regexp_substr(text, pattern)
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    return F.when(found.isNotNull(), F.array(start, start + F.length(found)))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def figure_type(caption: Column) -> Column:
    """plot, qualitative, architecture or other, by the first list one of whose words the caption contains."""
    text = F.lower(collapsed(caption))
    return (
        F.when(contains_any(text, PLOT_WORDS), "plot").when(contains_any(text, QUALITATIVE_WORDS), "qualitative").when(contains_any(text, ARCHITECTURE_WORDS), "architecture").otherwise("other")
    )


def quotes(reason: Column, least: int = QUOTE_LEAST) -> Column:
    """Normalised quotes of at least so many characters."""
    found = F.regexp_extract_all(reason, F.lit(QUOTE), F.lit(1))
    return F.filter(F.transform(found, normalised), lambda q: F.length(q) >= least)


def not_fabricated(reason: Column, paragraph: Column) -> Column:
    """Without a meaningful quote, or one of the quotes is in the paragraph."""
    found = quotes(reason)
    body = normalised(paragraph)
    return (F.size(found) == 0) | F.exists(found, lambda q: F.contains(body, q))


def looks_korean(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HANGUL)) >= HANGUL_LEAST


def has_foreign_script(text: Column) -> Column:
    return text.rlike(FOREIGN)


def polite_korean(text: Column) -> Column:
    """Every sentence ends politely, and there is one."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\([^()]*\)", ""), r"(?U)^\s+|\s+$", ""), "[^가-힣]+$", "")
    ends = F.filter(F.transform(F.split(text, r"(?<=[.!?])(?U)\s+"), bare), lambda s: s != "")
    return (F.size(ends) > 0) & F.forall(ends, lambda s: F.endswith(s, F.lit(POLITE_END)))


def clean_style(text: Column) -> Column:
    return ~has_foreign_script(text) & polite_korean(text)


def object_slice(text: Column) -> Column:
    """From the first { to the last } as VARIANT; null if there is none or it is not JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def verdict(response: Column) -> Column:
    """struct(is_relevant, reason) of a model's answer. Any JSON value but null, false, 0, "", [] and {} is relevant."""
    sliced = F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))
    ok = F.try_parse_json(sliced).isNotNull()
    value = F.get_json_object(sliced, "$.is_relevant")
    truthy = value.isNotNull() & ~F.trim(value).isin("", "false", "0", "0.0", "-0", "[]", "{}", "null")
    quoted = sliced.rlike(r'"is_relevant"\s*:\s*"(false|0|0\.0|-0|\[\]|\{\}|null)"')
    return F.struct(F.coalesce(ok & (truthy | quoted), F.lit(False)).alias("is_relevant"), F.when(ok, F.coalesce(F.get_json_object(sliced, "$.reason"), F.lit(""))).otherwise("").alias("reason"))


def folded_title(title: Column) -> Column:
    """A title for comparing: two ligatures written out, lower case, everything but a-z and 0-9 as one space, trimmed."""
    plain = F.replace(F.replace(title, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))
