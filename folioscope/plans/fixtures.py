"""Papers, paragraphs, figures and page layout derived from the test tables.

The tables hold plain prose, so each document is taken as a paper and each of its lines as a paragraph or layout
block, and markers are added by arithmetic on (document, line). The same derivation is written for Spark and for
DuckDB; only functions that differ between the two are looked up.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "lines": "SELECT doc_id AS paper_id, CAST(pos AS INT) AS n, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line",
    "numbered": "SELECT doc_id AS paper_id, num FROM {documents} LATERAL VIEW explode(array(1, 2, 3, 10, 12)) t AS num",
    "pieces": "SELECT paper_id, n, CAST(pos AS INT) AS i, piece FROM lines LATERAL VIEW posexplode(split(line, ', ')) t AS pos, piece",
    "source": "{%s}",
    "quoted": r"""replace(replace(regexp_replace(substr(p.text, 5, 20), '[\\x00-\\x1f]', ' '), '\\', '\\\\'), '"', '\\"')""",
}
DUCK = {
    "lines": "SELECT doc_id AS paper_id, CAST(i - 1 AS INT) AS n, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)",
    "numbered": "SELECT doc_id AS paper_id, num FROM documents, unnest([1, 2, 3, 10, 12]) AS t(num)",
    "pieces": "SELECT paper_id, n, CAST(i - 1 AS INT) AS i, l[i] AS piece FROM (SELECT paper_id, n, string_split(line, ', ') AS l FROM lines), unnest(range(1, len(l) + 1)) AS t(i)",
    "source": "%s",
    "quoted": r"""replace(replace(regexp_replace(substr(p.text, 5, 20), '[\x00-\x1f]', ' ', 'g'), '\', '\\'), '"', '\"')""",
}

#: Common table expressions in order; each may use those before it.
COMMON = {
    "paragraphs": """
SELECT paper_id, paper_id * 100000 + n AS paragraph_id, CAST(floor(n / 8.0) AS INT) AS section_order, CAST(n % 8 AS INT) AS p_order, n AS ord, CAST(1 + floor(n / 12.0) AS INT) AS page,
  CASE (paper_id * 7 + n * 3) % 20
    WHEN 0 THEN 'Figure ' || k || ': ' || line WHEN 1 THEN 'Fig. ' || k || ' ' || line WHEN 2 THEN 'fig. ' || k || ' ' || line || ' and so on, and so on, and so on, and so on, and so on, and so on, and so on, and so on, and so on'
    WHEN 3 THEN 'Table ' || k || '. ' || line WHEN 4 THEN '[' || k || '] ' || line WHEN 5 THEN line || ' See Figure ' || k || '.' WHEN 6 THEN line || ' See Figure ' || k || ' and Fig. 1, FIGURE 10.'
    WHEN 7 THEN line || ' (fig. ' || k || ')' WHEN 8 THEN line || ' config. ' || k WHEN 9 THEN line || ' Figures ' || k || ' and 4' ELSE line END AS text
FROM (SELECT *, CAST((paper_id + n) % 12 + 1 AS STRING) AS k FROM lines) AS l""",
    "figures": """
SELECT paper_id, paper_id * 100 + num AS figure_id, CASE WHEN num = 3 AND paper_id % 5 = 0 THEN 'Figure ?3' ELSE 'Figure ' || CAST(num AS STRING) END AS figure_number,
  'Figure ' || CAST(num AS STRING) || CASE (paper_id + num) % 7 WHEN 0 THEN '. Training  Loss over time' WHEN 1 THEN ': Visualization of heads' WHEN 2 THEN ': The  encoder block' WHEN 3 THEN ': A garden in May'
    WHEN 4 THEN '. Accuracy vs depth of the network' WHEN 5 THEN ': Model diagram, sample of parts' ELSE '. Glossy paper' END AS caption,
  CAST(1 + num % 3 AS INT) AS page, CASE (paper_id + num) % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.8E0 WHEN 2 THEN 0.5E0 ELSE 0.3E0 END AS extraction_confidence,
  CASE (paper_id + num) % 3 WHEN 0 THEN 'explained' ELSE 'extracted' END AS status
FROM numbered""",
    "papers": """
SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Title ' || lang END AS title, source || '-' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END AS filename,
  CASE doc_id % 8 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'parsing' WHEN 2 THEN 'extracting_figures' WHEN 3 THEN 'matching' WHEN 4 THEN 'explaining' WHEN 5 THEN 'failed' ELSE 'done' END AS upload_status,
  CAST(doc_id % 37 AS INT) AS created, n_chars
FROM %(documents)s""",
    "blocks": """
SELECT paper_id, CAST(1 + floor(n / 12.0) AS INT) AS page, CAST(n % 12 AS INT) AS block_no, n, CASE WHEN (paper_id + n) % 17 = 0 THEN 1 ELSE 0 END AS type, kind,
  x0, 60.0E0 + 55.0E0 * step AS y0, x0 + wide AS x1, 60.0E0 + 55.0E0 * step + high AS y1
FROM (SELECT paper_id, n, (paper_id + n * 5) % 9 AS kind,
    CASE WHEN paper_id % 2 = 0 THEN 50.0E0 + 250.0E0 * (n % 2) ELSE 50.0E0 END AS x0,
    CASE WHEN paper_id % 2 = 0 THEN 230.0E0 - 3.0E0 * (n % 4) ELSE 480.0E0 - 5.0E0 * (n % 4) END AS wide,
    CASE WHEN paper_id % 2 = 0 THEN floor((n % 12) / 2.0) ELSE CAST(n % 12 AS DOUBLE) END AS step, 20.0E0 + (n % 3) * 10.0E0 AS high FROM lines) AS b""",
    # every fourth line stands beside the line before it, further left and higher than one line, and the line after it reaches into both
    "layout_lines": """
SELECT b.paper_id, page, block_no, i AS line_no, CASE WHEN i % 4 = 3 THEN x0 - 15.0E0 ELSE x0 END AS x0, CASE WHEN i % 4 = 3 THEN y0 + 10.0E0 * i - 8.0E0 WHEN i % 4 = 0 AND i > 0 THEN y0 + 10.0E0 * i - 6.0E0 ELSE y0 + 10.0E0 * i END AS y0, x1,
  CASE WHEN i % 4 = 3 THEN y0 + 10.0E0 * i + 9.0E0 WHEN i % 4 = 0 AND i > 0 THEN y0 + 10.0E0 * i + 3.0E0 ELSE y0 + 10.0E0 * i + 9.0E0 END AS y1, CASE WHEN (b.paper_id + b.n + i) % 13 = 0 THEN 0.0E0 ELSE 1.0E0 END AS dir_x, kind,
  CASE WHEN kind = 0 AND i = 0 THEN CAST(1 + b.n % 9 AS STRING) || ' Some ' || piece WHEN kind = 1 AND i = 0 THEN 'Introduction' WHEN kind = 2 THEN CAST(b.n AS STRING)
    WHEN kind = 3 AND i = 0 THEN 'Figure ' || CAST(1 + b.n % 12 AS STRING) || ': ' || piece WHEN kind = 4 AND i = 0 THEN 'Fig. ' || CAST(1 + b.n % 12 AS STRING) || ' ' || piece
    WHEN kind = 5 AND i = 0 THEN 'arXiv:1234.56789 ' || piece WHEN kind = 6 AND i = 0 THEN 'Table 3. ' || piece WHEN kind = 7 THEN lower(piece) || '-' WHEN kind = 8 THEN lower(piece) ELSE piece END AS line
FROM blocks AS b JOIN pieces AS p ON b.paper_id = p.paper_id AND b.n = p.n""",
    "layout_spans": """
SELECT paper_id, page, block_no, line_no, 0 AS span_no, substr(line, 1, 7) AS text, 10.0E0 + CASE WHEN kind <= 1 THEN 2.0E0 ELSE 0.0E0 END + (line_no % 3) * 0.04E0 AS size, CASE WHEN kind <= 1 THEN 20 ELSE 4 END AS flags FROM layout_lines
UNION ALL SELECT paper_id, page, block_no, line_no, 1, substr(line, 8), 10.0E0 + CASE WHEN kind = 0 THEN 2.0E0 ELSE 0.0E0 END, CASE WHEN kind <= 1 OR line_no % 5 = 4 THEN 16 ELSE 0 END FROM layout_lines WHERE length(line) > 7""",
    "layout_graphics": """
SELECT paper_id, page, x0 + 20.0E0 AS x0, y0 - 30.0E0 AS y0, x1 - 30.0E0 AS x1, y0 - 2.0E0 AS y1, (n % 2 = 0) AS raster FROM blocks WHERE kind = 3 AND (paper_id + page) % 3 <> 0 OR kind = 4 AND (paper_id + page) % 2 = 0""",
    "layout_pages": "SELECT DISTINCT paper_id, page, 0.0E0 AS x0, 0.0E0 AS y0, 612.0E0 AS x1, 792.0E0 AS y1 FROM blocks",
    "matches": """
SELECT f.figure_id, p.paragraph_id, CASE WHEN p.ord % 3 = 0 THEN 'explicit_reference' ELSE 'semantic_similarity' END AS match_type, CASE WHEN p.ord % 3 = 0 THEN 1.0E0 ELSE 0.5E0 + (p.ord % 5) * 0.1E0 END AS relevance_score
FROM figures AS f JOIN paragraphs AS p ON f.paper_id = p.paper_id WHERE (p.ord + f.figure_id) % 6 = 0 AND f.figure_id % 4 <> 1""",
    "sections": "SELECT paper_id, CAST(s AS INT) AS section_order, 'Section ' || CAST(CAST(s AS INT) AS STRING) AS title FROM (SELECT DISTINCT paper_id, floor(n / 8.0) AS s FROM lines UNION SELECT DISTINCT paper_id, 99 AS s FROM lines) AS x",
    "explanations": "SELECT figure_id, 'mock:m' || CAST(figure_id % 3 AS STRING) AS model_used FROM figures WHERE status = 'explained'",
    "paragraph_vectors": "SELECT paragraph_id, embedding FROM (SELECT paragraph_id, (paper_id * 31 + ord * 7) % (SELECT count(*) FROM %(embeddings)s) AS k FROM paragraphs) AS p JOIN %(embeddings)s AS e ON k = vec_id",
    "caption_vectors": "SELECT figure_id, embedding FROM (SELECT figure_id, (figure_id * 5) % (SELECT count(*) FROM %(embeddings)s) AS k FROM figures) AS f JOIN %(embeddings)s AS e ON k = vec_id",
    "responses": """
SELECT f.figure_id, p.paragraph_id, p.text, CASE (p.ord + f.figure_id) % 9
    WHEN 0 THEN '{"is_relevant": true, "reason": "fits"}' WHEN 1 THEN 'Sure: {"is_relevant": true, "reason": "it says “' || %(quoted)s || '”"} ok' WHEN 2 THEN '{"is_relevant": true, "reason": "it says “never written anywhere”"}'
    WHEN 3 THEN '{"is_relevant": false, "reason": "no"}' WHEN 4 THEN '{"is_relevant": "no"}' WHEN 5 THEN 'no json' WHEN 6 THEN '{"is_relevant": true, "reason": ' WHEN 7 THEN '{"is_relevant": 0}' ELSE '{"reason": "“short” quote", "is_relevant": 1}' END AS response
FROM figures AS f JOIN paragraphs AS p ON f.paper_id = p.paper_id""",
}
# Spark makes a block's lines from the block's own line of text: nothing is joined, so a paper's rows stay where the paper is.
_BLOCKS_WITH_LINE = COMMON["blocks"].replace("block_no, n, CASE", "block_no, n, line, CASE").replace("(SELECT paper_id, n, (paper_id", "(SELECT paper_id, n, line, (paper_id")
SPARK["layout_lines"] = COMMON["layout_lines"].replace("blocks AS b JOIN pieces AS p ON b.paper_id = p.paper_id AND b.n = p.n", f"({_BLOCKS_WITH_LINE}) AS b LATERAL VIEW posexplode(split(b.line, ', ')) p AS i, piece")
SPARK["layout_spans"] = """
SELECT paper_id, page, block_no, line_no, s.span_no, s.text, s.size, s.flags FROM layout_lines LATERAL VIEW explode(array(
  named_struct('span_no', 0, 'text', substr(line, 1, 7), 'size', 10.0E0 + CASE WHEN kind <= 1 THEN 2.0E0 ELSE 0.0E0 END + (line_no % 3) * 0.04E0, 'flags', CASE WHEN kind <= 1 THEN 20 ELSE 4 END),
  named_struct('span_no', 1, 'text', substr(line, 8), 'size', 10.0E0 + CASE WHEN kind = 0 THEN 2.0E0 ELSE 0.0E0 END, 'flags', CASE WHEN kind <= 1 OR line_no % 5 = 4 THEN 16 ELSE 0 END))) t AS s
WHERE s.span_no = 0 OR length(line) > 7"""
#: What each table expression reads.
NEEDS = {
    "lines": (), "numbered": (), "pieces": ("lines",), "paragraphs": ("lines",), "figures": ("numbered",), "papers": (), "blocks": ("lines",), "layout_lines": ("blocks", "pieces"), "layout_spans": ("layout_lines",),
    "layout_graphics": ("blocks",), "layout_pages": ("blocks",), "matches": ("figures", "paragraphs"), "sections": ("lines",), "explanations": ("figures",), "paragraph_vectors": ("paragraphs",), "caption_vectors": ("figures",),
    "responses": ("figures", "paragraphs"),
}


@cache
def _ordered(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS[name]:
            add(below)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return tuple(out)


def _body(name: str, dialect: dict[str, str]) -> str:
    if name in dialect:
        return dialect[name]
    body = COMMON[name]
    body = body.replace("%(quoted)s", dialect["quoted"])
    for source in ("documents", "embeddings"):
        body = body.replace(f"%({source})s", dialect["source"] % source)
    return body


def with_sql(*names: str, dialect: dict[str, str] = DUCK) -> str:
    """WITH clause of the named table expressions and what they need."""
    return "WITH " + ",\n".join(f"{n} AS ({_body(n, dialect)})" for n in _ordered(names))


#: Bytes of the documents' files that a task gets (a span is several times its text in a sort), and of an exchange that a later task reads.
PART_BYTES, EXCHANGED_BYTES = 8 << 20, "16m"


def small_tasks(spark: SparkSession) -> None:
    """Bound what tasks read of an exchange, so that they sort in memory at every size, where the session has not set a bound."""
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, EXCHANGED_BYTES)


def _parts(documents: DataFrame) -> int:
    """Parts for the documents: as many as their size asks for, not fewer than there are cores."""
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(documents.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def derived(spark: SparkSession, sf_dir: str, name: str, by_paper: bool = False) -> DataFrame:
    """One derived table as a DataFrame. by_paper: the documents are dealt by their id before anything is made of them, so that all
    that is then grouped or joined within a paper needs no further exchange, and tables that are read together share that one."""
    text = f"{with_sql(name, dialect=SPARK)} SELECT * FROM {name}"
    sources = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in ("documents", "embeddings") if f"{{{s}}}" in text}
    small_tasks(spark)
    if by_paper:
        sources["documents"] = sources["documents"].select("doc_id", "text").repartition(_parts(sources["documents"]), "doc_id")
    text = text.replace("{", "{{").replace("}", "}}")  # braces are literal but around the sources
    for s in sources:
        text = text.replace(f"{{{{{s}}}}}", f"{{{s}}}")
    return spark.sql(text, **sources)
