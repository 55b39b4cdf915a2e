"""Operator 12: Merkle manifest of a dataset as a content-addressed DAG, and proofs by descent.

Rows are leaves, three consecutive nodes have a parent, each source is a tree and the trees' roots are the leaves of one more tree.
The manifest stores digest -> children records, packed to pages: a page has the records of up to four levels and
is addressed by the digest of its top node. A request for a leaf descends from the root by the base-3 digits of the leaf's rank,
one page after another, and collects the children that it does not go to; read backwards, these are the leaf's proof.
Requests with a page in common reach it as one row, so no page is met by more rows than it has children.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, spread_if_few, table

FANOUT, LEVELS = 3, 4
#: Leaves of a page.
PAGE = FANOUT**LEVELS
#: Pages that a task turns into Python objects at a time.
SLICE = 100
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENTS = "array<struct<digit: int, others: array<string>>>"
RECORDS = "array<struct<digest: string, children: array<string>>>"


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and its text, a null as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def folded(node: str, segments: list[dict]) -> str:
    """The root above a leaf whose proof, from the leaf upwards, is segments."""
    for s in segments:
        node = parent([*s["others"][: s["digit"]], node, *s["others"][s["digit"] :]])
    return node


def page_records(nodes: list[str], whole: bool, levels: int = LEVELS) -> tuple[str, list[dict]]:
    """Top digest and digest -> children records over a page's nodes; a whole tree ends at its first lone node, a part of one has all levels."""
    records: dict[str, list[str]] = {}
    for _ in range(levels):
        if whole and len(nodes) == 1:
            break
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        nodes = [parent(r) for r in runs]
        records |= zip(nodes, runs)
    return nodes[0], [{"digest": d, "children": c} for d, c in records.items()]


def descended(records: dict[str, list[str]], node: str, height: int, rank: int) -> tuple[str, list[dict]]:
    """From a page's top to its leaf of that rank: the leaf's digest and what was passed by, from the top downwards."""
    passed = []
    for level in reversed(range(height)):
        children, digit = records[node], rank // FANOUT**level % FANOUT
        passed.append({"digit": digit, "others": children[:digit] + children[digit + 1 :]})
        node = children[digit]
    return node, passed


@dataclass
class Manifest:
    """tops(tree, n, digest): each tree's leaf count and root. records(digest, records): the pages of all trees, each content once. rounds: pages on the longest way."""

    tops: DataFrame
    records: DataFrame
    rounds: int


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with rank (gapless from 0 in each tree, by order) and n (the tree's rows). tree has no nulls.

    Rows are dealt by ranges of (tree, order) and numbered in each range; only counts of (tree, range) are summed up in windows,
    so a tree of any size is ranked by many tasks.
    """
    # pos keeps rows that are equal in all else apart, so that ranges can cut between them
    kept = materialize(rows.withColumn("_pos", F.monotonically_increasing_id()))
    placed = materialize(kept.orderBy(tree, *order, "_pos").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_pos"))
    runs = placed.groupBy(tree, "_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    whole = W.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(tree, "_part", "_first", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"), F.sum("_held").over(whole).alias("n"))
    return placed.join(spread_if_few(materialize(runs)), [tree, "_part"]).withColumn("rank", F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_base", "_first")


def _pages(nodes: DataFrame) -> DataFrame:
    """(tree, rank, n, digest, records): one level of pages over (tree, rank, n, digest), as nodes of the next level."""
    own = nodes.groupBy("tree", "n", F.floor(F.col("rank") / PAGE).alias("rank")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("own"))

    leaves, levels = PAGE, LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = part.column(1).to_pylist()
                made = [page_records(own, k <= leaves, levels) for own, k in zip(part.column(3).to_pylist(), n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([-(-k // leaves) for k in n], pa.int64()), pa.array([d for d, _ in made], pa.string()), pa.array([r for _, r in made], pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))],
                    ["tree", "rank", "n", "digest", "records"],
                )

    return own.mapInArrow(run, f"tree string, rank long, n long, digest string, records {RECORDS}")


def build(leaves: DataFrame) -> Manifest:
    """Manifest of leaves(tree, rank, n, digest) as ranked() numbers them. A tree of one leaf has that leaf as its root and no records."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, tops, records, rounds = leaves, leaves.where("n = 1").select("tree", F.lit(1).cast("long").alias("n"), "digest"), None, 0
    sizes = None
    while most > 1:
        pages = materialize(_pages(nodes.where("n > 1").select("tree", "rank", "n", "digest")))
        sizes = sizes or leaves.where("rank = 0").select("tree", "n")
        tops = tops.union(pages.where("n = 1").select("tree", "digest").join(sizes, "tree").select("tree", "n", "digest"))
        own = pages.select("digest", "records")
        records, nodes, most, rounds = own if records is None else records.union(own), pages, -(-most // PAGE), rounds + 1
    if records is None:
        records = leaves.sparkSession.createDataFrame([], f"digest string, records {RECORDS}")
    return Manifest(materialize(tops), materialize(records.groupBy("digest").agg(F.first("records").alias("records"))), rounds)


def _walked(met: DataFrame, payload: str, below: int) -> DataFrame:
    """Rows (tree, n, top, digest, path, page, wanted, records) -> what each wanted child of the page is reached by. below: rounds under the page."""
    names = ["tree", "n", "top", "digest", "path", "rank", "own"]
    leaves, levels = PAGE, LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            if kinds is None:
                wanted = batch.schema.field("wanted").type.value_type
                passed = batch.schema.field("path").type
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), passed, pa.int64(), wanted.field("own").type]
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for page in batch.slice(at, SLICE).to_pylist():
                    left = -(-page["n"] // leaves**below)
                    height = next((h for h in range(levels) if FANOUT**h >= left), levels)
                    records = {r["digest"]: r["children"] for r in page["records"]}
                    for want in page["wanted"]:
                        node, passed_by = descended(records, page["digest"], height, want["at"])
                        rows.append((page["tree"], page["n"], page["top"], node, page["path"] + passed_by, page["page"] * leaves + want["at"], want["own"]))
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    fields = dict(zip(names, ("string", "long", "string", "string", SEGMENTS, "long", payload)))
    return met.select("tree", "n", "top", "digest", "path", "page", "wanted", "records").mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in names))


def proofs(manifest: Manifest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """(tree, n, top, digest, path, rank, own) for each of requests(tree, rank, n, own struct): the tree's root, the leaf's digest as the
    descent finds it, and the way to it, from the root downwards. A tree's requests are distinct ranks.

    starts(tree, n, digest, path): where each tree's descent begins, and the way that led there.
    """
    payload = requests.schema["own"].dataType.simpleString()
    frontier, starts = None, starts.select("tree", "n", F.col("digest").alias("top"), "digest", "path")
    for t in reversed(range(manifest.rounds)):
        begin = starts.where((F.col("n") > PAGE**t) & (F.col("n") <= PAGE ** (t + 1))).select(*starts.columns, F.lit(0).cast("long").alias("page"))
        frontier = begin if frontier is None else begin.unionByName(frontier.select(*starts.columns, F.col("rank").alias("page")))
        asked = requests.where("n > 1").withColumn("child", F.floor(F.col("rank") / PAGE**t))
        if t:
            asked = asked.select("tree", "child").distinct().withColumn("own", F.lit(0))
        wanted = asked.groupBy("tree", F.floor(F.col("child") / PAGE).alias("page")).agg(F.collect_list(F.struct((F.col("child") % PAGE).alias("at"), "own")).alias("wanted"))
        met = frontier.join(wanted, ["tree", "page"]).join(manifest.records, "digest")
        frontier = materialize(_walked(met, "int", t)) if t else _walked(met, payload, t)
    lone = requests.where("n = 1").join(starts.where("n = 1").drop("n"), "tree").select(*starts.columns, "rank", "own")
    return lone if frontier is None else frontier.unionByName(lone)


def digests(docs: DataFrame, tampered: Column, id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, source_col: str = "source") -> DataFrame:
    """(id, source, leaf, changed): leaf digests of fields; changed is that of a row with the text `tampered`, null if the text is the same.
    A null is told from an empty text. Other columns are not read."""
    columns = [F.col(f) for f in fields]
    other = [tampered if f == "text" else F.col(f) for f in fields]
    changed = F.when(tampered.isNotNull() & ~tampered.eqNullSafe(F.col("text")), leaf_digest(other))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_digest(columns).alias("leaf"), changed.alias("changed"))


def with_proofs(rows: DataFrame) -> DataFrame:
    """rows(id, source, leaf, changed) -> (id, source, leaf, changed, subroot, root, path): path is the proof from the leaf upwards.

    Leaves of a source ascend by id (null first), equal ids by their digest; sources are ordered by their bytes, null first. Each row
    is a leaf of its own, equal ones too. An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree")
    leaves = materialize(ranked(rows.select(tree, "id", "source", F.col("leaf").alias("digest"), "changed"), "tree", ["id", "digest"]))
    sources = build(leaves)
    subroots = materialize(ranked(sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest"), "tree", ["name"]))
    top = build(subroots)
    asked = subroots.select("tree", "rank", "n", F.struct("name", F.col("size").alias("size")).alias("own"))
    ways = materialize(proofs(top, top.tops.withColumn("path", F.array().cast(SEGMENTS)), asked))
    starts = ways.select(F.col("own.name").alias("tree"), F.col("own.size").alias("n"), "digest", "path")
    root = top.tops.first()  # one row: the root of all
    asked = leaves.select("tree", "rank", "n", F.struct("id", "source", "changed").alias("own"))
    found = proofs(sources, starts, asked)
    met = found.select("own.*", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.reverse("path").alias("path"))
    return met.withColumn("root", F.lit(root["digest"] if root else None).cast("string")).select("id", "source", "leaf", "changed", "subroot", "root", "path")


def checked(rows: DataFrame) -> DataFrame:
    """rows of with_proofs() with proof_sha256 (of the siblings' digests in order) and folded_root (from the changed leaf, if there is one, and the proof)."""

    def up(node: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.array_join(F.slice(s["others"], 1, s["digit"]), ""), node, F.array_join(F.slice(s["others"], s["digit"] + 1, FANOUT), "")), 256)

    proof = F.sha2(F.array_join(F.flatten(F.transform("path", lambda s: s["others"])), ""), 256)
    return rows.withColumn("proof_sha256", proof).withColumn("folded_root", F.aggregate("path", F.coalesce("changed", "leaf"), up)).drop("path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = checked(with_proofs(digests(table(spark, sf_dir, "documents"), tampered)))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_H = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
src AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 2 = 0 AS even FROM documents, poly),
leaves AS (
  SELECT row_number() OVER () AS id, coalesce('=' || source, '') AS tree, doc_id, sha256({" || ".join(_H.format(f) for f in FIELDS)}) AS leaf,
    sha256({" || ".join(_H.format("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END" if f == "text" else f) for f in FIELDS)}) AS given FROM src),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, rank AS idx, n, leaf AS digest FROM ranked
  UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 3, n),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (
  SELECT 0 AS level, rank AS idx, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (
  SELECT r.id, r.given, u.level AS step, u.idx, (r.rank // CAST(pow(3, u.level) AS BIGINT)) AS here, u.digest FROM ranked AS r JOIN up AS u ON r.tree = u.tree AND u.n > 1 AND u.idx // 3 = r.rank // CAST(pow(3, u.level + 1) AS BIGINT)
  UNION ALL SELECT r.id, r.given, 100 + a.level, a.idx, s.rank // CAST(pow(3, a.level) AS BIGINT), a.digest FROM ranked AS r JOIN subroots AS s ON r.tree = s.tree JOIN above AS a ON a.n > 1 AND a.idx // 3 = s.rank // CAST(pow(3, a.level + 1) AS BIGINT)),
ways AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY step) AS k, count(*) OVER (PARTITION BY id) AS k_n, l, r FROM (
  SELECT id, step, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < here), '') AS l, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > here), '') AS r FROM steps GROUP BY id, step)),
fold AS (
  SELECT id, 0 AS k, given AS node FROM ranked
  UNION ALL SELECT f.id, f.k + 1, sha256(w.l || f.node || w.r) FROM fold AS f JOIN ways AS w ON w.id = f.id AND w.k = f.k + 1),
proof AS (SELECT r.id, sha256(coalesce(string_agg(w.l || w.r, '' ORDER BY w.k), '')) AS proof_sha256 FROM ranked AS r LEFT JOIN ways AS w ON w.id = r.id GROUP BY 1),
last AS (SELECT id, arg_max(node, k) AS folded_root FROM fold GROUP BY 1)
SELECT doc_id, leaf, subroot, a.digest AS root, proof_sha256, folded_root, folded_root = a.digest AS verified
FROM ranked AS r JOIN subroots AS s ON r.tree = s.tree JOIN proof AS p ON p.id = r.id JOIN last AS l ON l.id = r.id JOIN above AS a ON a.n = 1""",
}
