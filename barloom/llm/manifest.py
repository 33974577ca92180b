"""Merkle manifest of a dataset: a digest for every row, a root for every source and for all, and proofs.

The leaves of a source are numbered by a range sort, prefix sums of the ranges'
counts and the place within a range; no source needs one task.  The number of a
leaf divided by fanout^k names its superblock.  A superblock's k levels collapse
in one task (``applyInPandas``) to one node; the nodes are numbered by their
superblocks, so the same step reduces them again, until one node a source is
left.  The sources' nodes form the leaves of one more such tree.  Proofs are put
together on the way down: a task that knows a superblock's own levels and the
proof of its node appends the one to the other.

A proof is an array of texts, one a level from leaf to root: the digests of the
run's other nodes, left to right.  ``places`` tells where in each run the node
itself stands, so that :func:`folded` needs nothing else.

Defined results: a null field is ``-`` in its leaf; a null source is a tree of
its own and comes first; null ids come first, rows of equal ids stand by their
leaves, equal leaves as they were read (their digests are the same in any
order); a lone leaf is its source's node, a lone source's node the root, and its
proof there is empty; no rows give no rows.  Columns that are not asked for are
not looked at.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialise, read_documents

FANOUT = 16
#: Levels that one task collapses: a superblock has at most FANOUT ** LEVELS nodes.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 64
#: Every so many-th row, by the checksum of its id, is tampered with in the query.
TAMPERED = 5

NODE = T.StructType([T.StructField("tree", T.StringType()), T.StructField("index", T.LongType()), T.StructField("width", T.LongType()), T.StructField("node", T.StringType())])
PROOF = T.StructType([T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def folded(node: Column, proof: Column, places: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(below: Column, level: Column) -> Column:
        others, at = level["others"], level["place"] * DIGITS
        return F.sha2(F.concat(F.substr(others, F.lit(1), at), below, F.substr(others, at + 1)), 256)

    return F.aggregate(F.zip_with(proof, places, lambda others, place: F.struct(others.alias("others"), place.alias("place"))), node, up)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with each one's ``index`` within its ``tree`` and the tree's ``width``.

    Written before they are ranged, since a range sort reads twice (for its
    bounds and for itself) and these are narrow; then written in ranges of tree
    and order.  The counts of the ranges, a row for each and for each tree, are
    all that is summed.  A tree may be split anywhere, between equal rows too,
    since their places in the input order them.
    """
    order = ["tree", *order, "__read"]
    rows = materialise(rows.withColumn("__read", F.monotonically_increasing_id()), name)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__read")
    ranged = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), name)
    tree = Window.partitionBy("tree")
    counts = ranged.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "__part", (before - F.col("__first")).alias("__offset"), F.sum("__n").over(tree).alias("width"))
    return ranged.join(offsets, ["tree", "__part"]).withColumn("index", F.col("__at") + F.col("__offset")).drop("__at", "__part", "__offset")


def _levels(nodes: list[str], width: int, levels: int, fanout: int) -> list[list[str]]:
    """The nodes of a superblock by level, from its own up; a tree of ``width`` nodes ends at one."""
    out = [nodes]
    for _ in range(levels):
        if width == 1:
            break
        nodes = [digest("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        width = -(-width // fanout)
        out.append(nodes)
    return out


def reduced(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """A node for each superblock, numbered by it."""
    size = fanout**levels

    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        width, first = int(block["width"].iloc[0]), int(block["index"].min())
        root = _levels(block.sort_values("index")["node"].tolist(), width, levels, fanout)[-1][0]
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "index": first // size, "width": -(-width // size), "node": root})

    return nodes.select("tree", "index", "width", "node").groupBy("tree", F.expr(f"index div {size}")).applyInPandas(collapse, NODE)


def towers(leaves: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """The leaves, their superblocks' nodes, the nodes of those, and so on to one node a tree."""
    out = [leaves]
    widest = leaves.agg(F.max("width")).first()[0] or 0
    while len(out) == 1 or widest > 1:
        out.append(materialise(reduced(out[-1], levels, fanout), "nodes"))
        widest = -(-widest // fanout**levels)
    return out


def _appended(levels: int, fanout: int, carried: tuple[str, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def append(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        nodes, width = block["node"].to_pylist(), block["width"][0].as_py()
        upper = {c: above[c][0].as_py() for c in PROOF.names}
        lower, places = [], []
        for own in _levels(nodes, width, levels, fanout)[:-1]:
            runs = ((own[k - k % fanout : k], own[k + 1 : k - k % fanout + fanout]) for k in range(len(own)))
            lower.append(["".join(left + right) for left, right in runs])
            places.append([k % fanout for k in range(len(own))])
        at = range(len(nodes))
        proofs = [[level[k // fanout**j] for j, level in enumerate(lower)] + upper["proof"] for k in at]
        stands = [[level[k // fanout**j] for j, level in enumerate(places)] + upper["places"] for k in at]
        ends = [pa.array([upper[c]] * len(nodes), pa.string()) for c in ("subroot", "root")]
        kept = [block[c] for c in ("tree", "index", "node", *carried)]
        return pa.Table.from_arrays([*kept, pa.array(proofs, pa.list_(pa.string())), pa.array(stands, pa.list_(pa.int32())), *ends], names=["tree", "index", "node", *carried, *PROOF.names])

    return append


def with_proofs(tower: list[DataFrame], above: DataFrame, carried: tuple[str, ...], levels: int, fanout: int) -> DataFrame:
    """The tower's leaves with proofs; ``above`` holds those of its single nodes (tree, index, and PROOF's columns)."""
    size = fanout**levels
    for k in range(len(tower) - 2, -1, -1):
        more = carried if k == 0 else ()
        nodes = tower[k].select("tree", "index", "width", "node", *more)
        schema = T.StructType([f for f in nodes.schema.fields if f.name != "width"] + PROOF.fields)
        blocks = nodes.groupBy("tree", F.expr(f"index div {size}"))
        above = blocks.cogroup(above.select("tree", "index", *PROOF.names).groupBy("tree", "index")).applyInArrow(_appended(levels, fanout, more), schema)
    return above


def manifest(rows: DataFrame, id_column: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, carried: tuple[str, ...] = (), levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """The id, ``leaf``, ``proof``, ``places``, the source's ``subroot``, ``root``, and the columns to be carried.

    A row's text is read once, for its leaf; what is written and shuffled after
    that is the digests, and proofs are made where they are returned.
    """
    own = {f"__c{k}": c for k, c in enumerate(carried)}
    leaves = rows.select(F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("tree"), F.col(id_column).alias("__id"), leaf(F.col(f) for f in fields).alias("node"), *(F.col(c).alias(n) for n, c in own.items()))
    tower = towers(numbered(leaves, ["__id", "node"], "leaves"), levels, fanout)
    sources = tower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("__id"), "node")
    upper = towers(numbered(sources, ["__id", "node"], "sources"), levels, fanout)
    none = F.array().cast
    top = upper[-1].select("tree", "index", none("array<string>").alias("proof"), none("array<int>").alias("places"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    above = with_proofs(upper, top, ("__id",), levels, fanout)
    above = above.select(F.col("__id").alias("tree"), F.lit(0).cast("long").alias("index"), "proof", "places", F.col("node").alias("subroot"), "root")
    found = with_proofs(tower, above, ("__id", *own), levels, fanout)
    return found.select(F.col("__id").alias(id_column), F.col("node").alias("leaf"), "proof", "places", "subroot", "root", *(F.col(n).alias(c) for n, c in own.items()))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; some are tampered with, and their proofs then fail unless the text has no capitals."""
    docs = read_documents(spark, sf_dir).select(*FIELDS)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("text").isNotNull()
    changed = F.when(hit, leaf(lower if f == "text" else F.col(f) for f in FIELDS))
    found = manifest(docs.withColumn("changed", changed), carried=("changed",))
    root = folded(F.coalesce("changed", "leaf"), F.col("proof"), F.col("places"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE bits AS (  -- the table of the checksum's bytes, by its rule
  SELECT list(entry ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS entry
    FROM range(256) r(b))),
given AS (
  SELECT row_number() OVER () AS row, documents.*, CASE WHEN doc_id IS NULL THEN 1 ELSE
    xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c // 256, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 5 END AS hit
  FROM documents, bits),
leaves AS (
  SELECT row, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text)::VARCHAR || ':' || CASE WHEN hit = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS held
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM given)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM leaves),
low AS (
  SELECT 0 AS level, source, i, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, source, i // 16, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS width FROM low) WHERE width > 1 GROUP BY level, source, i // 16),
subroots AS (SELECT source, level AS height, node AS subroot FROM low QUALIFY row_number() OVER (PARTITION BY source ORDER BY level DESC) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM subroots),
high AS (
  SELECT 0 AS level, i, subroot AS node FROM ranked
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS width FROM high) WHERE width > 1 GROUP BY level, i // 16),
total AS (SELECT node AS root, level AS height FROM high ORDER BY level DESC LIMIT 1),
low_runs AS (SELECT level, source, i // 16 AS run, list(node ORDER BY i) AS nodes FROM low GROUP BY ALL),
high_runs AS (SELECT level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM high GROUP BY ALL),
steps AS (
  SELECT p.row, k AS step, nodes, (p.i // (16 ** k)::BIGINT) % 16 AS place
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source, unnest(range(s.height)) u(k)
  JOIN low_runs r ON r.source IS NOT DISTINCT FROM p.source AND r.level = k AND r.run = p.i // (16 ** (k + 1))::BIGINT
  UNION ALL
  SELECT p.row, q.height + k, nodes, (q.i // (16 ** k)::BIGINT) % 16
  FROM placed p JOIN ranked q ON p.source IS NOT DISTINCT FROM q.source, total, unnest(range(total.height)) u(k)
  JOIN high_runs r ON r.level = k AND r.run = q.i // (16 ** (k + 1))::BIGINT),
sides AS (SELECT row, step, list_aggregate(nodes[1:place] || [''], 'string_agg', '') AS lhs, list_aggregate(nodes[place + 2:len(nodes)] || [''], 'string_agg', '') AS rhs FROM steps),
fold AS (
  SELECT row, 0 AS step, held AS node FROM placed
  UNION ALL
  SELECT fold.row, fold.step + 1, sha256(lhs || node || rhs) FROM fold JOIN sides USING (row, step)),
ends AS (SELECT row, arg_max(node, step) AS folded_root FROM fold GROUP BY row),
proofs AS (SELECT row, string_agg(lhs || rhs, '' ORDER BY step) AS proof FROM sides GROUP BY row)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots s ON placed.source IS NOT DISTINCT FROM s.source JOIN ends USING (row) LEFT JOIN proofs USING (row), total
"""
