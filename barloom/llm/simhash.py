"""SimHash near-duplicates found in BK-trees.

A text's fingerprint has a bit set where over half the 64-bit hashes of its
shingles have it.  Equal fingerprints are one class; classes whose fingerprints
differ in at most ``radius`` bits are linked.

Fingerprints within the radius agree on at least 4 - radius of four 16-bit
blocks, so every class goes to the shards named by each pair of blocks and its
values: two classes within two bits meet in one of the six.  A shard is a
BK-tree, children keyed by their Hamming distance from the parent, and its
classes are searched in it along the edges within the radius only.  Trees
travel to the tasks that search them by shuffle, never through the driver.  A
shard of over ``TREE`` classes is split into several trees, each of which is
sent all of the shard's queries.  What a task reports is a spanning forest of
the links it found, at most one edge a class, so a group of near copies makes a
linear number of rows.  The forests are joined by smallest-label propagation
with pointer jumping; joins and minima there are combined or split by Spark
where one label holds much of the rows.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows share a class; equal ids with different texts each
have a row and the smallest id of all they reach; a null id never names a
component unless all its members are null; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialise, read_documents, whole_text

SEED = 42
RADIUS = 2
TREE = 20_000  # classes in a tree
GATHER = 100_000  # rows of whole shards that a task searches at once
SEARCH = 512  # queries that descend together
FRONTIER = 4_000_000  # pairs of a query and a node held at once
BLOCK = 16
BLOCK_PAIRS = list(combinations(range(4), 2))


def shingle_hashes(raw: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The 64-bit hash of each shingle of the A-Z lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in pairs], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The id, a hash of the text (``text_hash``) and the fingerprint as a signed long (``fp``)."""
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority_bits(shingle_hashes(raw, words)) for raw in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], schema.names)

    return docs.select(F.col(id_column), F.xxhash64(whole_text(text)).alias("text_hash"), whole_text(text).cast("binary").alias("raw")).mapInArrow(run, schema)


class BkForest:
    """One BK-tree for each shard; the first of a shard's values is its root."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard: small integers, ascending; value: uint64, different within a shard."""
        n = len(value)
        self.value = value
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root[shard[first]] = np.flatnonzero(first)
        loose, parent = np.flatnonzero(~first), self.root[shard][~first]
        edges, nodes = [], []
        while len(loose):
            key = parent * 65 + np.bitwise_count(value[loose] ^ value[parent])
            keys, at, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append(keys)
            nodes.append(loose[at])
            stays = np.ones(len(loose), bool)
            stays[at] = False
            loose, parent = loose[stays], loose[at][back][stays]
        edge, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, nodes))
        order = np.argsort(edge)
        self.edge, self.node = edge[order], node[order]  # edge: parent * 65 + distance, each names one child

    def search(self, shard: np.ndarray, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's and a node's index whose distance is within the radius."""
        for k in range(0, len(query), SEARCH):
            asked = np.arange(k, min(k + SEARCH, len(query)))
            at = self.root[shard[asked]]
            waiting = [(asked[at >= 0], at[at >= 0])]
            while waiting:
                q, node = waiting.pop()
                distance = np.bitwise_count(query[q] ^ self.value[node]).astype(np.int64)
                near = distance <= radius
                yield q[near], node[near]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), side="right")
                found = high - low
                reach = np.cumsum(found)
                if not len(reach) or not reach[-1]:
                    continue
                for cut in np.split(np.arange(len(q)), np.searchsorted(reach, np.arange(FRONTIER, reach[-1], FRONTIER))):
                    times = found[cut]
                    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    if len(within):
                        waiting.append((np.repeat(q[cut], times), self.node[np.repeat(low[cut], times) + within]))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index labels after linking a[i] and b[i]; labels[labels] == labels before and after."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def search_shards(shard: np.ndarray, value: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each shard: pairs of values.

    shard: ascending; value: uint64; member: whether the row is in the tree (all rows ask).
    """
    inside = np.flatnonzero(member)
    forest = BkForest(shard[inside], value[inside])
    if len(forest.root) < (shard[-1] + 1 if len(shard) else 0):
        forest.root = np.concatenate([forest.root, np.full(int(shard[-1]) + 1 - len(forest.root), -1)])
    labels = np.arange(len(value))
    for q, node in forest.search(shard, value, radius):
        labels = join_labels(labels, q, inside[node])
    linked = np.flatnonzero(labels != np.arange(len(value)))
    return value[linked], value[labels[linked]]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp``: a spanning forest of each shard's links."""
    if radius > RADIUS:
        raise ValueError(f"pairs of four blocks find differences of at most {RADIUS} bits")
    block = [F.shiftrightunsigned("fp", BLOCK * (3 - k)).bitwiseAND((1 << BLOCK) - 1) for k in range(4)]
    names = [F.lit(k << 2 * BLOCK).bitwiseOR(F.shiftleft(block[i], BLOCK)).bitwiseOR(block[j]) for k, (i, j) in enumerate(BLOCK_PAIRS)]
    sent = classes.select("fp", F.explode(F.array(*names)).alias("shard"))
    sizes = sent.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("trees", F.ceil(F.col("n") / TREE).cast("int"))
    sent = sent.join(sizes.select("shard", "trees"), "shard")
    own = F.pmod(F.xxhash64("fp", F.lit("tree")), F.col("trees")).cast("int")
    sent = sent.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).select("shard", "tree", "fp", (own == F.col("tree")).alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            name, tree, fp, member = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.concatenate([[False], (name[1:] != name[:-1]) | (tree[1:] != tree[:-1])])
            a, b = search_shards(np.cumsum(new), fp.view(np.uint64), member, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(new[0]):
                continue
            held.append(new)
            rows += len(new[0])
            if rows >= GATHER:
                last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
                if len(last):  # the last shard may go on in the next batch
                    cut = last[-1] + 1
                    yield found([*held[:-1], tuple(x[:cut] for x in new)])
                    held = [tuple(x[cut:] for x in new)]
                    rows = len(held[0][0])
        if held:
            yield found(held)

    return sent.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge: label is the smallest node of its component."""
    ways = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    ways = materialise(ways, "links")
    labels = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = materialise(labels, "labels")
    while True:
        told = ways.join(labels, ways.a == labels.node).select(F.col("b").alias("node"), "label")
        lower = told.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(ahead, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        before = labels.withColumnRenamed("label", "was")
        new = materialise(jumped.join(before, "node").select("node", "label", (F.col("label") < F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The id, ``text_hash``, ``fp``, ``component`` and ``component_id`` of every row.

    ``component`` is the smallest fingerprint reachable by links and
    ``component_id`` the smallest id, its own included.
    """
    prints = materialise(fingerprints(docs, id_column, text, words), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min(id_column).alias("low")), "classes")
    labels = components(materialise(links(classes, radius), "edges"))
    placed = classes.join(labels, classes.fp == labels.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = materialise(placed.join(named, "component").select("fp", "component", "component_id"), "components")
    return prints.join(classes, "fp").select(id_column, "text_hash", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (null ids last; of repeated rows one)."""
    found = near_duplicates(docs, id_column, text, **options)
    first = F.min(F.struct(F.col(id_column).isNull(), F.col(id_column).alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    name = lambda i: F.coalesce(F.col(i).cast("string"), F.lit("null"))
    stays = found.groupBy("component").agg(first).select(name("first.id").alias("__id"), F.col("first.hash").alias("__hash"))
    keyed = docs.withColumns({"__id": name(id_column), "__hash": F.xxhash64(whole_text(text))}).join(stays.distinct(), ["__id", "__hash"])
    turn = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id", "__hash"))
    return keyed.withColumn("__turn", turn).filter("__turn = 1").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
