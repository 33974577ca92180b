"""Benchmark decontamination by a distributed positional inverted index.

Documents are dealt to segments as they are read.  A segment is one row of the
stored index: its documents, and for every term that the test set asks for the
ascending list of places where it stands.  A document's places follow those of
the one before after a gap, so no phrase and no neighbourhood reaches across.

The stored lists tell how often each term occurs.  A window of test words is
answered in every segment from its rarest term on: that term's list less its
offset in the window holds the possible starts, and each further list, by its
own offset, cuts them (exact phrases); or keeps the places that have all other
words of the window within ``reach`` (proximity).  A window whose rarest term
is absent costs one look-up.  Segments are rows, so nothing is shuffled but the
documents' final counts; a segment holds about SEGMENT words, or one document.

The test set is taken in blocks of about BLOCK bytes, each with an index of its
own terms, so what tasks are sent is bounded; documents grow without limit.

Defined results: a null text has no words, nor has a null item; an item without
words has no window; a document shorter than a window has no match; items that
share an id are one item, a null id is written as ``null``; rows of equal or
null document ids stay apart; no items mean that nothing is hit, no documents
give no rows.  Other columns are not looked at.  With several blocks ``docs``
must come in the same order each time they are read, as files do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialise, pieces, read_documents

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a segment, at which the next one begins.
SEGMENT = 1 << 19
#: Free places between documents, more than any ``reach``.
GAP = 64
#: How far the words of a window may stand from its rarest one for a proximity match.
REACH = 14
#: Bytes of test text in a block.
BLOCK = 1 << 24
#: A-Z to a-z, bytes of words (0-9, a-z and all that are not ASCII) to themselves, the rest to a blank.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
HITS = T.StructType([T.StructField("row", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near", T.ArrayType(T.StringType()))])


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return raw.translate(WORD_BYTES).split()


def _postings(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, terms: list[str]) -> tuple[pa.Array, pa.Array]:
    """The terms that occur and their lists of places; ids: of the words of all documents in turn, -1 for none."""
    places = np.arange(len(ids)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    asked = ids >= 0
    ids, places = ids[asked], places[asked]
    order = np.argsort(ids, kind="stable")
    held, first = np.unique(ids[order], return_index=True)
    offsets = np.append(first, len(ids)).astype(np.int32)
    return pa.array([terms[k] for k in held.tolist()], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[order].astype(np.int32)))


def positional_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", terms: frozenset[bytes] | None = None, segment: int = SEGMENT) -> DataFrame:
    """Written segments: ``docs`` (row, id, words, start) and ``terms`` (term, places), all terms unless some are named."""
    kind = docs.schema[id_column].dataType
    document = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("words", T.LongType()), T.StructField("start", T.LongType())])
    posting = T.StructType([T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("docs", T.ArrayType(document)), T.StructField("terms", T.ArrayType(posting))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            known = defaultdict(count().__next__) if terms is None else {t: k for k, t in enumerate(sorted(terms))}
            return known, [], [], []

        def closed() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
            term, places = _postings(np.concatenate(found), starts, lengths, [t.decode() for t in known])
            rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.concat_arrays(ids), pa.array(lengths), pa.array(starts)], ["row", "id", "words", "start"])
            lists = pa.StructArray.from_arrays([term, places], ["term", "places"])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, lists)], ["docs", "terms"])

        known, found, numbers, ids = fresh()
        size = 0
        for batch in pieces(batches):
            look = known.__getitem__ if terms is None else known.get
            for k, raw in enumerate(batch.column(2).to_pylist()):
                words = words_of(raw or b"")
                found.append(np.fromiter(map(look, words) if terms is None else map(look, words, repeat(-1)), np.int32, len(words)))
                numbers.append(batch.column(0)[k].as_py())
                ids.append(batch.column(1).slice(k, 1))
                size += len(words)
                if size >= segment:
                    yield closed()
                    known, found, numbers, ids = fresh()
                    look = known.__getitem__ if terms is None else known.get
                    size = 0
        if found:
            yield closed()

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).cast("binary").alias("raw"))
    return materialise(read.mapInArrow(run, schema), "postings")


def frequencies(index: DataFrame) -> DataFrame:
    """How often each term stands in the documents."""
    return index.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum(F.size("t.places")).alias("n"))


def windows_of(items: list[tuple[str, bytes]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """The ids of the items that hold each window."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for name, raw in items:
        words = words_of(raw)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[k : k + window])].add(name)
    return out


def _within(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which numbers an ascending list holds."""
    at = np.searchsorted(held, asked)
    return held[np.minimum(at, len(held) - 1)] == asked


def phrase_starts(lists: dict[str, np.ndarray], steps: list[tuple[str, int]]) -> np.ndarray:
    """Where all terms stand at their offsets; steps: (term, offset) from the rarest on."""
    first, offset = steps[0]
    starts = lists[first] - offset
    for term, offset in steps[1:]:
        if not len(starts):
            break
        starts = starts[_within(starts + offset, lists[term])] if term in lists else starts[:0]
    return starts


def near_places(lists: dict[str, np.ndarray], steps: list[tuple[str, int]], reach: int) -> np.ndarray:
    """Places of the rarest term that have all other terms within ``reach``."""
    places = lists[steps[0][0]]
    for term in dict.fromkeys(t for t, _ in steps[1:]):
        if not len(places) or term not in lists:
            return places[:0]
        held = lists[term]
        at = np.searchsorted(held, places)
        after, before = held[np.minimum(at, len(held) - 1)] - places, places - held[np.maximum(at - 1, 0)]
        places = places[((after >= 0) & (after <= reach)) | ((before >= 0) & (before <= reach))]
    return places


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def searched(index: DataFrame, plans: list[tuple[list[tuple[str, int]], list[str]]], reach: int) -> DataFrame:
    """For each document with a match: its row, the spans of words in exact matches, and the items matched exactly and by proximity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            docs, terms = batch.column(0).flatten(), batch.column(1).flatten()
            row, start = docs.field("row").to_numpy(), docs.field("start").to_numpy()
            flat, bounds = terms.field("places").flatten().to_numpy(), terms.field("places").offsets.to_numpy()
            base, bounds = bounds[0], bounds.tolist()
            lists = {t: flat[a - base : b - base] for t, a, b in zip(terms.field("term").to_pylist(), bounds, bounds[1:], strict=False)}
            spans, items, near = defaultdict(list), defaultdict(set), defaultdict(set)
            for steps, names in plans:
                if steps[0][0] not in lists:
                    continue
                starts = phrase_starts(lists, steps)
                for at, doc in zip(starts.tolist(), (np.searchsorted(start, starts, side="right") - 1).tolist(), strict=True):
                    spans[doc].append((at - int(start[doc]), at - int(start[doc]) + len(steps)))
                    items[doc].update(names)
                for doc in np.unique(np.searchsorted(start, near_places(lists, steps, reach), side="right") - 1).tolist():
                    near[doc].update(names)
            hit = sorted(near.keys() | items.keys())
            merged = [[{"s": s, "e": e} for s, e in _merged(spans[d])] for d in hit]
            yield pa.RecordBatch.from_arrays([pa.array(row[hit], pa.int64()), pa.array(merged, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), *(pa.array([sorted(x[d]) for d in hit], pa.list_(pa.string())) for x in (items, near))], HITS.names)

    return index.select("docs", "terms").mapInArrow(run, HITS)


def joined_spans(spans: str) -> Column:
    """Ascending spans, those that meet joined."""

    def put(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(x["s"] <= last["e"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, F.array().cast(SPANS), put)


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """The id, ``n_words``, ``spans`` of hit words (in words, end exclusive, apart from each other), ``items`` and ``near`` (ids as text, ascending)."""
    if not window - 1 <= reach < GAP:
        raise ValueError(f"reach lies between {window - 1} and {GAP - 1}")
    asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("raw"))
    blocks = -(-(asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // block) or 1
    told, first = None, None
    for k in range(blocks):
        part = [(r.item, bytes(r.raw)) for r in asked.where(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == k).collect()]  # a block of the test set
        found = windows_of(part, window)
        index = positional_index(docs, id_column, text, frozenset(w for x in found for w in x))
        often = {r.term: r.n for r in frequencies(index).collect()}  # a row for each of the block's terms
        plans = []
        for x, names in found.items():
            steps = sorted(((w.decode(), j) for j, w in enumerate(x)), key=lambda s: (often.get(s[0], 0), s[1]))
            if steps[0][0] in often:
                plans.append((steps, sorted(names)))
        here = searched(index, plans, reach)
        told = here if told is None else told.union(here)
        first = first or index
    if blocks > 1:
        whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        told = told.groupBy("row").agg(whole("spans"), whole("items"), whole("near"))
        told = told.withColumn("spans", joined_spans("spans"))
    listed = first.select(F.explode("docs").alias("d")).select("d.row", F.col("d.id").alias(id_column), F.col("d.words").alias("n_words"))
    empty = lambda c: F.coalesce(c, F.array().cast(HITS[c].dataType)).alias(c)
    return listed.join(told, "row", "left").select(id_column, "n_words", empty("spans"), empty("items"), empty("near"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


OP13_SQL = """
WITH item_words AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
doc_words AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
asked AS (
  SELECT DISTINCT item, ws[k:k + least(len(ws), 10) - 1] AS win, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) u(k) WHERE len(ws) > 0),
held AS (
  SELECT row, k, n, array_to_string(ws[k:k + n - 1], ' ') AS gram
  FROM doc_words, (SELECT DISTINCT n FROM asked), unnest(range(1, len(ws) - n + 2)) u(k)),
matched AS (SELECT row, k, n, item FROM held JOIN asked USING (n, gram)),
hits AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT row, k, n FROM matched), unnest(range(k, k + n)) u(place) GROUP BY row),
often AS (SELECT w, count(*) AS times FROM (SELECT unnest(ws) AS w FROM doc_words) GROUP BY w),
rarest AS (SELECT item, win, win[min_by(j, (coalesce(times, 0), j))] AS w FROM (SELECT item, win, generate_subscripts(win, 1) AS j, unnest(win) AS w FROM asked) LEFT JOIN often USING (w) GROUP BY item, win),
places AS (SELECT row, w, p FROM (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM doc_words) SEMI JOIN rarest USING (w)),
close AS (SELECT row, count(DISTINCT item) AS n_near FROM places JOIN rarest USING (w) JOIN doc_words USING (row) WHERE list_has_all(ws[greatest(p - 14, 1):p + 14], win) GROUP BY row),
names AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM matched) GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc_words LEFT JOIN hits USING (row) LEFT JOIN names USING (row) LEFT JOIN close USING (row)
"""
