"""Substring dedup: repeated passages found by FM-indexes over content shards.

A window is ``window`` consecutive words.  A window that also starts earlier
(by id, then position) is repeated, and its words go.

Windows are routed by content: the smallest hash among a window's six-word
grams is its anchor, and a segment is a run of windows with one anchor, so equal
windows meet wherever their anchors meet.  Anchors that occur once in the corpus,
in a segment that does not repeat a gram, cannot hold a repeated window; only the
segments of the others are sent on, and equal segments are one class whose earliest occurrence stands for it (all
windows of the later ones are repeated).

A shard gathers the classes of its anchors.  It builds an FM-index of their
words (suffixes in order of at least a window's words, BWT in a wavelet matrix of packed bits) and streams the classes through it: backward search extends every window to the
left as long as its interval holds more than one suffix, and a window whose
interval still does at full length is repeated unless it is the earliest of its
interval.  The search compares words themselves; hashes route, and two 64-bit
ones tell which segments are equal and hence one class.  Anchors with more
classes than ``CLASSES`` (the edges of a passage that very many texts share) are
dealt by whole windows instead; the occurrences of one window still meet in one
shard.

Defined results: ids are integers, or texts of such; a null text has no words; null ids count as smaller than all
others; rows that share an id are ordered by a hash of their text, and rows
that share both are one document and get one result; an empty table gives an
empty result; other columns pass through unless their names begin with ``__``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import discard, materialise, read_documents, release, whole_text

WINDOW = 20
GRAM = 6
CLASSES = 2048  # classes of an anchor that are dealt together; of more, windows are dealt
DEAL = 512  # classes whose windows make a deal, on average
BROADCAST = 100_000  # crowded anchors (16 bytes each) that are broadcast; more are joined by shuffle
CHUNK = 250_000  # words of whole shards in an index
OUTPUT = 8_000_000  # bytes of texts whose segments a task holds at once
_R = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    g = np.zeros(n, np.uint64)
    for j in range(size):
        g = g * _R + words[j : j + n]
    g ^= g >> np.uint64(31)
    g *= _M
    return g ^ (g >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run of windows with one anchor."""
    return _runs(words, window)[:3]


def _runs(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """:func:`segments`, and which of them may hold one window twice."""
    from xxhash import xxh64_intdigest

    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    gram = min(GRAM, window)
    width = window - gram + 1
    grams = _gram_hashes(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), gram)
    anchor = _sliding_min(grams, width)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, len(anchor)))
    twice = count > width  # the anchor's gram stands at two places at least
    near = np.zeros(len(grams) + 1, np.int64)
    for p in range(1, min(width, len(grams))):
        near[1 : 1 + len(grams) - p] |= grams[p:] == grams[:-p]
    if near.any():
        seen = np.cumsum(near)
        twice = twice | (seen[start + count + width - 1] > seen[start])
    return anchor[start].view(np.int64), start, count, twice


class WaveletMatrix:
    """A sequence of small integers as one bit vector a digit, packed in 64-bit words with counts before each word."""

    def __init__(self, sequence: np.ndarray, digits: int):
        self.digits = digits
        self.bits, self.before, self.zeros = [], [], []
        for d in reversed(range(digits)):
            bit = (sequence >> d) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def moved(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up when its prefix keeps only ``symbol``: the rank plus the symbol's start."""
        for k, d in enumerate(reversed(range(self.digits))):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> d) & 1, ones + self.zeros[k], at - ones)
        return at


class FmIndex:
    """Backward search over a text of words numbered from 1 (0 separates), for patterns up to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.text = text
        rank, reach = text.astype(np.int64), 1
        while reach < depth:  # prefix doubling: order by the first ``reach`` words
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
            reach *= 2
        self.suffix = np.argsort(rank, kind="stable")
        symbols = int(text.max()) + 1 if n else 1
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(text[self.suffix - 1], max(1, (symbols - 1).bit_length()))
        self.origin = self.tree.moved(np.arange(symbols), np.zeros(symbols, np.int64))

    def repeated(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into start, low, high) of the patterns text[start : start + length] that occur more than once, with their intervals of the suffix order."""
        which = np.arange(len(start))
        symbol = self.text[start + length - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(length - 2, -1, -1):
            many = high - low > 1
            which, low, high = which[many], low[many], high[many]
            if not len(which):
                break
            symbol = self.text[start[which] + k]
            shift = self.first[symbol] - self.origin[symbol]
            low, high = self.tree.moved(symbol, low) + shift, self.tree.moved(symbol, high) + shift
        many = high - low > 1
        return which[many], low[many], high[many]


def repeated_windows(texts: list[list[bytes]], ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the windows that another text or an earlier place of the list's order has too.

    The order is by ids, hashes and then the place in the document, which is the
    text's start plus the window's place in the text.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    number: dict[bytes, int] = {}
    flat = np.zeros(int((lengths + 1).sum()), np.int64)
    heads = np.cumsum(lengths + 1) - (lengths + 1)
    for head, words in zip(heads.tolist(), texts, strict=True):
        flat[head : head + len(words)] = [number.setdefault(w, len(number) + 1) for w in words]
    windows = np.maximum(lengths - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(text):
        return text, place
    index = FmIndex(flat, window)
    which, low, high = index.repeated(heads[text] + place, window)
    if not len(which):
        return which, which
    order = np.empty(len(text), np.int64)
    keys = (starts[text] + place, hashes[text], ids[text])
    ranked = np.lexsort(keys)
    new = np.concatenate([[False], np.any([k[ranked][1:] != k[ranked][:-1] for k in keys], axis=0)])
    order[ranked] = np.cumsum(new)
    at = np.full(len(flat) + 1, len(text), np.int64)
    at[heads[text] + place] = order
    by_suffix = np.append(at[index.suffix], len(text))
    lows, back = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[back] = high
    earliest = np.minimum.reduceat(by_suffix, np.stack([lows, highs], 1).ravel())[::2]
    again = which[order[which] > earliest[back]]
    return text[again], place[again]


def _ranges(text: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows as (text, first word, end word)."""
    if not len(text):
        return text, text, text
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)]))
    last = np.append(new[1:], len(text)) - 1
    return text[new], place[new], place[last] + window


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(id, text_hash, anchors): one for each segment, and once more where it may hold a window twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(2).to_pylist():
                anchor, _, _, twice = _runs(raw.split(), window)
                found.append(np.concatenate([anchor, anchor[twice]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "text_hash", "anchors"])

    return docs.mapInArrow(run, "id long, text_hash long, anchors array<long>").filter(F.size("anchors") > 0)


def _segments(flagged: DataFrame, window: int) -> DataFrame:
    """(anchor, id, text_hash, start, words) of the segments whose anchor is in ``anchors``."""

    names = ["anchor", "id", "text_hash", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary() if c == "words" else pa.int64()) for c, x in zip(names, columns, strict=True)], names)

        for batch in batches:
            rows, size, lists = [], 0, batch.column(3)
            for k, (i, h, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                words = raw.split()
                anchor, start, count = segments(words, window)
                wanted = np.isin(anchor, lists[k].values.to_numpy(zero_copy_only=False))
                for a, s, c in zip(anchor[wanted].tolist(), start[wanted].tolist(), count[wanted].tolist(), strict=True):
                    rows.append((a, i, h, s, b" ".join(words[s : s + c + window - 1])))
                size += len(raw)
                if size >= OUTPUT:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)

    return flagged.mapInArrow(run, "anchor long, id long, text_hash long, start long, words binary")


def _search(dealt: DataFrame, window: int) -> DataFrame:
    """(id, text_hash, a, b): the repeated words of each class's earliest occurrence."""
    names = ["id", "text_hash", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            # a class alone with its anchor holds a window twice only if as many of its words as a window has occur in it before
            shared = Counter(r[:2] for r in rows)
            rows = [r for r in rows if shared[r[:2]] > 1 or len(words := r[5].split()) - len(set(words)) >= window]
            ids = np.array([-(1 << 63) if r[2] is None else r[2] for r in rows], np.int64)
            hashes, starts = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
            text, place = repeated_windows([r[5].split() for r in rows], ids, hashes, starts, window)
            text, a, b = _ranges(text, place, window)
            return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in text.tolist()], pa.int64()), pa.array(hashes[text]), pa.array(starts[text] + a), pa.array(starts[text] + b)], names)

        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[:2] != last:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += row[5].count(b" ") + 2
                last = row[:2]
        if held:
            yield found(held)

    ordered = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return ordered.select("anchor", "salt", "id", "text_hash", "start", "words").mapInArrow(run, "id long, text_hash long, a long, b long")


def repeated_ranges(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, ranges): the words [a, b) that repeated windows cover; texts without any are absent."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(whole_text(text)).alias("text_hash"), whole_text(text).cast("binary").alias("raw"))
    each = materialise(_anchors(texts, window), "anchors")
    rows = each.select("id", "text_hash", F.explode("anchors").alias("anchor"))
    common = materialise(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "common-anchors")
    release(spark)
    flagged = materialise(rows.join(common, "anchor").groupBy("id", "text_hash").agg(F.collect_set("anchor").alias("anchors")), "flagged")
    discard(each, common)
    release(spark)
    same = texts["id"].eqNullSafe(flagged["id"]) & (texts["text_hash"] == flagged["text_hash"])
    searched = texts.join(flagged, same).select(texts["id"], texts["text_hash"], "raw", "anchors")
    found = _segments(searched, window).withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit("segment"), "words"))
    found = materialise(found, "segments")
    discard(flagged)
    release(spark)
    place = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("text_hash"), F.col("start")).alias("place")
    class_key = ["anchor", "h1", "h2"]
    classes = materialise(found.groupBy(*class_key).agg(F.min(place).alias("first"), F.min("words").alias("words")), "segment-classes")
    release(spark)
    covered = F.size(F.split(F.col("words").cast("string"), " "))
    firsts = classes.select(*class_key, "first", covered.alias("covered"))
    later = found.select(*class_key, "id", "text_hash", "start").join(firsts, class_key).filter(~place.eqNullSafe(F.col("first")))
    later = materialise(later.select("id", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("covered")).alias("b")), "later")
    discard(found)
    release(spark)
    ranges = materialise(_search(_dealt(classes, window), window).union(later).groupBy("id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "repeats")
    discard(classes, later)
    release(spark)
    return ranges


def _dealt(classes: DataFrame, window: int) -> DataFrame:
    """(anchor, salt, id, text_hash, start, words): each class whole, those of crowded anchors by windows."""
    crowded = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CLASSES).select("anchor", F.ceil(F.col("n") / DEAL).cast("int").alias("deals"))
    crowded = materialise(crowded, "crowded")
    small = crowded.count() <= BROADCAST
    listed = F.split(F.col("words").cast("string"), " ")
    whole = F.array(F.struct(F.lit(0).alias("salt"), F.lit(0).alias("skip"), F.col("words").alias("part")))

    def one_window(k: Column) -> Column:
        part = F.array_join(F.slice("listed", k + 1, window), " ")
        return F.struct(F.pmod(F.xxhash64(part), F.col("deals")).cast("int").alias("salt"), k.alias("skip"), part.cast("binary").alias("part"))

    dealt = classes.join(F.broadcast(crowded) if small else crowded, "anchor", "left").withColumn("listed", F.when(F.col("deals").isNotNull(), listed))
    parts = F.when(F.col("deals").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.size("listed") - window), one_window))
    return dealt.select("anchor", "first", F.inline(parts)).select("anchor", "salt", "first.id", "first.text_hash", (F.col("first.start") + F.col("skip")).alias("start"), F.col("part").alias("words"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept_text`` (the words that stay, joined by one space)."""
    ranges = repeated_ranges(docs, id_column, text, window)
    rows = docs.drop("n_words", "n_removed", "kept_text").withColumn("__text_hash", F.xxhash64(whole_text(text)))
    ranges = ranges.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("ranges").alias("__ranges"))
    joined = rows.join(ranges, F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    kept = [c for c in rows.columns if not c.startswith("__")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for raw, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                words = raw.split()
                total.append(len(words))
                if spans:
                    stays = np.ones(len(words), bool)
                    for x in spans:
                        stays[x["a"] : x["b"]] = False
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                gone.append(total[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], schema.names)

    return joined.select(*kept, whole_text(text).cast("binary").alias("__raw"), "__ranges").mapInArrow(run, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
