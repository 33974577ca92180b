"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches by descending id, so that the first of a line to come
is the one that stays.  A new batch is merge-anti-joined with the runs in one
pass: a left outer merge join whose unmatched rows are the lines no run has.  An
unseen line enters the batch's run with its ``keeper``, the largest id that
holds it; one seen before enters as an increment of its document count, without
a keeper.  Every run is a table bucketed and sorted by the 128-bit line hash,
with as many buckets as the session has shuffle partitions, so that neither the
anti-joins nor the merging of runs exchanges a run again.  ``FANOUT`` runs of
one level are merged into one of the next, counts added up, and the superseded
ones deleted.  Lines found in enough documents are then dropped everywhere but in
their keeper.

Everything runs as DataFrame expressions.  Counts are combined before the
shuffle, and the joins that mark occurrences and bring them back to the texts are
sort-merge joins of two exchanges at every size, which Spark splits where a line
is in a third of all documents.

Defined results: a null text is one empty line; a null id is a document of its
own, smaller than every other; rows that share an id count as one document;
empty tables give empty results; ids that are not numbers come in one batch;
other columns pass through unless their names begin with ``__`` or are those of
the counts, which replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import bucketed, discard, materialise, read_documents, whole_text

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
BLANKS = " \t\n\v\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lower-cased (whole-string lower() does just that where all is ASCII)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines_of(text: str) -> Column:
    return F.split(whole_text(text), "\n")


def line_hashes(docs: DataFrame, id_column: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key is long enough: id, text_hash, pos, h1, h2."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))

    long_lines = F.when(F.length(whole_text(text)) >= min_chars, F.transform(lines_of(text), hashed))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(whole_text(text)).alias("text_hash"), F.posexplode(long_lines).alias("pos", "h"))
    return rows.filter("h is not null").select("id", "text_hash", "pos", "h.h1", "h.h2")


class LineRuns:
    """The levelled runs: (h1, h2, n_docs, keeper), each a bucketed and sorted table in the shared folder."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Add the lines (id, h1, h2) of a batch, whose ids are all below those of earlier batches."""
        found = batch.select("id", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_id"))
        unseen = F.lit(True)
        for k, run in enumerate(self.runs()):
            found = found.join(run.select(*KEY, F.col("n_docs").alias(f"seen{k}")).hint("merge"), KEY, "left")
            unseen = unseen & F.col(f"seen{k}").isNull()
        self._push(0, bucketed(found.select(*KEY, "n_docs", unseen.alias("first"), F.when(unseen, F.col("last_id")).alias("keeper")), "line-run", KEY))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = bucketed(self._merged(old), "line-run", KEY)
            discard(*old)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged by full outer merge joins of their buckets: counts add up, the one keeper stays."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*KEY, F.col("n_docs").alias("more"), F.col("first").alias("first_b"), F.col("keeper").alias("keeper_b"))
            both = a.join(b.hint("merge"), KEY, "full")
            n_docs = (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs")
            return both.select(*KEY, n_docs, (F.coalesce("first", F.lit(False)) | F.coalesce("first_b", F.lit(False))).alias("first"), F.when(F.col("first"), F.col("keeper")).otherwise(F.col("keeper_b")).alias("keeper"))

        return reduce(two, runs)

    def common(self, min_docs: int = MIN_DOCS) -> DataFrame | None:
        """(h1, h2, keeper) of the lines in at least ``min_docs`` documents."""
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper") if self.runs() else None

    def delete(self) -> None:
        discard(*self.runs())
        self.levels = []


def _batches(docs: DataFrame, id_column: str, batches: int) -> tuple[Column, int]:
    """The batch of a row's ``id``, by descending ids with nulls last, and how many batches there are."""
    if batches < 2 or not isinstance(docs.schema[id_column].dataType, T.NumericType):
        return F.lit(0), 1
    cuts = docs.select(F.percentile_approx(id_column, [k / batches for k in range(1, batches)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    below = [F.when(F.col("id") > F.lit(c), 0).otherwise(1) for c in cuts]
    return reduce(Column.__add__, below, F.lit(0)), len(cuts) + 1


def dropped_positions(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, positions): the lines, counted from 0, that each text loses; texts that lose none are absent."""
    batch, n = _batches(docs, id_column, batches)
    lines = materialise(line_hashes(docs, id_column, text, min_chars).select("*", batch.cast("int").alias("batch")), "lines", ["batch"])
    runs = LineRuns()
    for k in range(n):
        runs.add(lines.filter(F.col("batch") == k))
    common = materialise(runs.common(min_docs), "common-lines")
    runs.delete()
    marked = lines.select("id", "text_hash", "pos", *KEY).join(common.hint("merge"), KEY).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = materialise(marked.groupBy("id", "text_hash").agg(F.collect_list("pos").alias("positions")), "line-drops")
    discard(lines, common)
    return drops


def without_common_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the new ``text``, n_lines (before) and n_dropped."""
    drops = dropped_positions(docs, id_column, text, **options)
    drops = drops.hint("merge").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("positions").alias("__drop"))
    rows = docs.withColumn("__text_hash", F.xxhash64(whole_text(text)))
    joined = rows.join(drops, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    joined = joined.withColumn("__lines", lines_of(text)).withColumn("n_lines", F.size("__lines").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    joined = joined.withColumn("__stay", F.when(F.col("__drop").isNotNull(), stay))
    joined = joined.withColumn("n_dropped", F.when(F.col("__stay").isNull(), 0).otherwise(F.size("__lines") - F.size("__stay")).cast("long"))
    kept = F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n")
    return joined.select(*[F.when(F.col("__stay").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_common_lines(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(whole_text(), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
