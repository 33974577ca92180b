"""Mixing sources to target weights.

Every row gets a hash-random key.  Within a source the rows are ranged by that
key into equal key intervals (the keys are uniform, so the intervals are even
whatever the source's share of the rows), interval totals are summed into
offsets, and a running sum inside each interval completes the distributed
prefix sum.  The mix of a source is the endless repetition of that order, cut
exactly at the source's budget.

Defined results: a null size counts 0 and takes nothing; a null source is a
source of its own and comes last; rows with equal ids keep apart (equal keys are
ordered by size and then by ``tie``); an empty table gives an empty mix; columns
besides the named ones pass through, those named like a column of the result
replaced (``mixed_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, apart, materialise, read_documents, word_count

KEY_DIGITS = 3  # hex digits of the key that name its interval: 4096 intervals a source
RESULT = ("source_size", "target", "taken", "full_epochs", "cut")


def hash_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """One row for each source: its key, size and target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes.  With caps of ``max_epochs`` sizes the reshared
    target is ``min(cap, weight * level)``; the level is the largest of the
    candidates that cap the k sources of smallest cap per weight, k = 0, 1, ...
    This table holds a row a source, so its one-partition windows see
    aggregates only.
    """
    totals = sized.groupBy(F.col(source).alias("__mix_source"), source_key(source).alias("__mix_key")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    totals = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    totals = totals.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("__mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    totals = totals.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return totals.select("__mix_key", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mix(rows: DataFrame, *, id_column: str = "doc_id", source: str = "source", size: str = "size", tie: str | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """``rows`` with source_size, target, taken, full_epochs and cut.

    ``full_epochs`` whole copies of the row enter the mix, and ``cut`` of its
    words once more where the budget ends inside it or beyond it.
    """
    needed = [c for c in (id_column, source, size, tie) if c]
    return apart(rows, needed, lambda own: _mixed(own, id_column, source, size, tie, weights, share, max_epochs, seed), RESULT)


def _mixed(rows: DataFrame, id_column: str, source: str, size: str, tie: str | None, weights: tuple[int, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    targets = source_targets(rows.select(source, size), source, size, weights, share, max_epochs)
    keyed = rows.withColumn("__mix_key", source_key(source)).withColumn("__mix_hash", hash_key(id_column, seed)).withColumn("__mix_part", F.conv(F.substring("__mix_hash", 1, KEY_DIGITS), 16, 10).cast("int"))
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = keyed.groupBy("__mix_key", "__mix_part").agg(F.sum(words).alias("__mix_sum"))
    earlier = Window.partitionBy("__mix_key").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__mix_offset", F.coalesce(F.sum("__mix_sum").over(earlier), F.lit(0))).drop("__mix_sum").join(targets, "__mix_key")
    order = [F.col("__mix_hash"), F.col(id_column), words] + ([F.col(tie)] if tie else [])
    inside = Window.partitionBy("__mix_key", "__mix_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(parts, ["__mix_key", "__mix_part"]).withColumn("__mix_before", F.col("__mix_offset") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    budget = F.floor("target")
    out = out.withColumn("full_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0).cast("long"))
    rest = budget - F.col("full_epochs") * F.col("source_size") - F.col("__mix_before")
    out = out.withColumn("cut", F.greatest(F.lit(0), F.least(rest, words)).cast("long")).withColumn("taken", (F.col("full_epochs") * words + F.col("cut")).cast("long"))
    return out.select(*rows.columns, *RESULT)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each copy.

    A document that the budget cuts keeps its first ``cut`` words and the
    separators between them in its last copy; one without words never enters.
    """
    return apart(docs, ("doc_id", "source", "text", "n_chars"), lambda own: _copies(own, options))


def _copies(docs: DataFrame, options: dict) -> DataFrame:
    sized = docs.withColumn("__size", word_count()).withColumn("__tie", F.xxhash64("text"))
    mixed = mix(sized, size="__size", tie="__tie", **options)
    partial = (F.col("cut") > 0) & (F.col("cut") < F.col("__size"))
    copies = F.col("full_epochs") + F.when(F.col("cut") > 0, 1).otherwise(0)
    rows = mixed.filter((F.col("__size") > 0) & (copies > 0)).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("cut"), F.lit(0)).cast("int")), "")
    text = F.when((F.col("__copy") > F.col("full_epochs")) & partial, head).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*[F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars") if c == "n_chars" else c for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    sized = materialise(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w,
         2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(floor(target) - epochs * source_size - before, size)) AS BIGINT) AS taken
FROM placed
"""
