"""Quality rules by robust multivariate outliers.

Fixed rules reject texts that are too short or repeat themselves.  The others
are judged by a vector of transformed statistics within their language and
source: of all cores that hold the share ``CORE`` of a group, the
minimum-covariance-determinant estimate takes location and scatter from the one
whose scatter has the least determinant.  It is looked for from three starts (the
coordinate-wise medians and quartile ranges; the moments of all rows; the
correlations of hyperbolic tangents of the standardised statistics) by
concentration steps: after ``TRIES`` steps a group keeps the start of its least
determinant, and goes on until that falls no more.  A text whose squared Mahalanobis
distance is beyond the chi-square quantile of ``TAIL`` is rejected.

A step is one aggregation over all rows: counts and moments by start and bin of
distance, combined before the shuffle, so a group with a third of all rows costs
no task more than another.  The bins up to the one that completes the share are
the core, so its size is within one bin (a 64th part of the distance) of the
share.  The estimate is regularised: the squares of ``FLOOR``, the least spread of
a statistic that is taken for one, are added to the scatter's diagonal, so that
statistics that hardly vary do not reject everything that does.  Sources with
fewer than ``LEAST`` texts of a language are judged by all texts of the language,
and where these are too few by all texts of the table, however few: every text
that passes the fixed rules has a distance.

Defined results: a null text has no words and fails; null languages and sources
are groups of their own; repeated rows count as often as they occur; an empty
table gives an empty result; other columns pass through, those named like a
statistic or a verdict replaced (``good_documents`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import apart, discard, materialise, pieces, read_documents

CORE = 0.75  # share of a group that the estimate is made from
TRIES = 2  # steps from every start
MAX_STEPS = 30  # a bound; steps end when no determinant falls by a ten-thousandth part
TAIL = 3e-5  # share of normally distributed texts that would be rejected
LEAST = 60  # texts that a source or language needs for an estimate of its own
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
FLOOR = (0.25, 0.05, 0.16, 0.20, 0.06)
STARTS = ("medians", "moments", "tangents")
BINS = 64  # in a distance and e times it
#: Groups whose parameters are broadcast (about 300 bytes each); beyond this they are joined by shuffle.
BROADCAST_GROUPS = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = " \t\n\v\f\r"
_D = len(FEATURES)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    _, pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
    _, at, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] >= 2
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, float, float, float, float, float]:
    """The five base counts and the vector of FEATURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    n_words, chars = len(words), len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    per = 1 / max(1, chars)
    vector = (chars / max(1, n_words), (symbols * per) ** 0.5, (dup / max(1, len(lines))) ** 0.5, (repeats / max(1, n_words)) ** 0.5, (capitals * per) ** 0.5)
    return (n_words, chars, symbols, dup, repeats, *vector)


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text, unless it is kept) with the base counts, base_failed and the features (``__f_`` columns)."""
    kept = docs.drop(*([] if keep_text else [text]), *BASE, "base_failed")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), *(T.StructField(f"__f_{c}", T.DoubleType()) for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [text_statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = list(zip(*rows, strict=True)) if rows else [[]] * 10
            failed = [n < 50 or 100 * r > 50 * n for n, r in zip(found[0], found[4], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(x), pa.int64()) for x in found[:5]), pa.array(failed, pa.bool_()), *(pa.array(list(x), pa.float64()) for x in found[5:])], schema.names)

    return docs.select(*kept.columns, F.col(text).alias("__text")).mapInArrow(run, schema)


def _grouped(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``rows`` with the group ``__g`` that judges them and the groups ``__in`` whose estimates they are part of."""
    sure = F.when(~F.col("base_failed"), 1)
    own = materialise(rows.groupBy(F.col(lang).alias("__lang"), F.col(source).alias("__source")).agg(F.count(sure).alias("__n")), "quality-groups")
    n = own.count()
    langs = own.groupBy(F.col("__lang").alias("__of")).agg(F.sum("__n").alias("__l"), F.max(F.col("__n") < LEAST).alias("__asked"))
    whole = langs.agg(F.max(F.col("__l") < LEAST).alias("__all"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    number = lambda *parts: F.xxhash64(*map(F.lit, parts[:1]), *parts[1:])  # noqa: E731  joins on a number keep small hash tables
    by_source, by_lang, by_all = number("source", name("__lang"), name("__source")), number("lang", name("__lang")), number("all")
    large, enough = F.col("__n") >= LEAST, F.col("__l") >= LEAST
    judge = F.when(large, by_source).when(enough, by_lang).otherwise(by_all)
    part = F.array_compact(F.array(F.when(large, by_source), F.when(enough & F.col("__asked"), by_lang), F.when(F.col("__all"), by_all)))
    placed = own.join(_hinted(langs, n <= BROADCAST_GROUPS), F.col("__lang").eqNullSafe(F.col("__of"))).crossJoin(F.broadcast(whole))  # one row
    joined = _hinted(materialise(placed.select("__lang", "__source", judge.alias("__g"), part.alias("__in")), "quality-groups"), n <= BROADCAST_GROUPS)
    return rows.join(joined, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")


def chi_square_quantile(p: float, d: int) -> float:
    """Where the distribution function of chi-square with d degrees of freedom reaches p: its series, by halving."""

    def reached(x: float) -> float:
        term = total = 1 / (d / 2)
        k = d / 2
        while term > 1e-17 * total:
            k += 1
            term *= x / 2 / k
            total += term
        return total * math.exp(-x / 2 + d / 2 * math.log(x / 2) - math.lgamma(d / 2))

    low, high = 1e-12, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < p else (low, middle)
    return low


def _middles(rows: DataFrame) -> DataFrame:
    """(__g, q0, s0, q1, ...): coordinate-wise medians, and spreads from the quartiles."""
    quartiles = rows.groupBy("__g").agg(*(F.percentile_approx(f"__f_{c}", [0.25, 0.5, 0.75], 10_000).alias(c) for c in FEATURES))
    each = [(F.round(F.col(c)[1], 4).alias(f"q{i}"), F.greatest(F.round(F.col(c)[2] - F.col(c)[0], 4) / 1.349, F.lit(0.0)).alias(f"s{i}")) for i, c in enumerate(FEATURES)]
    return quartiles.select("__g", *(x for pair in each for x in pair))


def _inverted(moments: DataFrame) -> DataFrame:
    """``moments`` (c00, c01, ...) with the determinant ``det`` and inverse (i00, i01, ...) of the ridged scatter."""
    schema = T.StructType([*moments.schema.fields, T.StructField("det", T.DoubleType()), *(T.StructField(f"i{i}{j}", T.DoubleType()) for i, j in _PAIRS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scatter = np.zeros((len(frame), _D, _D))
            for i, j in _PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = frame[f"c{i}{j}"]
            scatter += np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(scatter)
            yield frame.assign(det=np.linalg.det(scatter), **{f"i{i}{j}": inverse[:, i, j] for i, j in _PAIRS})

    return moments.mapInPandas(run, schema)


def _starts(vectors: DataFrame, middles: DataFrame, small: bool) -> DataFrame:
    """(__g, start, m0, ..., c00, ...) of each of STARTS.  Means are from the medians on."""
    joined = vectors.join(_hinted(middles, small), "__g")
    z = [F.tanh(F.try_divide(F.col(f"x{i}"), F.col(f"s{i}"))) for i in range(_D)]
    z = [F.coalesce(x, F.lit(0.0)) for x in z]
    sums = joined.groupBy("__g").agg(
        *(F.avg(f"x{i}").alias(f"a{i}") for i in range(_D)),
        *(F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i, j in _PAIRS),
        *(F.covar_pop(z[i], z[j]).alias(f"t{i}{j}") for i, j in _PAIRS),
    )
    sums = sums.join(_hinted(middles, small), "__g")
    same = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    tangent = lambda i, j: F.coalesce(F.try_divide(F.col(f"t{i}{j}"), F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}"))), F.lit(0.0)) * same(i, j)
    zero = [F.lit(0.0).alias(f"m{i}") for i in range(_D)]
    each = [
        [*zero, *((same(i, j) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS)],
        [*(F.col(f"a{i}").alias(f"m{i}") for i in range(_D)), *(F.col(f"v{i}{j}").alias(f"c{i}{j}") for i, j in _PAIRS)],
        [*zero, *((same(i, j) if i == j else tangent(i, j)).alias(f"c{i}{j}") for i, j in _PAIRS)],
    ]
    return sums.select("__g", F.inline(F.array(*(F.struct(F.lit(name).alias("start"), *values) for name, values in zip(STARTS, each, strict=True)))))


def _hinted(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def _placed(rows: DataFrame, middles: DataFrame, small: bool) -> DataFrame:
    """``rows`` with x0, x1, ...: the statistics less their group's medians."""
    joined = rows.join(_hinted(middles, small), "__g")
    return joined.withColumns({f"x{i}": F.col(f"__f_{c}") - F.col(f"q{i}") for i, c in enumerate(FEATURES)})


def _distance() -> Column:
    diff = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_D)]
    terms = [(1 if i == j else 2) * F.col(f"i{i}{j}") * diff[i] * diff[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _bin(distance: Column) -> Column:
    return F.floor(F.log(F.greatest(distance, F.lit(1e-9))) * BINS)


def _concentrated(vectors: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """One step: (__g, start, m0, ..., c00, ...) of the rows of least distance that make up CORE."""
    measured = vectors.join(_hinted(params, small), "__g").withColumn("bin", _bin(_distance()))
    product = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    bins = measured.groupBy("__g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"p{i}") for i in range(_D)), *product)
    one = Window.partitionBy("__g", "start")
    before = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = bins.withColumns({"before": before, "all": F.sum("n").over(one)}).filter(F.col("before") < CORE * F.col("all"))
    sums = core.groupBy("__g", "start").agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(_D)), *(F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in _PAIRS))
    mean = lambda i: F.col(f"p{i}") / F.col("n")
    return sums.select("__g", "start", *(mean(i).alias(f"m{i}") for i in range(_D)), *((F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _PAIRS))


def minimum_covariance_determinants(vectors: DataFrame, middles: DataFrame, small: bool) -> DataFrame:
    """(__g, start, det, m0, ..., i00, ...) of each group's core of least determinant.  vectors: __g, x0, x1, ... from the medians on."""
    params = materialise(_inverted(_starts(vectors, middles, small)), "quality-start")
    for _ in range(TRIES):
        params = materialise(_inverted(_concentrated(vectors, params, small)).select(*params.columns), "quality-step")
    order = Window.partitionBy("__g").orderBy("det", "start")
    best = materialise(params.withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn"), "quality-best").withColumn("moved", F.lit(True))
    for _ in range(TRIES, MAX_STEPS):
        new = _inverted(_concentrated(vectors, best.filter("moved").drop("moved"), small)).select("__g", F.struct(*best.columns[1:-1]).alias("new"))
        old = best.select("__g", F.struct(*best.columns[1:-1]).alias("old"))
        falls = F.coalesce(F.col("new.det") < F.col("old.det") * (1 - 1e-4), F.lit(False))
        least = F.when(F.coalesce(F.col("new.det") < F.col("old.det"), F.lit(False)), F.col("new")).otherwise(F.col("old"))
        best = materialise(old.join(new, "__g", "left").select("__g", least.alias("x"), falls.alias("moved")).select("__g", "x.*", "moved"), "quality-step")
        if not best.filter("moved").limit(1).count():
            break
    return best.drop("moved")


def robust_verdicts(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``rows`` of :func:`with_statistics` with ``distance`` and ``kept``."""
    needed = (lang, source, "base_failed", *(f"__f_{c}" for c in FEATURES))
    return apart(rows, needed, lambda own: _judged(own, lang, source), ("distance", "kept"))


def _judged(rows: DataFrame, lang: str, source: str) -> DataFrame:
    rows = materialise(_grouped(rows, lang, source), "quality-rows")
    sure = rows.filter(~F.col("base_failed")).select(F.explode("__in").alias("__g"), *(f"__f_{c}" for c in FEATURES))
    middles = materialise(_middles(sure), "quality-middles")
    small = middles.count() * len(STARTS) <= BROADCAST_GROUPS
    vectors = materialise(_placed(sure, middles, small).select("__g", *(f"x{i}" for i in range(_D))), "quality-vectors")
    params = materialise(minimum_covariance_determinants(vectors, middles, small).join(middles, "__g"), "quality-params")
    bins = vectors.join(_hinted(params, small), "__g").groupBy("__g", _bin(_distance()).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("__g")
    half = bins.withColumns({"up": F.sum("n").over(one.orderBy("bin")), "all": F.sum("n").over(one)}).filter(F.col("up") * 2 >= F.col("all"))
    wide = half.groupBy("__g").agg(F.greatest(F.lit(1.0), F.exp((F.min("bin") + 1) / BINS) / chi_square_quantile(0.5, _D)).alias("__wide"))
    params = materialise(params.join(wide, "__g"), "quality-final")
    discard(vectors)
    judged = rows.join(_hinted(params, small), "__g", "left").withColumns({f"x{i}": F.col(f"__f_{c}") - F.col(f"q{i}") for i, c in enumerate(FEATURES)})
    judged = judged.withColumn("distance", _distance() / F.col("__wide"))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square_quantile(1 - TAIL, _D))
    return judged.withColumn("kept", kept).select(*rows.columns, "distance", "kept")


def good_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return apart(docs, (text, lang, source), lambda own: robust_verdicts(with_statistics(own, text, keep_text=True), lang, source).filter("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return robust_verdicts(with_statistics(docs)).select("doc_id", *BASE, "base_failed", "kept")
