"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' numbers, so anagrams
share it and every edit of one letter changes it by a fixed amount.  Words that
differ by a removed letter have keys that differ by that letter's power; words
that differ by an exchanged letter share the key that is left when each loses
its own.  So every word is listed under its key, and under its key less each of
its letters, and one equality join finds additions, removals and exchanges.

An edit leaves one half of the word alone, so the join also asks for that half:
of anagrams only those meet that agree in it.  What meets is then verified by
its letters' order.  Fifth powers of two letters never have the same difference
as those of two others (a test goes through all), and words whose first halves
agree meet by these alone, so each pair counts once.

Forms are followed by pointer doubling; n grows tenfold at each step, so a chain
has few.

Defined results: a null text has no words; a null id is written as nothing in
the checksummed name; repeated rows count each time; words of any length are
whole; no documents give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialise, read_documents

#: Letters of a run: ASCII's and those of U+00C0 to U+00FF.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LETTERS = 7
LEAST_TIMES = 2
#: How many times as often as the word its form must occur.
FAR_OFTENER = 10
#: Every so many-th run, by the checksum of the document's id and the run, loses a letter.
DAMAGED = 31
POWER = 5


def letter_value(letter: Column) -> Column:
    """1 to 26 for a to z, 27 to 90 for U+00C0 to U+00FF, to the fifth power."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 128, code - 96).otherwise(code - 165)
    return number * number * number * number * number


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased (whole-string lower() does just that where all is ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def corpus_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", damaged: int = DAMAGED, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """``word`` and ``n``: the runs of letters of whole texts, some less one letter."""
    runs = docs.select(F.col(id_column).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))).alias("raw"))
    runs = runs.select("id", lower_ascii(F.col("raw")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _listed(words: DataFrame) -> DataFrame:
    """Each word under its key and half (``gone`` null), and under the key less a letter (``gone``, its value) with the other half; ``last``: the edit is in the last half."""
    spelt = words.select("word", "n", F.split("word", "").alias("c"), F.length("word").alias("len"))
    spelt = spelt.withColumn("c", F.slice("c", F.lit(1), F.col("len")))  # some versions end with an empty piece
    spelt = spelt.withColumn("key", F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + letter_value(c)))
    whole, less = F.expr("len div 2"), F.expr("(len - 1) div 2")
    left = lambda n: F.substr("word", F.lit(1), n)
    right = lambda n: F.substr("word", n + 1)

    def entry(side: int, key: Column, half: Column, size: Column, gone: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(side), key, half, size).alias("at"), gone.alias("gone"), F.lit(side == 1).alias("last"))

    def removed(side: int, part: Column, half: Column) -> Column:
        values = F.transform(F.array_distinct(part), letter_value)
        return F.transform(values, lambda v: entry(side, F.col("key") - v, F.col(half), F.col("len") - 1, v))

    spelt = spelt.select("word", "n", "c", "key", "len", left(less).alias("less_left"), right(less + 1).alias("less_right"), left(whole).alias("left"), right(whole).alias("right"))
    first, last = F.slice("c", F.lit(1), less), F.slice("c", less + 1, F.col("len") - less)
    none = F.lit(None).cast("long")
    entries = F.concat(
        F.array(entry(0, F.col("key"), F.col("right"), F.col("len"), none), entry(1, F.col("key"), F.col("left"), F.col("len"), none)),
        removed(0, first, "less_right"),
        removed(1, last, "less_left"),
    )
    return spelt.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n`` of each two words that one inserted, deleted or replaced letter tells apart, both ways."""
    listed = materialise(_listed(words), "anagrams")
    one = listed.where(F.col("gone").isNotNull())
    two = listed.select("at", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("gone").alias("other_gone"))
    # a removal meets the shorter word, or another removal of a different letter, once for the two
    met = one.join(two, "at").where(F.col("other_gone").isNull() | ((F.col("gone") != F.col("other_gone")) & (F.col("word") < F.col("other"))))
    head = F.expr("(length(word) - 1) div 2")
    once = F.col("last") | (F.substr("word", F.lit(1), head) != F.substr("other", F.lit(1), head))
    pairs = met.where(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
    return pairs.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms; words without a form have no row."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return found


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", oftener: int = FAR_OFTENER, damaged: int = DAMAGED, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    words = materialise(corpus_words(docs, id_column, text, damaged, letters, times), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = words.join(near, "word", "left").withColumn("far", -F.col("best.n") >= oftener * F.col("n"))
    told = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("best.word")).alias("form"), F.when(F.col("far"), -F.col("best.n")).alias("form_n")), "near")
    return told.join(roots(told.where(F.col("form").isNotNull())), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = """
WITH RECURSIVE bits AS (  -- the table of the checksum's bytes, by its rule
  SELECT list(entry ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS entry
    FROM range(256) r(b))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS name, run
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
summed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || digits[2 * k - 1:2 * k])::UBIGINT FOR k IN range(1, len(digits) // 2 + 1)]), lambda c, b: xor(c // 256, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM (SELECT run, hex(encode(name)) AS digits FROM runs), bits),
words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(k)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (rest, k) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, w := other)) AS best FROM pairs GROUP BY word),
told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.w END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n
  FROM words LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS node, 0 AS step FROM told
  UNION ALL
  SELECT chain.word, form, step + 1 FROM chain JOIN told ON told.word = chain.node WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(node, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""
