"""Personal data by base rules and by boosted candidates.

Base rules find e-mail addresses, IP addresses, card and phone numbers; those
spans always stay.  Beside them, high-recall generators propose further spans
(secrets, national ids, phone numbers without a country code, written-out
addresses), which may overlap each other and the base spans.  A proposal is
described by format and context features.  Seed labels (rules that are sure
either way) are dealt into two folds by the proposed text, so no text is in
both: boosted trees are trained on the one, and on the other their scores are
calibrated by isotonic regression.  For each generator the lowest threshold
whose held-out spans reach the wanted precision selects what is added, unless a
base span overlaps it; a generator without held-out seeds adds nothing.

Everything is DataFrame expressions.  All features are yes or no, so a proposal
is one of ``2 ** len(FEATURES)`` patterns of its generator: the corpus is
reduced to a table of patterns (bounded by the features, not by the data), the
trees are trained on it with weights, and the patterns selected go back as a
list of numbers.

Offsets come from matching ``(gap)(pattern)`` again and again, as a search
goes on from the end of each match, and adding up code points: running sums over
blocks of ``BLOCK`` matches and then inside a block.  Groups in the patterns are possessive wherever that changes no match, so that long texts need
no backtracking.

Defined results: a null or empty text has no spans (counts 0, the digest of
nothing, an empty string); rows are independent, so repeated rows agree and
ties in start are ordered by kind; an empty table gives an empty result; other
columns pass through, those named ``base`` or ``spans`` replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialise, read_documents, whole_text

PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base kinds: pattern, and what a text must contain to be searched.  Lookbehinds only skip starts that cannot match.
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", r"(?:[0-9][\x20-]?){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_WORDY = "[A-Za-z0-9_+/-]"
#: The generators, likewise.
PROPOSED = {
    "secret": (rf"(?<!{_WORDY})(?=[A-Za-z_+/-]*+[0-9]){_WORDY}{{16,}}+", rf"[0-9]"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
    "local_phone": (r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9][.-][0-9]"),
    "written_email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[(\[{{]at[)\]}}]\x20?[A-Za-z0-9-]++(?:\x20?[(\[{{]dot[)\]}}]\x20?[A-Za-z0-9-]++)++", r"[(\[{]at[)\]}]"),
}
KINDS = [*BASE, *PROPOSED]
CONTEXT = 24  # code points before a proposal, as far as the last match of its generator
_CUE = {
    "secret": r"(?i)(?:token|secret|api.?key|passw(?:or)?d|pwd|auth)[\x20\"']*[:=][\x20\"']*$",
    "national_id": r"(?i)(?:ssn|social|national|\bid)\b[^0-9]*$",
    "local_phone": r"(?i)(?:phone|tel|call|fax|mobile)[^0-9]*$",
    "written_email": r"(?i)(?:mail|contact|write|reach)[^@]*$",
}
_NOT = {
    "secret": r"^(?:[A-Za-z]+[_+/-])+[A-Za-z]*[0-9]{0,3}$|^[0-9_+/-]+$",
    "national_id": r"^(?:000|666|9)|-00-|-0000$",
    "local_phone": r"^\(?[01]",
    "written_email": r"[0-9]$",
}
#: name: (text of the span or of its context, pattern).
FEATURES = {
    "hexadecimal": ("m", r"^[0-9a-f]+$"),
    "long": ("m", r"^.{24,}$"),
    "very_long": ("m", r"^.{36,}$"),
    "mixed_case": ("m", r"[a-z].*[A-Z]|[A-Z].*[a-z]"),
    "many_digits": ("m", r"(?:[0-9][^0-9]*){6}"),
    "separators": ("m", r"[_+/()\x20.-]"),
    "word_inside": ("m", r"[a-z]{6,}"),
    "after_quote": ("ctx", r"[\"']$"),
    "after_equals": ("ctx", r"[:=][\x20\"']*$"),
    "after_word": ("ctx", r"[A-Za-z]\x20$"),
}
PRECISION = 0.9
ROUNDS = 8
DEPTH = 3
SPAN = "struct<s:int,k:int,e:int>"
WIDE_BITS = 8
WIDE = 1 << WIDE_BITS
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def _block_starts(lengths: Column) -> Column:
    """The sum of the lengths before each block of them."""
    blocks = F.sequence(F.lit(0), F.shiftright(F.size(lengths) - 1, BLOCK_BITS))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))


def _located(frame: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """``frame`` (with ``__t``) and the array ``name`` of struct(s, e, m, ctx): the matches in order, in code points."""
    pairs = rf"(?s)\G(.*?)({pattern})"
    some = F.regexp_like("__t", F.lit(needs)) if len(needs) > 1 else F.contains("__t", F.lit(needs))
    hit = F.when(some, F.regexp_like("__t", F.lit(pattern)))
    gaps, found = (F.regexp_extract_all("__t", F.lit(pairs), F.lit(k)) for k in (1, 2))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,ctx:string>>")

    def located(pieces: Column, lengths: Column, bases: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            block = F.shiftright(i, BLOCK_BITS)
            s = F.get(bases, block) + _sum(F.slice(lengths, block * BLOCK + 1, i.bitwiseAND(BLOCK - 1))) + F.length(x["g"])
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT)).alias("ctx"))

        return F.transform(pieces, span)

    pieces = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    lengths = lambda p: F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"]))
    spans = _once(pieces, lambda p: _once(lengths(p), lambda n: _once(_block_starts(n), lambda bases: located(p, n, bases))))
    return frame.withColumn("__hit", hit).withColumn(name, F.when(F.col("__hit"), spans).otherwise(empty)).drop("__hit")


def _valid(kind: str, x: Column) -> Column:
    m = x["m"]
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(m, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _pattern(x: Column, k: int) -> Column:
    """The proposal's generator and features as one number."""
    bits = [F.when(F.regexp_like(x[at], F.lit(p)), 1 << i).otherwise(0) for i, (at, p) in enumerate(FEATURES.values())]
    return sum(bits[1:], bits[0]) + (k << len(FEATURES))


def _base_spans(k: int, kind: str) -> Column:
    good = F.filter(f"__{kind}", lambda x: _valid(kind, x))
    return F.transform(good, lambda x: F.struct(x["s"], F.lit(k).alias("k"), x["e"]))


def _proposals(k: int, kind: str) -> Column:
    def described(x: Column) -> Column:
        label = F.when(F.regexp_like(x["m"], F.lit(_NOT[kind])), 0).when(F.regexp_like(x["ctx"], F.lit(_CUE[kind])), 1)
        fold = F.pmod(F.xxhash64(x["m"]), F.lit(2)).cast("int")
        return F.struct(x["s"], F.lit(k).alias("k"), x["e"], _pattern(x, k).alias("pattern"), label.alias("label"), fold.alias("fold"))

    return F.transform(f"__{kind}", described)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``base`` array<struct(s, k, e)> and ``proposed`` array<struct(s, k, e, pattern, label, fold)>; k numbers KINDS."""
    frame = docs.withColumn("__t", whole_text(text)).drop(text)
    if "base" in frame.columns or "proposed" in frame.columns:
        frame = frame.drop("base", "proposed")
    for kind, (pattern, needs) in (BASE | PROPOSED).items():
        frame = _located(frame, f"__{kind}", pattern, needs)
    base = [_base_spans(k, kind) for k, kind in enumerate(KINDS) if kind in BASE]
    proposed = [_proposals(k, kind) for k, kind in enumerate(KINDS) if kind in PROPOSED]
    frame = frame.withColumn("base", F.array_sort(F.concat(*base))).withColumn("proposed", F.array_sort(F.concat(*proposed)))
    return frame.drop("__t", *(f"__{kind}" for kind in KINDS))


def scored_patterns(found: DataFrame) -> list[tuple[int, float, int, int]]:
    """(pattern, score, held-out yes, held-out no): trees trained on fold 0 of the seed labels, counts of fold 1.

    The table of patterns is the whole training set: all seed labels of the
    corpus, as weights; its rows are bounded by the features.  Where the training
    fold has one label only there is nothing to tell apart.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    each = found.select(F.explode("proposed").alias("p")).select("p.pattern", "p.label", "p.fold")
    number = lambda label, fold: F.count(F.when((F.col("label") == label) & (F.col("fold") == fold), 1))
    counted = each.groupBy("pattern").agg(number(1, 0).alias("yes"), number(0, 0).alias("no"), number(1, 1).alias("held_yes"), number(0, 1).alias("held_no"))
    counted = materialise(counted.coalesce(1).sortWithinPartitions("pattern"), "patterns").coalesce(1)
    names = [f"f{i}" for i in range(len(FEATURES) + 2)]
    bits = counted.select("*", *(F.shiftright("pattern", i).bitwiseAND(1).cast("double").alias(n) for i, n in enumerate(names)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(bits)
    either = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("weight")) for label, c in ((1.0, "yes"), (0.0, "no"))))
    labelled = vectors.select("features", F.explode(either).alias("x")).select("features", "x.*").filter("weight > 0")
    seen = counted.agg(F.sum("yes"), F.sum("no")).first()
    score = F.lit(1.0 if seen[0] else 0.0)
    if seen[0] and seen[1]:
        vectors = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, weightCol="weight", seed=1, minInstancesPerNode=1).fit(labelled).transform(vectors)
        score = F.round(vector_to_array("probability")[1], 9)
    return [tuple(r) for r in vectors.select("pattern", score, "held_yes", "held_no").collect()]


def calibrated(scored: list[tuple[float, int, int]]) -> list[float]:
    """Isotonic regression: the share of yes foretold for each (score, yes, no), which never rises as the score falls.

    A score without held-out labels takes the share of the next lower one that has some.
    """
    order = sorted(range(len(scored)), key=lambda i: -scored[i][0])
    pools: list[list] = []  # yes, all, members
    for i in order:
        _, yes, no = scored[i]
        tied = pools and scored[pools[-1][2][-1]][0] == scored[i][0]
        if tied:
            pools[-1] = [pools[-1][0] + yes, pools[-1][1] + yes + no, pools[-1][2] + [i]]
        else:
            pools.append([yes, yes + no, [i]])
        while len(pools) > 1 and (not pools[-2][1] or pools[-1][1] and pools[-1][0] * pools[-2][1] > pools[-2][0] * pools[-1][1]):
            low = pools.pop()
            pools[-1] = [pools[-1][0] + low[0], pools[-1][1] + low[1], pools[-1][2] + low[2]]
    out = [0.0] * len(scored)
    for yes, n, members in pools:
        for i in members:
            out[i] = yes / n if n else 0.0
    return out


def chosen_patterns(scored: list[tuple[int, float, int, int]], precision: float = PRECISION) -> tuple[list[int], dict[str, tuple[float, float]]]:
    """The patterns to be added, and (precision, recall) on the held-out seed labels of each generator that has some."""
    chosen, report = [], {}
    for k in sorted({x[0] >> len(FEATURES) for x in scored}):
        own = sorted((x for x in scored if x[0] >> len(FEATURES) == k), key=lambda x: -x[1])
        share = calibrated([x[1:] for x in own])
        yes = no = 0
        taken, right, wrong = 0, 0, 0
        for i, (_, score, y, n) in enumerate(own):
            yes, no = yes + y, no + n
            last = i + 1 == len(own) or own[i + 1][1] < score
            if last and yes and yes >= precision * (yes + no) and share[i] >= 0.5:
                taken, right, wrong = i + 1, yes, no
        chosen += [x[0] for x in own[:taken]]
        if yes + no:
            report[KINDS[k]] = right / (right + wrong) if taken else 1.0, right / yes if yes else 1.0
    return sorted(chosen), report


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def private_spans(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` without the text, with ``base`` and ``spans``: arrays of struct(s, k, e), ordered, ends exclusive."""
    others = [c for c in docs.columns if c not in (text, "base", "spans")]
    own = docs.select(*(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(others)), F.col(text).alias("text"))
    found = materialise(find_spans(own), "spans")
    chosen, _ = chosen_patterns(scored_patterns(found), precision)
    wanted = F.filter("proposed", lambda x: x["pattern"].isin(chosen))
    wanted = _once(_blocks("base"), lambda blocks: F.filter(wanted, lambda x: ~_meets(blocks, x)))
    added = F.transform(wanted, lambda x: F.struct(x["s"], x["k"], x["e"]))
    spans = F.when(F.size("proposed") > 0, F.array_sort(F.concat("base", _apart(added)))).otherwise(F.col("base"))
    return found.select(*(F.col(f"own{i}").alias(c) for i, c in enumerate(others)), "base", spans.alias("spans"))


def _blocks(spans: str) -> Column:
    """The spans in blocks of struct(lo, hi, spans): the least start and the greatest end."""
    numbers = F.filter(F.sequence(F.lit(0), F.shiftright(F.size(spans), BLOCK_BITS)), lambda b: b * BLOCK < F.size(spans))
    block = lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))
    return F.transform(numbers, lambda b: F.struct(F.array_min(F.transform(block(b), lambda x: x["s"])).alias("lo"), F.array_max(F.transform(block(b), lambda x: x["e"])).alias("hi"), block(b).alias("spans")))


def _meets(blocks: Column, x: Column) -> Column:
    """Whether a span of the blocks overlaps x: only blocks that reach x are looked into."""
    over = lambda lo, hi: (lo < x["e"]) & (x["s"] < hi)
    return F.exists(blocks, lambda b: over(b["lo"], b["hi"]) & F.exists(b["spans"], lambda y: over(y["s"], y["e"])))


def _apart(spans: Column) -> Column:
    """Of overlapping spans, ordered by start, those that the first ones leave free.

    Spark copies what a fold carries at every step, so a fold over all spans
    that carries those kept would take the square of their number.  A fold over
    a block carries the block's, and a fold over the blocks carries all, once a
    block.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    numbers = F.filter(F.sequence(F.lit(0), F.shiftright(F.size(spans), WIDE_BITS)), lambda b: b * WIDE < F.size(spans))
    blocks = F.transform(numbers, lambda b: F.slice(spans, b * WIDE + 1, F.lit(WIDE)))

    def within(acc: Column, x: Column) -> Column:
        return F.when(x["s"] >= acc["end"], F.struct(x["e"].alias("end"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    def step(acc: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(acc["end"].alias("end"), empty.alias("kept")), within)
        return _once(own, lambda r: F.struct(r["end"].alias("end"), F.array_append(acc["done"], r["kept"]).alias("done")))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))
    return F.aggregate(blocks, start, step, lambda acc: F.flatten(acc["done"]))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(read_documents(spark, sf_dir).select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
