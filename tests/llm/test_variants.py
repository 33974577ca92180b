"""Spelling variants against a plain version over all pairs of words."""

from __future__ import annotations

import random
from collections import Counter

from barloom.llm import variants
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def test_differences_of_fifth_powers_are_different():
    found = Counter(a**variants.POWER - b**variants.POWER for a in range(1, 91) for b in range(1, 91) if a != b)
    assert max(found.values()) == 1
    assert max(a**variants.POWER for a in range(1, 91)) * 2**30 < 2**63  # a word of all of Spark's longest text


def _texts() -> list[dict]:
    rng, letters = random.Random(4), "abcdeéß"
    bases = ["".join(rng.choices(letters, k=rng.randint(7, 9))) for _ in range(40)]
    words = []
    for w in bases:
        words += [w] * rng.choice((1, 3, 30, 400))
        for _ in range(30):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k] + w[k:], w[k:] + w[:k]))] * rng.choice((1, 2, 3, 25))
    words += ["aaaaaaaa"] * 50 + ["aaaaaaa"] * 5 + ["aaaaaaaaa"] * 500 + ["Aaaaaaaab", "aaaaaaaaB"] * 2 + ["x" * 30_000, "x" * 29_999] * 3
    rng.shuffle(words)
    texts = [rng.choice((" ", "1", "Ā", "\n")).join(words[k : k + 40]) for k in range(0, len(words), 40)]
    return [{"doc_id": k, "text": t} for k, t in enumerate(texts)] + [{"doc_id": None, "text": texts[0]}, {"doc_id": 1, "text": texts[1]}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": ""}, {"doc_id": 5, "text": "×÷ÀÀÀÀÀÀ ×÷ÀÀÀÀÀÀ"}]


def test_variants(spark):
    rows = _texts()
    found = variants.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    want = brute.spelling_variants(rows)
    assert len(got) == len(found) and got == want
    assert sum(x[0] is not None for x in got.values()) > 20 and any(x[0] not in (None, x[1]) for x in got.values())


def test_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("v", "w3")], "word string, form string")
    assert {r.word: r.root for r in variants.roots(chain).collect()} == {**{f"w{k}": "w11" for k in range(11)}, "v": "w11"}
    assert variants.roots(chain.limit(0)).count() == 0
