"""The positional index and its searches against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from barloom.llm import contamination
from tests.llm import brute


def _tables() -> tuple[list[tuple[int | None, str | None]], list[tuple[int | None, str | None]]]:
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "été", "x1", *(f"w{k}" for k in range(400))]
    words = lambda n: rng.choices(vocabulary, [200, 100, 100, 50, 50] + [1] * 400, k=n)
    items = [(k, " ".join(words(rng.randint(1, 40)))) for k in range(60)] + [(3, "Of the, AND of"), (None, "w7"), (60, None), (61, "..."), (62, " ".join(["the"] * 12))]
    docs = []
    for k in range(300):
        text = words(rng.choice((0, 5, 60, 300)))
        if k % 3 == 0:
            item = rng.choice(items)[1] or ""
            text[5:5] = item.upper().split()[: rng.randint(5, 40)]
        docs.append((k, "-".join(text)))
    return docs + [(None, None), (None, "w7"), (5, "w7 the"), (5, ""), (6, " ".join(["the"] * 30_000))], items


@pytest.mark.parametrize("segment,block", [(contamination.SEGMENT, contamination.BLOCK), (500, 700), (1, 1 << 24)])
def test_contamination(spark, monkeypatch, segment, block):
    docs, items = _tables()
    monkeypatch.setattr(contamination.positional_index, "__defaults__", (*contamination.positional_index.__defaults__[:-1], segment))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = contamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    got = Counter((r.doc_id, r.n_words, sum(x.e - x.s for x in r.spans), tuple(r["items"])) for r in found)
    want = Counter((i, n, hit, tuple(names)) for (i, _), (n, hit, names) in zip(docs, brute.contamination([t for _, t in docs], items), strict=True))
    assert got == want
    assert all(a.e < b.s for r in found for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert all(set(r["items"]) <= set(r.near) for r in found)


def test_proximity(spark):
    """Words about their rarest one in any order match by proximity only; not across documents, nor too far."""
    item = "k a b c d e f g h i"
    docs = [(1, "i h g f e d c b a k"), (2, item), (3, "k a b c d e f g h"), (4, "i"), (5, " ".join(["k", *"abcdefgh", *["z"] * 5, "i"])), (6, " ".join(["k", *"abcdefgh", *["z"] * 6, "i"])), (7, " ".join("abcdefghi" * 3))]
    found = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: (len(r.spans), r.near) for r in found.collect()} == {1: (0, ["1"]), 2: (1, ["1"]), 3: (0, []), 4: (0, []), 5: (0, ["1"]), 6: (0, []), 7: (0, [])}
    with pytest.raises(ValueError, match="reach"):
        contamination.contaminated(found, found, reach=64)


def test_index_holds_all_terms(spark):
    docs = [(1, "B a. a"), (2, "a c"), (3, None)]
    index = contamination.positional_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = index.first()
    assert {t.term: t.places for t in row.terms} == {"a": [1, 2, 3 + contamination.GAP], "b": [0], "c": [4 + contamination.GAP]}
    assert [(d.id, d.words, d.start) for d in row.docs] == [(1, 3, 0), (2, 2, 3 + contamination.GAP), (3, 0, 5 + 2 * contamination.GAP)]
    assert {r.term: r.n for r in contamination.frequencies(index).collect()} == {"a": 3, "b": 1, "c": 1}
