"""Merkle manifests against a plain version: trees of several levels, other fanouts, equal rows, and proofs that fail."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.llm import manifest
from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def documents() -> list[dict]:
    rows = [{"doc_id": k * 7 % 5003, "source": "hot" if k % 10 else f"s{k % 3}", "lang": "en", "n_chars": k, "text": f"Row {k} É Ab"} for k in range(5000)]
    rows += [{"doc_id": 9999, "source": "alone", "lang": None, "n_chars": None, "text": None}, {"doc_id": 5, "source": None, "lang": None, "n_chars": 1, "text": ""}]
    rows += [{"doc_id": None, "source": "hot", "lang": "en", "n_chars": 3, "text": "x"}, {"doc_id": None, "source": "", "lang": "", "n_chars": 3, "text": "X" * 100_000}, {"doc_id": 10, "source": "é", "lang": "en", "n_chars": 3, "text": "same"}]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_query(spark, rows, tmp_path):
    pq.write_table(pa.Table.from_pylist([{"zlib": 1, **r, "tree": "x", "index": 3} for r in rows]), tmp_path / "documents.parquet")
    got = {(r.doc_id, r.leaf): tuple(r)[1:] for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    want = {(rows[k]["doc_id"], x[0]): (x[0], x[1], x[2], brute.sha("".join(x[3])), x[4], x[4] == x[2]) for k, x in brute.manifest(rows).items()}
    assert len(want) == len(rows) and got == want
    failed = {i for (i, _), x in got.items() if not x[-1]}
    assert len(failed) > 500 and all(i is not None for i in failed)


@pytest.mark.parametrize("levels", [1, 3])
def test_levels_a_task_change_nothing(spark, rows, levels):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.doc_id, r.leaf): (r.leaf, r.subroot, r.root, r.proof) for r in manifest.manifest(frame, levels=levels).collect()}
    assert got == {(rows[k]["doc_id"], x[0]): x[:4] for k, x in brute.manifest(rows).items()}


def test_proofs_by_themselves(spark, rows):
    """Another fanout; a proof serves its own leaf and no other."""
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3)
    held = found.select("root", manifest.folded(F.col("leaf"), F.col("proof"), F.col("places")).alias("own"), manifest.folded(F.sha2(F.lit("other"), 256), F.col("proof"), F.col("places")).alias("other"))
    assert {(r.own == r.root, r.other == r.root) for r in held.collect()} == {(True, False)}


def test_equal_rows(spark):
    """Rows that are alike in all columns, more than a superblock holds: one leaf, as many places."""
    rows = [{"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}] * 600
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    want = brute.manifest(rows)
    assert {r.leaf for r in got} == {want[0][0]} and {r.root for r in got} == {want[0][2]}
    assert sorted(map(str, (r.proof for r in got))) == sorted(str(x[3]) for x in want.values())
    assert len({tuple(r.places) for r in got}) == 600


def test_ids_of_text(spark):
    frame = spark.createDataFrame([("b", "s", "1"), ("a", "s", "2")], "name string, origin string, body string")
    rows = {r.name: r for r in manifest.manifest(frame, "name", "origin", ("name", "body")).collect()}
    leaves = {n: brute.sha(f"1:{n}1:{b}") for n, b in (("a", "2"), ("b", "1"))}
    assert {n: r.leaf for n, r in rows.items()} == leaves and rows["a"].proof == [leaves["b"]] and rows["b"].places == [1]
    assert rows["a"].root == rows["a"].subroot == brute.sha(leaves["a"] + leaves["b"])
