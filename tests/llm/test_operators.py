"""The queries and the pipeline over a small table with awkward rows, against plain versions and SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import media, queries, simhash, substring, tokencounts, warc
from barloom.llm.mixing import OP1_SQL
from tests.llm import brute
from tests.oracle import spark_rows, sql_rows, tables

NAMES = [*queries.QUERIES, "pipeline"]
SHARED = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a jar of old grey paint by night again"
ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "word",
    "\n\n\n",
    "a b c\x85d KELVIN İstanbul \xc9COLE stra\xdfe \U0001f600\U0001f600 ΔΣ",
    "Write to Ann.Lee+x@mail.example.org or 10.0.0.255, 300.1.1.1, 1.2.3.4.5; card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +44 (20) 7946-0958 or +1 2.",
    "\U0001f600 x@y.z \U0001f600\U0001f600 +49 30 1234567 \U0001f600 5500005555555559",
    SHARED,
    SHARED + " " + SHARED,
    "before " + SHARED + " after",
    "x" * 50_000,
    " ".join("alpha beta gamma delta".split() * 4000),
    "This Line Is Common To All\nsolo\n  this line is common to all \t\nend",
    "this line is common to all\r\nother",
    "\x0bTHIS LINE IS COMMON TO ALL",
    "#*$%&|<> " * 40 + "\n" + "#*$%&|<> " * 40,
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    first = max(docs["doc_id"].to_pylist()) + 1
    rng = random.Random(5)
    texts = ODD + [SHARED.upper()] * 5
    vocabulary = [f"w{k}" for k in range(3000)]
    long = rng.choices(vocabulary, k=20_000)
    texts += [" ".join(long), " ".join(long[:9_000] + ["changed"] + long[9_000:]), "\n".join(long[100:140])]
    odd = {"doc_id": list(range(first, first + len(texts))), "text": texts, "lang": [None, "en", "de"] * len(texts), "source": ["web", None, "a", "web"] * len(texts), "n_chars": [None if t is None else len(t) for t in texts]}
    odd = pa.table({k: pa.array(v[: len(texts)], docs.schema.field(k).type) for k, v in odd.items()}).select(docs.column_names)
    pq.write_table(pa.concat_tables([docs, odd]), path / "documents.parquet")
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")
    n = max(pages["page_id"].to_pylist())
    more = {"page_id": [n + k for k in range(1, 7)], "url": ["http://a.b/ c", None, "", "HTTP://A.B:80/x?q", "http://a.b/%C3%A9", "no url\r\nX: y"], "html": [None, "", "same\r\n\r\nWARC/1.0", "same\r\n\r\nWARC/1.0", "\U0001f600", ""]}
    more = pa.table({f.name: pa.array(more.get(f.name, [None] * 6), f.type) for f in pages.schema})
    pq.write_table(pa.concat_tables([pages, more]), path / "pages.parquet")
    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet")
    n = max(items["item_id"].to_pylist())
    more = {"item_id": [n + 1, n + 2, n + 3, n + 3, None, n + 4], "text": [None, " .,\n", "LAZY-dog", SHARED, SHARED + " twice", "w1"]}
    more = pa.table({f.name: pa.array(more[f.name], f.type) for f in items.schema})
    pq.write_table(pa.concat_tables([items, more]), path / "benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts(docs):
    return {d["doc_id"]: d["text"] for d in docs}


@pytest.fixture(scope="module")
def found(spark, folder):
    """The rows of a query by id."""
    kept = {}

    def run(name: str) -> dict[int, dict]:
        if name not in kept:
            rows = [r.asDict() for r in __spark_entry__.queries()[name](spark, folder).collect()]
            kept[name] = {r.get("doc_id", r.get("page_id", k)): r for k, r in enumerate(rows)}
            assert len(kept[name]) == len(rows)
        return kept[name]

    return run


@pytest.mark.parametrize("name", ["op1_mixing", "op3_line_dedup", "op6_warc", "op11_merkle_manifest", "op12_spelling_variants", "op13_decontamination"])
def test_sql(spark, folder, name):
    query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
    assert spark_rows(query(spark, folder)) == sql_rows(tables(folder), sql)


def test_mix_takes_its_target(found):
    rows = found("op1_mixing").values()
    for size, target in {(r["source_size"], r["target"]) for r in rows}:
        taken = sum(r["taken"] for r in rows if (r["source_size"], r["target"]) == (size, target))
        assert target - 1 < taken <= target <= 2 * size
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_line_dedup(found, texts):
    plain = brute.without_common_lines(texts)
    assert {i: r["kept_sha256"] for i, r in found("op3_line_dedup").items()} == {i: brute.sha(t) for i, t in plain.items()}


def test_token_counts(found, docs):
    enc, want = brute.tokenizer(), Counter()
    for d in docs:
        want[d["source"], d["lang"], tokencounts.BPE] += len(enc.encode_ordinary(d["text"] or ""))
        want[d["source"], d["lang"], tokencounts.WORDS] += len(brute.words(d["text"]))
    rows = found("op2_token_counts").values()
    assert {(r["source"], r["lang"], r["tokenizer"]): r["tokens"] for r in rows} == dict(want)
    assert sum(r["docs"] for r in rows if r["tokenizer"] == tokencounts.WORDS) == len(docs)


def test_rollup_deltas(spark, tmp_path):
    log = tokencounts.TokenRollup(spark, str(tmp_path / "log"))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, source string, lang string, tokenizer string, tokens long")
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in log.totals().collect()}
    first = rows((1, "a", "en", "t", 10), (2, "a", None, "t", 5), (3, None, "en", "t", None), (None, "b", "en", "t", 4))
    assert log.totals().count() == 0 and log.apply("one", first)
    assert total() == {("a", "en"): (1, 10), ("a", None): (1, 5), (None, "en"): (1, 0), ("b", "en"): (1, 4)}
    assert not log.apply("one", first) and total()["a", "en"] == (1, 10)
    assert log.apply("two", rows((1, "c", "en", "t", 7)), spark.createDataFrame([(2,), (99,), (None,)], "doc_id long"))
    after = {("c", "en"): (1, 7), (None, "en"): (1, 0)}
    assert total() == after
    log.compact("x")
    assert total() == after and not log.apply("one", first) and not log.apply("two", first) and log.committed() == ["folded-x"]
    assert log.apply("three", rows((1, "c", "en", "t", 9))) and total()["c", "en"] == (1, 9)


def test_rollup_counts_each_row_without_an_id(spark, tmp_path):
    log = tokencounts.TokenRollup(spark, str(tmp_path / "log"))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, source string, lang string, tokenizer string, tokens long")
    total = lambda: {(r.source, r.docs, r.tokens) for r in log.totals().collect()}
    assert log.apply("one", rows((None, "a", "en", "t", 4), (None, "a", "en", "t", 4), (None, "b", "en", "t", 7), (1, "a", "en", "t", 1), (1, "a", "en", "t", 1)))
    assert total() == {("a", 3, 9), ("b", 1, 7)}
    assert log.apply("two", rows((None, "a", "en", "t", 2)))
    assert total() == {("a", 4, 11), ("b", 1, 7)}
    assert log.apply("three", rows((None, "c", "en", "t", 5)), spark.createDataFrame([(None,)], "doc_id long"))
    assert total() == {("a", 1, 1), ("c", 1, 5)}


def test_rollup_counts_rows_that_share_an_id(spark, tmp_path):
    """Different rows of one id all count and are revised or deleted together; the same row twice counts once."""
    log, rows, total = _rollup(spark, tmp_path)
    log.apply("one", rows((1, "a", "en", "t", 10), (1, "b", "en", "t", 7), (1, "b", "en", "t", 7), (2, "b", "en", "t", 1)))
    assert total() == {("a", 1, 10), ("b", 2, 8)}
    docs = spark.createDataFrame([(3, "a", None, "one two"), (3, "a", None, "two one"), (3, "a", None, "two one"), (None, "a", None, "x"), (None, "a", None, "x")], "doc_id long, source string, lang string, text string")
    log.apply("two", tokencounts.count_tokens(docs).filter(F.col("tokenizer") == tokencounts.WORDS))
    assert total() == {("a", 1, 10), ("b", 2, 8), ("a", 4, 6)}
    log.apply("three", rows((1, "c", "en", "t", 5)), spark.createDataFrame([(3,)], "doc_id long"))
    assert total() == {("c", 1, 5), ("b", 1, 1), ("a", 2, 2)}


def _rollup(spark, tmp_path):
    log = tokencounts.TokenRollup(spark, str(tmp_path / "log"))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, source string, lang string, tokenizer string, tokens long")
    total = lambda: {(r.source, r.docs, r.tokens) for r in log.totals().collect()}
    return log, rows, total


def test_rollup_refuses_a_used_fold_name(spark, tmp_path):
    log, rows, total = _rollup(spark, tmp_path)
    log.apply("one", rows((1, "a", "en", "t", 4)))
    log.compact("x")
    log.apply("two", rows((2, "a", "en", "t", 5)))
    with pytest.raises(ValueError):
        log.compact("x")
    assert total() == {("a", 2, 9)}
    log.compact("y")
    log.compact()
    assert total() == {("a", 2, 9)} and not log.apply("one", rows((3, "a", "en", "t", 1))) and not log.apply("two", rows((3, "a", "en", "t", 1)))
    with pytest.raises(ValueError):
        log.compact("x")
    assert total() == {("a", 2, 9)}


def test_rollup_survives_a_crash(spark, tmp_path, monkeypatch):
    """A batch or a fold that fails between its two tables changes nothing, and can be sent again."""
    log, rows, total = _rollup(spark, tmp_path)
    log.apply("one", rows((1, "a", "en", "t", 4)))

    def fail(_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tokencounts, "_summed", fail)
        with pytest.raises(RuntimeError):
            log.apply("two", rows((1, "a", "en", "t", 6), (2, "b", "en", "t", 1)))
        with pytest.raises(RuntimeError):
            log.compact("x")
    assert total() == {("a", 1, 4)}
    assert log.apply("two", rows((1, "a", "en", "t", 6), (2, "b", "en", "t", 1)))
    assert total() == {("a", 1, 6), ("b", 1, 1)}
    log.compact("x")
    assert total() == {("a", 1, 6), ("b", 1, 1)} and not log.apply("two", rows((5, "a", "en", "t", 6)))


def test_rollup_takes_ids_of_any_type(spark, tmp_path):
    log, _, total = _rollup(spark, tmp_path)
    rows = spark.createDataFrame([("x", "a", "en", "t", 4), ("y", "a", "en", "t", 3)], "doc_id string, source string, lang string, tokenizer string, tokens long")
    log.apply("one", rows)
    log.apply("two", deletes=spark.createDataFrame([("x",)], "doc_id string"))
    assert total() == {("a", 1, 3)}


def test_byte_bpe(found, texts):
    enc = brute.tokenizer()
    for i, r in found("op4_byte_bpe").items():
        ids = enc.encode_ordinary(texts[i] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(texts[i] or ""))


def test_quality_counts(found, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = found("op5_quality")
    assert {i: tuple(r[n] for n in names) for i, r in rows.items()} == {i: brute.quality_counts(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows.values())


def test_quality_rejects_planted_outliers(spark):
    from barloom.llm.quality import robust_verdicts, with_statistics

    rng = random.Random(3)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(rng.randint(60, 200))) for _ in range(300)]
    junk = [" ".join(f"{'#' * rng.randint(3, 9)}{k}ABC" for k in range(80)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in robust_verdicts(with_statistics(docs)).filter("kept").collect()}
    assert kept == set(range(300))


@pytest.mark.parametrize("few", ["source", "language", "table"])
def test_quality_judges_small_groups(spark, few):
    """Texts of a rare source, of a rare language and of a table under LEAST rows are judged as well."""
    from barloom.llm.quality import robust_verdicts, with_statistics

    rng = random.Random(4)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(rng.randint(60, 200))) for _ in range(30 if few == "table" else 200)]
    junk = " ".join(f"{'#' * rng.randint(3, 9)}{k}ABC" for k in range(80))
    place = {"source": ("en", "rare"), "language": (None, None), "table": ("en", "s")}[few]
    rows = [(k, t, "en", "s") for k, t in enumerate(clean)] + [(-1, junk, *place), (-2, clean[0], *place)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = robust_verdicts(with_statistics(docs)).collect()
    assert len(got) == len(rows) and all(r.distance is not None for r in got)
    assert {r.doc_id for r in got if not r.kept} == {-1}


def _plain_mcd(x: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """The least determinant over many starts and all its distances, by sorting: no bins, no sums."""
    from barloom.llm import quality as q

    ridge, h = np.diag(np.square(q.FLOOR)), int(np.ceil(q.CORE * len(x)))
    best = (np.inf, None)
    starts = [rng.choice(len(x), min(len(x), 12), replace=False) for _ in range(60)] + [np.arange(len(x)), np.argsort(np.abs(x - np.median(x, axis=0)).sum(axis=1))[:h]]
    for core in starts:
        last = np.inf
        while True:
            scatter = np.cov(x[core].T, bias=True) + ridge
            diff = x - x[core].mean(axis=0)
            distance = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(scatter), diff)
            det = np.linalg.det(scatter) if len(core) >= h else np.inf
            if det < best[0]:
                best = det, distance
            if len(core) >= h and det >= last * (1 - 1e-9):
                break
            last, core = det, np.argsort(distance)[:h]
    return best[0], best[1] / max(1.0, np.median(best[1]) / q.chi_square_quantile(0.5, x.shape[1]))


def test_chi_square_quantile():
    from barloom.llm.quality import chi_square_quantile

    assert chi_square_quantile(0.5, 5) == pytest.approx(4.351460191)
    assert chi_square_quantile(0.95, 2) == pytest.approx(-2 * np.log(0.05))
    assert chi_square_quantile(0.99, 1) == pytest.approx(6.634896601)


def test_quality_verdicts_are_the_estimates(spark):
    """Every verdict and distance of correlated, contaminated groups against plain estimates from 62 starts."""
    from barloom.llm import quality as q

    rng = np.random.default_rng(6)
    mix = rng.normal(size=(5, 5))
    rows = []
    for g, (n, bad) in enumerate([(400, 60), (300, 0), (90, 15)]):
        clean = rng.normal(size=(n - bad, 5)) @ mix * 0.3 + 3
        away = rng.normal(size=(bad, 5)) * 0.1 + 3 + 8 * np.sign(rng.normal(size=5))
        rows += [(len(rows) + k, f"s{g}", *map(float, v)) for k, v in enumerate(np.vstack([clean, away]))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"__f_{c} double" for c in q.FEATURES))
    got = {r.doc_id: r for r in q.robust_verdicts(frame.withColumns({"lang": F.lit("en"), "base_failed": F.lit(False)})).collect()}
    limit = q.chi_square_quantile(1 - q.TAIL, 5)
    for g in range(3):
        own = [r for r in rows if r[1] == f"s{g}"]
        _, distance = _plain_mcd(np.array([r[2:] for r in own]), rng)
        found = np.array([got[r[0]].distance for r in own])
        assert np.allclose(found, distance, rtol=0.15, atol=0.3)
        sure = np.abs(distance / limit - 1) > 0.15
        assert [got[r[0]].kept for r, s in zip(own, sure, strict=True) if s] == [bool(d <= limit) for d, s in zip(distance, sure, strict=True) if s]


def test_warc(found, folder):
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    payload = {p["page_id"]: (p["html"] or "").encode() for p in pages}
    last = {}
    for i in sorted(payload):
        last[payload[i]] = i
    for i, r in found("op6_warc").items():
        body = payload[i]
        keeper = last[body]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if keeper == i else "revisit", None if keeper == i else keeper)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert len(found("op6_warc")) == len(pages)


def test_capture_histories_are_ordered(spark, folder):
    rows = warc.capture_histories(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert len(rows) == len({r.page_id for r in rows})
    each = lambda part: [(r.url_key, r.captured) for r in part]
    assert each(rows) == sorted(each(rows))


def test_captures_lead_to_their_records(spark, folder, tmp_path, monkeypatch):
    """Each capture's archive, offset and length give its record; a large page has an archive of its own."""
    monkeypatch.setattr(warc, "LARGE", 3000)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = warc.capture_histories(pages, str(tmp_path / "archives")).collect()
    assert len(rows) == pages.count()
    raw = {}
    for r in rows:
        data = raw.setdefault(r.file, gzip.decompress(open(r.file.removeprefix("file:"), "rb").read()))
        ((fields, block, at, length),) = warc.parse_archive(data[r.offset : r.offset + r.length])
        assert (fields.get("x-page-id"), at, length) == (None if r.page_id is None else str(r.page_id), 0, r.length)
        if r.record_type == "response":
            assert len(block.partition(b"\r\n\r\n")[2]) == r.payload_bytes
    large = [r for r in rows if r.payload_bytes > 3000]
    assert large and len({r.file for r in large}) == len(large) and all("/large/" in r.file for r in large)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16])
def test_loser_tree(n):
    rng = random.Random(n)
    capture = lambda k, i: (f"k{rng.randint(0, 9)}", f"t{rng.randint(0, 3)}", rng.choice([None, 1, 2]), "u", "response", 0, "d", None, f"f{k}", i, 1)
    runs = [sorted((capture(k, i) for i in range(rng.randint(0, 30))), key=warc.merge_order) for k in range(n)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc.merge_order)


def test_media(found, texts):
    for i, r in found("op7_media").items():
        raw = (texts[i] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
    same = {(texts[i] or "", r["media_sha256"], r["media_bytes"], r["feature"]) for i, r in found("op7_media").items()}
    assert len(same) == len({t or "" for t in texts.values()})


@pytest.mark.parametrize("kind", [*range(5), None])
def test_png_filters_and_checksums(kind):
    payload = np.random.default_rng(kind or 0).integers(0, 256, 64 * 37, np.uint8).tobytes()
    (data,) = media.encode_png([payload], kind)
    assert next(media.decode_png([data])).tobytes() == payload
    with pytest.raises(ValueError):
        list(media.decode_png([data[:60] + bytes([data[60] ^ 1]) + data[61:]]))


def _unfiltered(lines: np.ndarray) -> bytes:
    """One image, sample by sample, as the format's text says."""
    rows = []
    for kind, *given in lines.tolist():
        above, row = rows[-1] if rows else [0] * len(given), []
        for x, value in enumerate(given):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            near = min((a, b, c), key=lambda v: abs(a + b - c - v))
            row.append((value + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        rows.append(row)
    return bytes(x for row in rows for x in row)


def test_images_are_unfiltered_together(monkeypatch):
    """Images of many heights, texts and noise, all filters: each as if it were alone."""
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * h, np.uint8).tobytes() for h in (1, 2, 70, 5, 130)]
    payloads += [(SHARED * h).encode().ljust(64 * 40 * h, b"\0")[: 64 * 40 * h] for h in (1, 3)]
    ramp = np.add.outer(np.arange(60), np.arange(64)).astype(np.uint8).tobytes()
    for lines in (1 << 16, 64):
        monkeypatch.setattr(media, "LINES", lines)
        images = media.encode_png([*payloads, ramp])
        assert [x.tobytes() for x in media.decode_png(images)] == [*payloads, ramp]
    inflated = [media._inflated(x) for x in images]
    assert len({k for x in inflated for k in x[:, 0].tolist()}) >= 4
    assert [_unfiltered(x) for x in inflated] == [*payloads, ramp]


def test_frequency_hash_is_the_transform():
    """Against sums of cosines over every sample of the 32 x 32 image."""
    image = np.random.default_rng(3).integers(0, 256, (64, 64), np.uint8)
    small = image.reshape(32, 2, 32, 2).mean(axis=(1, 3))
    cos = lambda k, x: np.cos(np.pi * k * (2 * x + 1) / 64)
    low = [sum(small[y, x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    bits = "".join("1" if round(c, 6) > np.median(np.round(low[1:], 6)) else "0" for c in low)
    assert media.frequency_hash(image) == f"{int(bits, 2):016x}"


def test_pii(found, texts):
    for i, r in found("op8_pii").items():
        base = brute.base_spans(texts[i])
        joined = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert r["base_sha256"] == brute.sha(",".join(joined)), texts[i][:200]
        assert [r[f"n_{k}"] for k in brute.PII] == [sum(x[2] == k for x in base) for k in brute.PII]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(joined) <= set(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_simhash(found, texts):
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    rows = found("op9_simhash")
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute.components(prints)


def test_bk_trees_find_every_pair(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, np.uint64)
    value = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (15, 2))} | {0, 2**63}
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in value], "fp long")
    label = {r.node % 2**64: r.label % 2**64 for r in simhash.components(simhash.links(frame)).collect()}
    want = brute.components({v: v for v in value})
    groups = lambda x: {frozenset(v for v in value if x.get(v, v) == g) for g in set(x.get(v, v) for v in value)}
    assert groups(label) == groups(want)


def test_substring_dedup(found, texts):
    want = {i: (n, gone, brute.sha(kept)) for i, (n, gone, kept) in brute.without_repeats(texts).items()}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found("op10_substring_dedup").items()} == want


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_crowded_anchors(spark, texts, monkeypatch, broadcast):
    """Anchors of more classes than a shard takes, dealt by windows, by either join."""
    monkeypatch.setattr(substring, "CLASSES", 2)
    monkeypatch.setattr(substring, "DEAL", 2)
    monkeypatch.setattr(substring, "BROADCAST", broadcast)
    monkeypatch.setattr(substring, "CHUNK", 200)
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    many = {k: " ".join([*rng.choices("abcdef", k=9), *passage[rng.randint(0, 20) : rng.randint(40, 60)], *rng.choices("abcdef", k=9)]) for k in range(60)} | dict(list(texts.items())[-40:])
    found = substring.without_repeats(spark.createDataFrame(list(many.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == brute.without_repeats(many)


def test_split_trees(spark, monkeypatch):
    """Shards of more fingerprints than a tree takes are searched as several trees."""
    monkeypatch.setattr(simhash, "TREE", 8)
    rng = np.random.default_rng(2)
    value = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in rng.integers(0, 2**62, 20, np.uint64) for a, b in rng.integers(0, 12, (12, 2))}
    frame = spark.createDataFrame([(v,) for v in value], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(frame)).collect()}
    want = brute.components({v: v for v in value})
    groups = lambda x: {frozenset(v for v in value if x.get(v, v) == g) for g in {x.get(v, v) for v in value}}
    assert groups(label) == groups(want)


def test_pipeline(spark, folder, docs, found):
    """All stages again in plain Python; the verdicts of the robust estimates are taken from their query."""
    good = {i for i, r in found("op5_quality").items() if r["kept"]}
    rows = {d["doc_id"]: d for d in docs if d["doc_id"] in good}
    text = brute.without_common_lines({i: d["text"] for i, d in rows.items()})
    group = brute.components({i: brute.fingerprint(t) for i, t in text.items()})
    stay = sorted(i for i in text if group[i] == i)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": stay, "text": [text[i] for i in stay], "source": pa.array([rows[i]["source"] for i in stay], pa.string())}))
    enc, want = brute.tokenizer(), Counter()
    for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({OP1_SQL})").fetchall():
        ends = [m.end() for m in brute.WORD.finditer(text[i])]
        for k in range(0, taken, max(1, size)):
            part = text[i] if taken - k >= size else text[i][: ends[taken - k - 1]]
            ids = enc.encode_ordinary(part)
            want[i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(part)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, folder, tmp_path, name):
    for table in ("documents", "pages", "benchmark"):
        whole = pq.read_table(f"{folder}/{table}.parquet")
        pq.write_table(whole.slice(0, 0), tmp_path / f"{table}.parquet")
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_in_any_column(spark, folder, tmp_path, name):
    for table in ("documents", "pages", "benchmark"):
        whole = pq.read_table(f"{folder}/{table}.parquet")
        nulls = pa.table({f.name: pa.nulls(3, f.type) for f in whole.schema})
        pq.write_table(pa.concat_tables([whole.slice(whole.num_rows - 30, 30), nulls]), tmp_path / f"{table}.parquet")
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    if name not in ("pipeline", "op2_token_counts", "op12_spelling_variants"):
        assert len(rows) == 33


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_other_columns(spark, folder, name, stage):
    more = ("size", "taken", "source_size", "target", "cut", "kept", "distance", "n_words", "id", "fp", "label", "component", "batch", "n_lines", "n_dropped", "positions", "turn", "raw", "m0", "c00", "scale")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.lit(f"of {c}").alias(c) for c in more))
    back = stage(spark, docs, folder)
    assert back.columns == docs.columns
    assert all(r[c] == f"of {c}" for r in back.collect() for c in more)


def _secrets(rng: random.Random, n: int) -> list[tuple[int, str]]:
    """Texts with tokens after a cue, words joined by hyphens, and digests without a cue."""
    filler = lambda: " ".join(rng.choices("some plain words of no great interest".split(), k=12))
    out = []
    for k in range(n):
        kind = ("secret", "words", "none")[k % 3]
        piece = {"secret": 'token = "' + "".join(rng.choices("0123456789abcdef", k=36)) + '"', "words": "well-known-and-much-loved-song-" + str(rng.randint(1, 99)), "none": ""}[kind]
        out.append((k, f"{filler()} {piece} {filler()}"))
    return out


def test_pii_finds_planted_secrets(spark):
    """Held-out precision and recall, and the spans themselves against where the secrets were put."""
    from barloom.llm import pii

    texts = dict(_secrets(random.Random(8), 300))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(k, m.start(), m.end()) for k, t in texts.items() for m in re.finditer(r"[0-9a-f]{36}", t)}
    rows = pii.private_spans(docs).collect()
    got = {(r.doc_id, x.s, x.e) for r in rows for x in r.spans}
    assert len(want) == 100 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    _, report = pii.chosen_patterns(pii.scored_patterns(pii.find_spans(docs)))
    assert report["secret"][0] >= 0.9 and report["secret"][1] >= 0.9


def test_calibration_is_isotonic():
    from barloom.llm.pii import FEATURES, KINDS, calibrated, chosen_patterns

    assert calibrated([(0.9, 8, 2), (0.8, 9, 1), (0.5, 0, 0), (0.2, 1, 9)]) == [0.85, 0.85, 0.1, 0.1]  # no labels: as the next lower score
    assert calibrated([(0.5, 1, 1), (0.5, 3, 1)]) == [4 / 6, 4 / 6]
    first = KINDS.index("secret") << len(FEATURES)
    scored = [(first + 1, 0.9, 19, 1), (first + 2, 0.8, 9, 1), (first + 3, 0.7, 1, 9), (first + 4, 0.95, 0, 0)]
    assert chosen_patterns(scored) == ([first + 1, first + 2, first + 4], {"secret": (28 / 30, 28 / 29)})
    assert chosen_patterns([(first, 0.9, 0, 0)]) == ([], {})


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129, 1000])
def test_pii_offsets_over_blocks(spark, n):
    """Offsets of many matches, and proposals between base spans."""
    from barloom.llm import pii

    text = " ".join(f"é{k} user{k}@mail.example.org" for k in range(n)) + " end"
    row = pii.private_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.s, x.e) for x in row.base] == [(a, b) for a, _, _, b in brute.base_spans(text)]
    spans = [(a, a + 3) for a in range(0, 4 * n, 2)]
    frame = spark.createDataFrame([([{"s": a, "k": 0, "e": b} for a, b in spans],)], f"spans array<{pii.SPAN}>")
    kept = frame.select(pii._apart(F.col("spans")).alias("x"), pii._once(pii._blocks("spans"), lambda b: F.filter(F.col("spans"), lambda x: ~pii._meets(b, x))).alias("y")).first()
    want = [x for k, x in enumerate(spans) if k % 2 == 0]
    assert [(x.s, x.e) for x in kept.x] == want and kept.y == []


def test_pii_many_proposals(spark):
    """Proposals by the ten thousand in one text, some overlapping in chains, in a time that grows with their number."""
    from barloom.llm import pii

    rng = random.Random(3)
    spans, at = [], 0
    for _ in range(60_000):
        at += rng.randint(0, 4)
        spans.append((at, at + rng.randint(1, 6)))
    want, end = [], 0
    for a, b in spans:
        if a >= end:
            want.append((a, b))
            end = b
    frame = spark.createDataFrame([([{"s": a, "k": 0, "e": b} for a, b in spans],)], f"spans array<{pii.SPAN}>").cache()
    frame.count()
    began = time.monotonic()
    kept = frame.select(pii._apart(F.col("spans")).alias("x")).first().x
    assert [(x.s, x.e) for x in kept] == want and time.monotonic() - began < 20


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_mixing", "op3_line_dedup", "op5_quality")])
def test_columns_that_clash_change_nothing(spark, folder, tmp_path, name):
    more = ("id", "fp", "label", "component", "h1", "words", "start", "anchor", "salt", "ranges", "raw", "t", "ids", "media", "n_bytes", "feature", "base", "spans", "proposed", "tokens", "docs", "tokenizer", "digest", "size", "keeper", "file", "offset", "value", "kept_text", "n_words", "__t", "__hash")
    both = {}
    for kind in ("plain", "clashing"):
        (tmp_path / kind).mkdir()
        for table in ("documents", "pages", "benchmark"):
            whole = pq.read_table(f"{folder}/{table}.parquet")
            part = whole.slice(whole.num_rows - 40, 40)
            for c in more if kind == "clashing" else ():
                part = part if c in part.column_names else part.append_column(c, pa.array([f"of {c}"] * 40))
            pq.write_table(part, tmp_path / kind / f"{table}.parquet")
        both[kind] = spark_rows(__spark_entry__.queries()[name](spark, str(tmp_path / kind)))
    assert both["plain"] == both["clashing"]
