"""Token counts kept by deltas.

A batch is a folder of two tables: signed rows by document (one that comes adds
its tokens, one that goes subtracts what it had added, a revised one does both)
and their sums by source, language and tokenizer version.  Totals are sums over
the second tables, a row a group and batch, so documents are looked at only to
learn what the deleted and revised ones had added.  The table by group is
derived from the written rows by document and its ``_SUCCESS``, written last,
commits both: a name that is committed is not applied again, and what a failed
attempt left is overwritten.  ``compact`` folds the batches into one without
forgetting their names; a name that a committed fold has is refused.

Defined results: a null text has no tokens; null sources and languages are
groups of their own; rows without an id are documents of their own, which only a
delete of the null id removes; rows of one batch that share an id all count, but
one that is the same in id, group and content was sent twice and counts once, and
a later batch with the id stands for all of them; deleting or revising what is not there removes nothing, and
inserting what is there revises it; an empty batch is committed and changes
nothing; ids of any type are kept as strings; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bpe import coder
from barloom.llm.common import materialise, read_documents, scratch_path, whole_text, word_count

LOG = "doc_id string, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
GROUP = ("source", "lang", "tokenizer")
BPE = "byte_bpe_50k/1"
WORDS = "words/1"


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, lang, content, tokenizer, tokens): a row for each document and tokenizer version; content is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            counts = [bpe.count(t) for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "content", "words", "tokens"])

    counted = docs.select(F.col("doc_id").cast("string"), "source", "lang", content_of().alias("content"), word_count().alias("words"), whole_text().alias("t")).mapInArrow(run, "doc_id string, source string, lang string, content long, words long, tokens long")
    each = F.array(F.struct(F.lit(BPE).alias("tokenizer"), F.col("tokens")), F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("tokens")))
    return counted.select("doc_id", "source", "lang", "content", F.inline(each))


def content_of(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


class TokenRollup:
    """The log at ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.path}/{batch}"

    def _is(self, path: str) -> bool:
        return self._files.exists(self._hadoop.Path(path))

    def _done(self, batch: str) -> bool:
        return self._is(f"{self._folder(batch)}/totals/_SUCCESS")

    def committed(self) -> list[str]:
        """The folders that count, in no order."""
        if not self._is(self.path):
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(self.path)) if s.isDirectory()]
        found = [b for b in found if self._done(b)]
        folded = {b for whole in found if whole.startswith("folded-") for b in self._names(whole)}
        return [b for b in found if b not in folded]

    def _names(self, whole: str) -> list[str]:
        """The batches inside a folded one: its empty marker folders (whatever its name says)."""
        return [s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/_names/{whole}"))]

    def applied(self, batch: str) -> bool:
        return self._done(batch) or any(batch in self._names(b) for b in self.committed() if b.startswith("folded-"))

    def _read(self, table: str, schema: str) -> DataFrame:
        folders = [f"{self._folder(b)}/{table}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._read("documents", LOG)

    def _commit(self, batch: str, delta: DataFrame) -> None:
        delta.select("doc_id", *GROUP, "docs", "tokens").write.mode("overwrite").parquet(f"{self._folder(batch)}/documents")
        written = self.spark.read.schema(LOG).parquet(f"{self._folder(batch)}/documents")
        _summed(written).write.mode("overwrite").parquet(f"{self._folder(batch)}/totals")

    def current(self) -> DataFrame:
        """What each document adds now."""
        return _by_document(self.log())

    def apply(self, batch: str, rows: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch: ``rows`` of :func:`count_tokens` (content may be left out) come or are revised, ids in ``deletes`` (doc_id) go.  False where it had been committed."""
        if batch.startswith(("folded-", "_", ".")) or "/" in batch:
            raise ValueError(f"not a batch name: {batch!r}")
        if self.applied(batch):
            return False
        delta = self.spark.createDataFrame([], LOG)
        have = bool(self.committed())
        if rows is not None:
            content = F.col("content") if "content" in rows.columns else F.lit(0)
            new = rows.select(F.col("doc_id").cast("string"), *GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), content.alias("content"))
            nameless, named = new.filter("doc_id is null"), new.filter("doc_id is not null")  # rows without an id are documents of their own
            named = named.dropDuplicates()
            delta = delta.union(named.drop("content")).union(nameless.drop("content"))
            if have:
                delta = delta.union(self._less(named.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"]))
        if deletes is not None and have:
            gone = deletes.select(F.col("doc_id").cast("string")).distinct()
            if rows is not None:  # a document that is both deleted and inserted is revised
                gone = gone.join(rows.select(F.col("doc_id").cast("string").alias("id")).distinct(), F.col("doc_id") == F.col("id"), "left_anti")
            delta = delta.union(self._less(gone, ["doc_id"]))
        self._commit(batch, delta)
        return True

    def _less(self, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """Minus what the wanted documents add now: the log is reduced to them before it is summed."""
        other = wanted.toDF(*(f"__{k}" for k in keys))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return _by_document(self.log().join(other, match, "left_semi")).select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def compact(self, name: str | None = None) -> None:
        """Fold all committed batches into one; their folders stop to count the moment it is committed."""
        whole = f"folded-{name or uuid.uuid4().hex}"
        if self._done(whole) or self.applied(whole):
            raise ValueError(f"a fold has this name already: {name!r}")
        batches = self.committed()
        inside = [*batches, *(n for b in batches if b.startswith("folded-") for n in self._names(b))]
        for b in inside:
            self._files.mkdirs(self._hadoop.Path(f"{self.path}/_names/{whole}/{b}"))
        self._commit(whole, self.current())
        for b in batches:
            self._files.delete(self._hadoop.Path(self._folder(b)), True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens)."""
        return _summed(self._read("totals", TOTALS)).filter("docs <> 0 or tokens <> 0")


def _by_document(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after inserts, revisions, a withdrawal and a return that end in the whole table.

    All documents with an id come with counts estimated from their bytes; exact
    counts revise them (the batch is sent twice and counts once); the documents
    of the first source by name are withdrawn and come back; the log is folded.
    """
    docs = read_documents(spark, sf_dir)
    counted = materialise(count_tokens(docs), "token-counts")
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    guess = F.greatest(F.lit(1), F.octet_length(whole_text()).cast("long") / 4).cast("long").alias("tokens")
    rollup.apply("estimates", docs.filter("doc_id is not null").select("doc_id", "source", "lang", content_of().alias("content"), F.lit(BPE).alias("tokenizer"), guess))
    for _ in range(2):
        rollup.apply("exact", counted)
    first = counted.agg(F.min("source").alias("first"))  # one row
    theirs = counted.filter("doc_id is not null").join(F.broadcast(first), F.col("source") == F.col("first")).drop("first")
    rollup.apply("withdrawal", deletes=theirs.select("doc_id"))
    rollup.apply("return", theirs)
    rollup.compact()
    return rollup.totals()
